"""
within its owners' scores, it completes one round after its latest company
owner, and a single-owner company carries its owner's score."""

import os

import pytest
from pyspark.sql import functions as F

from meshscope.operators import propagation, quality
from meshscope.sources import fixture

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def run(spark):
    clean = quality.clean_edges(fixture.ownership(spark, SF))
    return clean, fixture.seed(spark, SF), propagation.run_opacity(clean, fixture.seed(spark, SF))


def test_value_within_owner_scores(run):
    _, _, r = run
    edges = r.edges()
    span = edges.groupBy("RUT_SOCIEDAD").agg(F.min("Valor").alias("lo"), F.max("Valor").alias("hi"))
    c = r.companies.join(span, r.companies.CONT_RUT == span.RUT_SOCIEDAD)
    bad = c.filter((F.col("Value") < F.col("lo") - 1e-12) | (F.col("Value") > F.col("hi") + 1e-12))
    assert c.count() == r.companies.count() > 8986 and bad.count() == 0


def test_round_is_one_after_latest_company_owner(run):
    _, seed, r = run
    comp = r.companies.select(F.col("CONT_RUT").alias("o"), F.col("iterations").alias("owner_it"))
    seeded = seed.filter(F.col("Valor").isNotNull()).select(F.col("CONT_RUT").alias("s"))
    e = r.edges()
    # Owners scored by the seed count as round -1 (they are known before round 0).
    owner_round = (
        e.join(seeded, e.RUT_SOCIO == seeded.s, "left")
        .join(comp, e.RUT_SOCIO == comp.o, "left")
        .select("RUT_SOCIEDAD", F.when(F.col("s").isNotNull(), F.lit(-1))
                .otherwise(F.col("owner_it")).alias("r"))
        .groupBy("RUT_SOCIEDAD").agg(F.max("r").alias("latest"))
    )
    c = r.companies.join(owner_round, r.companies.CONT_RUT == owner_round.RUT_SOCIEDAD)
    assert c.filter(F.col("iterations") != F.col("latest") + 1).count() == 0


def test_single_owner_company_has_owner_score(run):
    clean, seed, r = run
    round0 = r.companies.filter("iterations = 0")
    rows = propagation.single_owner_check(clean, seed, round0)
    assert rows.count() > 0 and rows.filter("Comp = 0").count() == 0
