"""Separate small cases of FIXTURES.md §3 and the readers / writers."""

import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshscope.functions import quantiles
from meshscope.operators import family, ownership, propagation, quality, report
from meshscope.sources import readers, writers
from meshscope.sources import schemas as S

EDGE_SCHEMA = (
    "RUT_SOCIEDAD string, RUT_SOCIO string, PORCENTAJE_CAPITAL double, PORCENTAJE_UTILIDADES double"
)


def edges_df(spark, rows):
    return spark.createDataFrame([(c, o, w, w) for c, o, w in rows], EDGE_SCHEMA)


def test_duplicate_seed_fails(spark):
    e = edges_df(spark, [("A", "p1", 100.0)])
    seed = spark.createDataFrame([("p1", 0.1), ("p1", 0.2)], "CONT_RUT string, Valor double")
    # The check runs inside the first job that joins the seed.
    with pytest.raises(Exception, match="repeated CONT_RUT"):
        propagation.opacity_index(e, seed).collect()
    with pytest.raises(Exception, match="repeated CONT_RUT"):
        ownership.ultimate_owners(e, seed).collect()


def test_zero_capital_total_is_null(spark):
    e = edges_df(spark, [("A", "p1", 50.0), ("A", "p2", -50.0), ("B", "A", 100.0)])
    seed = spark.createDataFrame([("p1", 0.1), ("p2", 0.2)], "CONT_RUT string, Valor double")
    got = {r.CONT_RUT: r.Value for r in propagation.opacity_index(e, seed).collect()}
    # A completes with no defined value; B never completes through it.
    assert got == {"A": None}


def test_a_long_chain_is_followed_to_its_end(spark):
    # c0 owned by a person, c_k owned by c_{k-1}: c_k completes in round k.
    rows = [("c0", "p", 100.0)] + [(f"c{k}", f"c{k - 1}", 100.0) for k in range(1, 14)]
    seed = spark.createDataFrame([("p", 0.4)], "CONT_RUT string, Valor double")
    run = propagation.run_opacity(edges_df(spark, rows), seed)
    assert {r.CONT_RUT: r.iterations for r in run.companies.collect()} == {f"c{k}": k for k in range(14)}
    late = {r.RUT_SOCIEDAD for r in run.edges(before=10).collect() if r.Valor is None}
    assert late == {"c11", "c12", "c13"} and not propagation.incomplete_companies(run.edges()).count()
    owners = ownership.ultimate_owners(edges_df(spark, rows), seed)
    pool = {r.RUT_SOCIEDAD: (r.NONULOS, r.eligible) for r in ownership.owner_pool(owners).collect()}
    assert pool == {f"c{k}": (1, True) for k in range(14)}


def test_quantiles_over_many_ranges_and_with_nan(spark):
    values = [float((37 * k) % 1009) for k in range(1009)] + [float("nan"), None, 5.0, 5.0, 5.0]
    df = spark.createDataFrame([(v, 2.0) for v in values], "a double, b double").repartition(6)
    found = report.describe(df, ("a", "b", "a"))
    got = {(r.variable, r.stat): r.value for r in found.collect()}
    plain = pd.Series([v for v in values if v is not None]).dropna().describe()
    for stat, value in plain.items():
        assert got["a", stat] == pytest.approx(value)
    assert got["b", "50%"] == 2.0 and got["b", "std"] == 0.0
    ranges = quantiles.exact_quantiles(df, ["a"], [0.0, 0.1, 1.0])
    assert ranges["a"] == [0.0, plain_quantile(values, 0.1), 1008.0]
    empty = {r.stat: r.value for r in report.describe(df.filter("a < 0"), ("a",)).collect()}
    assert empty["count"] == 0 and empty["50%"] is None


def plain_quantile(values, p):
    return float(pd.Series([v for v in values if v is not None]).dropna().quantile(p))


def test_histogram_of_a_narrow_column(spark):
    df = spark.createDataFrame([(1.0 + k * 1e-12,) for k in range(10)], "v double")
    counts = [r["count"] for r in report.score_histogram(df, "v", bins=3).orderBy("bin").collect()]
    assert sum(counts) == 10 and min(counts) > 0


def test_closure_chain_four_hops(spark):
    rel = [(f"q{i}", f"q{i + 1}", "X") for i in range(1, 6)]
    fam = spark.createDataFrame(rel, "CONT_RUT string, RUT_FAM string, TIPO_RELACION string")
    levels = family.family_closure_levels(fam, hops=4)
    pairs = {tuple(r) for r in family.family_closure(levels).collect()}
    assert len(pairs) == 28
    assert ("q1", "q6") not in pairs and ("q1", "q5") in pairs and ("q5", "q1") in pairs
    sizes = {r.hop: r.n_pairs for r in family.closure_sizes(levels).collect()}
    assert sizes == {1: 5, 2: 4, 3: 3, 4: 2}


def test_closure_self_relations_are_steps_and_one_id_excluded(spark):
    rows = [("a", "a", "X"), ("a", "b", "X"), ("t1", "a", "X"), (None, "b", "X"), ("b", None, "X")]
    fam = spark.createDataFrame(rows, "CONT_RUT string, RUT_FAM string, TIPO_RELACION string")
    levels = family.family_closure_levels(fam, hops=2, exclude_id="t1")
    got = sorted((r.CONT_RUT, r.RUT_FAM, r.hop) for r in levels.collect())
    assert got == [("a", "b", 1), ("a", "b", 2)]


def test_family_relations_drop_self_and_null(spark):
    rows = [("a", "b", "X"), ("b", "a", "Y"), ("c", "c", "X"), (None, "d", "X"), ("e", None, "X")]
    fam = spark.createDataFrame(rows, "CONT_RUT string, RUT_FAM string, TIPO_RELACION string")
    got = sorted(tuple(r) for r in family.family_relations(fam).collect())
    assert got == [("a", "b"), ("b", "a")]
    types = {r.TIPO_RELACION: r.N for r in family.relation_types(fam).collect()}
    assert types == {"X": 4, "Y": 1}


def test_csv_reader_decimal_comma(spark):
    d = tempfile.mkdtemp(prefix="meshscope-csv-")
    path = os.path.join(d, "edges.csv")
    with open(path, "w") as f:
        f.write("RUT_SOCIEDAD;RUT_SOCIO;PORCENTAJE_CAPITAL;PORCENTAJE_UTILIDADES\n")
        f.write("A;p1;0,5;0.5\n")
        f.write("A;p2;;12\n")
    df = readers.load_edges(spark, path, fmt="csv", sep=";")
    assert dict(df.dtypes)["PORCENTAJE_CAPITAL"] == "double"
    rows = sorted(df.collect(), key=lambda r: r.RUT_SOCIO)
    assert (rows[0].PORCENTAJE_CAPITAL, rows[0].PORCENTAJE_UTILIDADES) == (0.5, 0.5)
    assert rows[1].PORCENTAJE_CAPITAL is None
    # NULL share is dropped by the non-zero filter (three-valued logic).
    assert quality.clean_edges(df).count() == 1


def test_csv_reader_strict_and_lenient(spark):
    d = tempfile.mkdtemp(prefix="meshscope-csv-")
    path = os.path.join(d, "seed.csv")
    with open(path, "w") as f:
        f.write("CONT_RUT,Valor\np1,abc\n")
    with pytest.raises(Exception):
        readers.load_seed(spark, path, fmt="csv").collect()
    lenient = readers.load_seed(spark, path, fmt="csv", strict=False).collect()
    assert lenient[0].Valor is None


def test_write_many_round_trip(spark):
    d = tempfile.mkdtemp(prefix="meshscope-out-")
    e = edges_df(spark, [("A", "p1", 60.0), ("A", "p2", 40.0)])
    writers.write_many(e, [os.path.join(d, "x"), os.path.join(d, "y")])
    writers.write_table(e, os.path.join(d, "z"), fmt="csv")
    back = readers.load_edges(spark, os.path.join(d, "z"), fmt="csv")
    assert sorted(back.collect()) == sorted(e.collect())
    assert readers.load_edges(spark, os.path.join(d, "y")).count() == 2


def test_quality_profile(spark):
    raw = edges_df(spark, [("A", "p1", 0.0), ("A", "p1", 0.0), ("A", "p2", 120.0), ("B", "p1", None)])
    assert quality.null_share_rows(raw).count() == 1
    dup = quality.duplicate_edges(raw).collect()
    assert [(r.RUT_SOCIO, r.c) for r in dup] == [("p1", 2)]
    prof = quality.zero_share_profile(quality.dedup_edges(raw)).first()
    assert (prof.any_zero, prof.both_zero, prof.only_capital_zero) == (1, 1, 0)
    assert quality.out_of_range_shares(raw).count() == 1
    anomalies = quality.capital_anomalies(quality.dedup_edges(raw)).collect()
    assert {r.RUT_SOCIEDAD for r in anomalies} == {"A"}
    assert quality.entity_lookup(raw, prefix="p", columns=("RUT_SOCIO",)).count() == 4


@pytest.mark.parametrize("members_per_row, others_per_row", [(10_000, 1_000), (4, 1_000), (10_000, 1), (4, 1)])
def test_related_pairs_of_lists_and_rows(spark, monkeypatch, members_per_row, others_per_row):
    """Pools in one row, and members of large pools and hubs row by row, give the same pairs."""
    monkeypatch.setattr(ownership, "MEMBERS_PER_ROW", members_per_row)
    monkeypatch.setattr(ownership, "OTHERS_PER_ROW", others_per_row)
    rng = random.Random(5)
    members = [(f"O{c}", f"C{p}", rng.randrange(1, 4)) for c in range(8) for p in rng.sample(range(12), 2 + c % 5)]
    members += [("O0", "C20", None), ("O0", "C21", 2), (None, "C20", 1), (None, "C21", 1)]
    related = {tuple(rng.sample(range(12), 2)) for _ in range(15)} | {(0, k) for k in range(1, 10)} | {(20, 21), (3, 3)}
    links = {frozenset((f"C{a}", f"C{b}")) for a, b in related if a != b}
    want = sorted(
        (c, p, r, None if n is None or k is None else n * k)
        for c, p, n in members for d, r, k in members
        if c is not None and c == d and frozenset((p, r)) in links
    )
    found = ownership.co_owner_pairs(
        spark.createDataFrame(members, f"{S.COMPANY} string, {S.TAXPAYER} string, n_paths bigint"),
        spark.createDataFrame([(f"C{a}", f"C{b}") for a, b in related], f"{S.TAXPAYER} string, {S.RELATIVE} string"),
    )
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted((tuple(None if v is None else v if isinstance(v, str) else int(v) for v in r) for r in found.collect()), key=key) == sorted(want, key=key)
