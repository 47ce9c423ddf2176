"""The whole job: cleaning, then opacity and family index, then the report.

Every table that several steps need (clean edges, scored companies, owners,
relations) is computed and written once.  Intermediate tables are removed when
the outputs are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from meshscope.operators import family as fam
from meshscope.operators import ownership as own
from meshscope.operators import propagation as prop
from meshscope.operators import quality as q
from meshscope.operators import report as rep
from meshscope.plans.iterate import Workspace
from meshscope.sources import writers

HIGH = 0.75

#: Folders that ``run_job`` writes below its target.
OUTPUTS = [
    "edges",
    "anomalies",
    "opacity_companies",
    "opacity_edges",
    "companies_per_person",
    "family_index",
    "family_index_copy",
    "high_opacity",
    "describe_scores",
    "score_histogram",
    "score_by_round",
    "completion_rate",
    "describe_family",
    "describe_anomalies",
    "describe_high_opacity",
]


def run_job(raw: DataFrame, seed: DataFrame, family: DataFrame, target: str, **seed_options) -> list[str]:
    """Write every output below ``target`` (parquet); returns their paths."""
    spark = raw.sparkSession

    def write(df: DataFrame, *names: str) -> DataFrame:
        writers.write_many(df, [f"{target}/{n}" for n in names])
        return spark.read.schema(df.schema).parquet(f"{target}/{names[0]}")

    with Workspace(spark, "job") as space:
        deduped = space.materialize(q.dedup_edges(raw), "deduped")
        clean = write(q.clean_edges(deduped), "edges")
        anomalies = write(q.capital_anomalies(deduped), "anomalies")
        write(rep.describe(anomalies, ("CAPITAL", "UTILIDADES")), "describe_anomalies")

        run = prop.run_opacity(clean, seed, workspace=space.folder("opacity"), **seed_options)
        companies = write(run.companies, "opacity_companies")
        edges = write(run.edges(), "opacity_edges")

        owners = own.ultimate_owners(clean, seed, workspace=space.folder("owners"), **seed_options)
        write(own.companies_per_person(owners), "companies_per_person")
        relations = space.materialize(fam.family_relations(family), "relations")
        index = fam.family_index(owners, relations, workspace=space.folder("family"))
        index = write(index, "family_index", "family_index_copy")
        write(rep.describe(index, ("FAMILIARES", "TOTAL", "TASA_FAMILIARIDAD")), "describe_family")

        high = write(rep.high_opacity(companies, HIGH), "high_opacity")
        write(rep.describe(high, (prop.VALUE, prop.ITER)), "describe_high_opacity")
        write(rep.describe(companies, (prop.VALUE, prop.ITER)), "describe_scores")
        write(rep.score_histogram(companies), "score_histogram")
        write(rep.score_by_round(companies), "score_by_round")
        write(rep.completion_rate(edges, companies), "completion_rate")
    return [f"{target}/{n}" for n in OUTPUTS]
