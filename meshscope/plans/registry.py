"""Registered queries: one per work item, on the tables derived from a test folder.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame.  Computed
doubles are rounded to 6 places at this presentation step only (the
operators return full precision), because floating sums depend on the
order in which engines add them.  The value is nudged by 1e-12 before the
half-up rounding: a true value on a rounding tie (say 0.3034375) then
rounds the same way whichever side of the tie the last bit of a sum fell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshscope.operators import family as fam
from meshscope.operators import ownership as own
from meshscope.operators import propagation as prop
from meshscope.operators import quality as q
from meshscope.operators import report as rep
from meshscope.plans.iterate import Workspace
from meshscope.plans.jobs import run_job
from meshscope.sources import fixture, readers, writers
from meshscope.sources import schemas as S

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries.
OUT_OF_RANGE_HI = 45.0
LOOKUP_PREFIX = "O24"
LOOKUP_ID = "O241"
EGO_ENTITIES = ["O240", "O241", "S1"]
HIGH_THRESHOLD = 0.75
TOP_K = 20
SMALL_POOL = 30
NOTEBOOK_ROUNDS = 5
BEFORE_ROUND = 10
CLOSURE_EXCLUDE = "S7"
RESULT_PREFIX = "O24"


ROUND_NUDGE = 1e-12


def _r6(c: str) -> F.Column:
    return F.round(F.col(c) + F.lit(ROUND_NUDGE), 6).alias(c)


def _raw(spark, d):
    return fixture.ownership(spark, d)


def _clean(spark, d):
    return q.clean_edges(fixture.ownership(spark, d))


def _dedup(spark, d):
    return q.dedup_edges(fixture.ownership(spark, d))


def _opacity(spark, d) -> prop.OpacityRun:
    return prop.run_opacity(_clean(spark, d), fixture.seed(spark, d))


def _companies(spark, d) -> DataFrame:
    return _opacity(spark, d).companies


def _owners(spark, d) -> DataFrame:
    return own.ultimate_owners(_clean(spark, d), fixture.seed(spark, d))


def _relations(spark, d) -> DataFrame:
    return fam.family_relations(fixture.family(spark, d))


# ---------------------------------------------------------------- sources

def load_edges(spark, d):
    """O-01: raw edges through a ';'-separated, decimal-comma CSV and back."""
    ws = Workspace(spark, "csv")
    raw = _raw(spark, d)

    def comma(c):
        return F.regexp_replace(F.col(c).cast("string"), r"\.", ",").alias(c)

    text = raw.select(S.COMPANY, S.OWNER, comma(S.CAPITAL), comma(S.PROFIT))
    path = ws.path("ownership_csv")
    writers.write_table(text, path, fmt="csv", sep=";")
    return readers.load_edges(spark, path, fmt="csv", sep=";")


def _rejected_lines(spark, d):
    """The edge table as ';'-separated lines, some without a number, some without their last field."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (S.COMPANY, S.OWNER, S.CAPITAL, S.PROFIT)]
    text[2] = F.when(F.col(S.OWNER).endswith("3"), F.lit("n/a")).otherwise(text[2])
    cut = F.col(S.COMPANY).endswith("7") & F.col(S.OWNER).endswith("1")
    line = F.when(cut, F.concat_ws(";", *text[:3])).otherwise(F.concat_ws(";", *text))
    ws = Workspace(spark, "rejects")
    _raw(spark, d).select(line.alias("line")).write.text(ws.path("lines"))
    return readers.read_with_rejects(spark, ws.path("lines"), S.OWNERSHIP, ws, sep=";", header=False)


def load_edges_rejects(spark, d):
    """O-01: the lines of a CSV that do not parse, with the reason."""
    return _rejected_lines(spark, d)[1]


def load_edges_accepted(spark, d):
    """O-01: the typed rows of the same scan."""
    return _rejected_lines(spark, d)[0]


def sorted_lookup(spark, d):
    """O-02, O-09: a prefix lookup on a sorted sink."""
    ws = Workspace(spark, "sorted")
    writers.write_sorted(_clean(spark, d), ws.path("edges"), [S.COMPANY, S.OWNER, S.CAPITAL])
    return q.entity_lookup(readers.load_edges(spark, ws.path("edges")), prefix=LOOKUP_PREFIX)


def last_edges(spark, d):
    """O-23: one edge per pair, the last in file order (files sorted, so it has the largest share)."""
    ws = Workspace(spark, "last")
    writers.write_sorted(_clean(spark, d), ws.path("edges"), [S.COMPANY, S.OWNER, S.CAPITAL, S.PROFIT])
    edges = readers.read_positioned(spark, ws.path("edges"), S.OWNERSHIP)
    return own.last_edges(edges, readers.POSITION)


def write_round_trip(spark, d):
    """O-02: clean edges written once to two parquet targets, read back."""
    ws = Workspace(spark, "sink")
    targets = [ws.path("a"), ws.path("b")]
    writers.write_many(_clean(spark, d), targets)
    return readers.load_edges(spark, targets[1])


def load_seed(spark, d):
    """O-01: seed through parquet with text numbers, cast on reading."""
    ws = Workspace(spark, "seed")
    text = fixture.seed(spark, d).select(S.TAXPAYER, F.col(S.SEED_VALUE).cast("string"))
    writers.write_table(text, ws.path("seed"))
    return readers.load_seed(spark, ws.path("seed"))


def load_family(spark, d):
    """O-01: family relations by a catalog name."""
    fixture.family(spark, d).createOrReplaceTempView("meshscope_family")
    return readers.load_family(spark, "meshscope_family", fmt="table")


def load_groups(spark, d):
    """O-01: known groups through a ','-separated CSV and back."""
    ws = Workspace(spark, "groups")
    writers.write_table(fixture.known_groups(spark, d), ws.path("groups_csv"), fmt="csv")
    return readers.load_groups(spark, ws.path("groups_csv"), fmt="csv")


# ---------------------------------------------------------------- quality

def clean_edges(spark, d):
    return _clean(spark, d)


def clean_edges_profit(spark, d):
    return q.clean_edges(_raw(spark, d), share="profit")


def clean_edges_no_anomalies(spark, d):
    return q.clean_edges(_raw(spark, d), filter_anomalous=True, lo=95.0, hi=105.0)


def null_share_rows(spark, d):
    return q.null_share_rows(_raw(spark, d))


def zero_share_profile(spark, d):
    return q.zero_share_profile(_dedup(spark, d))


def out_of_range_shares(spark, d):
    return q.out_of_range_shares(_dedup(spark, d), lo=0.0, hi=OUT_OF_RANGE_HI)


def duplicate_edges(spark, d):
    return q.duplicate_edges(_raw(spark, d), min_count=2)


def pair_multiplicity(spark, d):
    return q.pair_multiplicity(_dedup(spark, d), min_count=2)


def composition_totals(spark, d):
    return q.composition_totals(_dedup(spark, d)).select(S.COMPANY, _r6("CAPITAL"), _r6("UTILIDADES"))


def capital_anomalies(spark, d):
    return q.capital_anomalies(_dedup(spark, d), lo=95.0, hi=105.0).select(
        S.COMPANY, _r6("CAPITAL"), _r6("UTILIDADES"))


def capital_anomalies_pair_mean(spark, d):
    return q.capital_anomalies(_clean(spark, d), lo=90.0, hi=105.0, pair_mean=True).select(
        S.COMPANY, _r6("CAPITAL"), _r6("UTILIDADES"))


def profit_anomalies(spark, d):
    return q.capital_anomalies(_dedup(spark, d), lo=95.0, hi=105.0, column="UTILIDADES").select(
        S.COMPANY, _r6("CAPITAL"), _r6("UTILIDADES"))


def entity_lookup_prefix(spark, d):
    return q.entity_lookup(_clean(spark, d), prefix=LOOKUP_PREFIX, columns=(S.COMPANY, S.OWNER))


def entity_lookup_id(spark, d):
    return q.entity_lookup(_clean(spark, d), entity=LOOKUP_ID, columns=(S.COMPANY, S.OWNER))


def group_coverage(spark, d):
    return q.group_coverage(fixture.known_groups(spark, d), _clean(spark, d))


def group_coverage_raw(spark, d):
    return q.group_coverage(fixture.known_groups(spark, d), _raw(spark, d))


# ---------------------------------------------------------------- opacity

def opacity_index(spark, d):
    return _companies(spark, d).select(S.TAXPAYER, _r6(prop.VALUE), prop.ITER)


def opacity_edges(spark, d):
    return _opacity(spark, d).edges().select(S.COMPANY, S.OWNER, _r6(S.CAPITAL), _r6(S.SEED_VALUE))


def opacity_edges_filled(spark, d):
    """The view of a run that stops after its ninth round."""
    return _opacity(spark, d).edges(before=BEFORE_ROUND).select(
        S.COMPANY, S.OWNER, _r6(S.CAPITAL), _r6(S.SEED_VALUE))


def opacity_index_notebook_rounds(spark, d):
    """The companies that a run of so many rounds completes."""
    return _companies(spark, d).filter(F.col(prop.ITER) <= NOTEBOOK_ROUNDS).select(
        S.TAXPAYER, _r6(prop.VALUE), prop.ITER)


def result_lookup(spark, d):
    found = q.entity_lookup(_companies(spark, d), prefix=RESULT_PREFIX, columns=(S.TAXPAYER,))
    return found.select(S.TAXPAYER, _r6(prop.VALUE), prop.ITER)


def incomplete_companies(spark, d):
    return prop.incomplete_companies(_opacity(spark, d).edges())


def single_owner_check(spark, d):
    clean = Workspace(spark, "checked").materialize(_clean(spark, d), "edges")  # read three times
    seed = fixture.seed(spark, d)
    round0 = prop.opacity_index(clean, seed).filter(F.col(prop.ITER) == 0)
    return prop.single_owner_check(clean, seed, round0).select(
        S.COMPANY, S.OWNER, S.CAPITAL, _r6("Oscuridad_PJ"), "Oscuridad_PN", "Comp")


# ---------------------------------------------------------------- owners

def _long(c: str) -> F.Column:
    """Path counts are decimals; those of the test tables fit 64 bits."""
    return F.col(c).cast("bigint").alias(c)


def ultimate_owners(spark, d):
    return _owners(spark, d).select(S.COMPANY, S.OWNER, S.TAXPAYER, _long(own.PATHS), own.ABOVE_CYCLE)


def companies_per_person(spark, d):
    return own.companies_per_person(_owners(spark, d)).select(S.TAXPAYER, _long("SOCIEDADES_RELACIONADAS"))


def owner_pool(spark, d):
    return own.owner_pool(_owners(spark, d)).select(S.COMPANY, _long("TOTAL"), _long("NONULOS"), "eligible")


def owner_pool_distinct(spark, d):
    """O-15 over distinct owners, with the companies above ownership cycles."""
    return own.owner_pool(_owners(spark, d), distinct=True)


def owner_pool_small(spark, d):
    return owner_pool(spark, d).filter(F.col("TOTAL") <= SMALL_POOL)


def companies_per_person_distinct(spark, d):
    return own.companies_per_person(_owners(spark, d), distinct=True)


def co_owner_pairs(spark, d):
    owners = _owners(spark, d)
    members = own.pool_members(owners, own.owner_pool(owners))
    pairs = own.co_owner_pairs(members, _relations(spark, d))
    return pairs.select(S.COMPANY, "RUT_SOCIO_1", "RUT_SOCIO_2", _long("n_pairs"))


def ego_network(spark, d):
    return own.ego_network(_clean(spark, d), EGO_ENTITIES)


# ---------------------------------------------------------------- family

def family_relations(spark, d):
    return _relations(spark, d)


def family_closure(spark, d):
    return fam.family_closure(fam.family_closure_levels(fixture.family(spark, d), hops=4))


def family_closure_sizes(spark, d):
    return fam.closure_sizes(fam.family_closure_levels(fixture.family(spark, d), hops=4))


def family_reach_sizes(spark, d):
    return fam.reach_sizes(fixture.family(spark, d), hops=4)


def family_index(spark, d):
    out = fam.family_index(_owners(spark, d), _relations(spark, d))
    return out.select(S.COMPANY, "FAMILIARES", _long("TOTAL"), _r6("TASA_FAMILIARIDAD"))


def family_index_variant(spark, d):
    out = fam.family_index(_owners(spark, d), _relations(spark, d),
                           unrelated_fill="null", distinct_pool=True, with_eligible=True)
    return out.select(S.COMPANY, "FAMILIARES", "TOTAL", _r6("TASA_FAMILIARIDAD"), "eligible")


def family_index_closure(spark, d):
    """O-19 over pairs related within four relations; companies without such a pair are absent."""
    pairs = fam.family_closure(fam.family_closure_levels(fixture.family(spark, d), hops=4))
    out = fam.family_index(_owners(spark, d), pairs, unrelated_fill="drop")
    return out.select(S.COMPANY, "FAMILIARES", _long("TOTAL"), _r6("TASA_FAMILIARIDAD"))


def family_closure_two_hops(spark, d):
    levels = fam.family_closure_levels(fixture.family(spark, d), hops=2,
                                       exclude_id=CLOSURE_EXCLUDE)
    return fam.family_closure(levels)


def relation_types(spark, d):
    return fam.relation_types(fixture.family(spark, d))


def relative_degree(spark, d):
    return fam.relative_degree(fixture.family(spark, d))


# ---------------------------------------------------------------- report

def describe_scores(spark, d):
    return rep.describe_scores(_companies(spark, d)).select("variable", "stat", _r6("value"))


def _described(df):
    return df.select("variable", "stat", _r6("value"))


def describe_high_opacity(spark, d):
    return _described(rep.describe(rep.high_opacity(_companies(spark, d), HIGH_THRESHOLD),
                                   (prop.VALUE, prop.ITER)))


def describe_family(spark, d):
    index = Workspace(spark, "describe").materialize(
        fam.family_index(_owners(spark, d), _relations(spark, d)), "family_index")
    return _described(rep.describe(index, ("FAMILIARES", "TOTAL", "TASA_FAMILIARIDAD")))


def describe_anomalies(spark, d):
    return _described(rep.describe(q.capital_anomalies(_dedup(spark, d)), ("CAPITAL", "UTILIDADES")))


def completion_rate(spark, d):
    run = _opacity(spark, d)
    return rep.completion_rate(run.edges(), run.companies).select(
        "companies", "completed", _r6("pct"))


def high_opacity(spark, d):
    return rep.high_opacity(_companies(spark, d), threshold=HIGH_THRESHOLD).select(
        S.TAXPAYER, _r6(prop.VALUE), prop.ITER)


def high_opacity_top(spark, d):
    return rep.high_opacity(_companies(spark, d), threshold=0.0, k=TOP_K).select(
        S.TAXPAYER, _r6(prop.VALUE), prop.ITER)


def opacity_exact_one(spark, d):
    return rep.high_opacity(_companies(spark, d), exact=1.0).select(
        S.TAXPAYER, _r6(prop.VALUE), prop.ITER)


def _hist(df):
    return df.select("bin", _r6("lo"), _r6("hi"), "count", "cumulative")


def score_histogram(spark, d):
    return _hist(rep.score_histogram(_companies(spark, d), prop.VALUE, bins=10))


def iterations_histogram(spark, d):
    return _hist(rep.score_histogram(_companies(spark, d), prop.ITER, bins=10))


def high_score_histogram(spark, d):
    where = f"{prop.VALUE} >= {HIGH_THRESHOLD}"
    return _hist(rep.score_histogram(_companies(spark, d), prop.VALUE, bins=10, where=where))


def score_by_round(spark, d):
    return rep.score_by_round(_companies(spark, d), bins=30)


# ---------------------------------------------------------------- whole job

def _job(spark, d, output):
    space = Workspace(spark, "job_output")
    run_job(_raw(spark, d), fixture.seed(spark, d), fixture.family(spark, d), space.path("out"))
    return spark.read.parquet(space.path("out", output))


def job_companies(spark, d):
    return _job(spark, d, "opacity_companies").select(S.TAXPAYER, _r6(prop.VALUE), prop.ITER)


def job_family_index(spark, d):
    return _job(spark, d, "family_index").select(
        S.COMPANY, "FAMILIARES", _long("TOTAL"), _r6("TASA_FAMILIARIDAD"))


QUERIES: dict[str, Query] = {
    "load_edges": load_edges,
    "write_round_trip": write_round_trip,
    "clean_edges": clean_edges,
    "clean_edges_profit": clean_edges_profit,
    "clean_edges_no_anomalies": clean_edges_no_anomalies,
    "null_share_rows": null_share_rows,
    "zero_share_profile": zero_share_profile,
    "out_of_range_shares": out_of_range_shares,
    "duplicate_edges": duplicate_edges,
    "pair_multiplicity": pair_multiplicity,
    "composition_totals": composition_totals,
    "capital_anomalies": capital_anomalies,
    "capital_anomalies_pair_mean": capital_anomalies_pair_mean,
    "entity_lookup_prefix": entity_lookup_prefix,
    "entity_lookup_id": entity_lookup_id,
    "group_coverage": group_coverage,
    "opacity_index": opacity_index,
    "opacity_edges": opacity_edges,
    "opacity_edges_filled": opacity_edges_filled,
    "opacity_index_notebook_rounds": opacity_index_notebook_rounds,
    "incomplete_companies": incomplete_companies,
    "single_owner_check": single_owner_check,
    "ultimate_owners": ultimate_owners,
    "companies_per_person": companies_per_person,
    "owner_pool": owner_pool,
    "owner_pool_small": owner_pool_small,
    "owner_pool_distinct": owner_pool_distinct,
    "companies_per_person_distinct": companies_per_person_distinct,
    "co_owner_pairs": co_owner_pairs,
    "ego_network": ego_network,
    "family_relations": family_relations,
    "family_closure": family_closure,
    "family_closure_sizes": family_closure_sizes,
    "family_index": family_index,
    "family_index_variant": family_index_variant,
    "family_closure_two_hops": family_closure_two_hops,
    "relation_types": relation_types,
    "relative_degree": relative_degree,
    "describe_scores": describe_scores,
    "completion_rate": completion_rate,
    "high_opacity": high_opacity,
    "high_opacity_top": high_opacity_top,
    "opacity_exact_one": opacity_exact_one,
    "score_histogram": score_histogram,
    "iterations_histogram": iterations_histogram,
    "high_score_histogram": high_score_histogram,
    "score_by_round": score_by_round,
    "load_seed": load_seed,
    "load_edges_rejects": load_edges_rejects,
    "load_edges_accepted": load_edges_accepted,
    "sorted_lookup": sorted_lookup,
    "last_edges": last_edges,
    "family_reach_sizes": family_reach_sizes,
    "load_family": load_family,
    "load_groups": load_groups,
    "profit_anomalies": profit_anomalies,
    "group_coverage_raw": group_coverage_raw,
    "result_lookup": result_lookup,
    "family_index_closure": family_index_closure,
    "describe_high_opacity": describe_high_opacity,
    "describe_family": describe_family,
    "describe_anomalies": describe_anomalies,
    "job_companies": job_companies,
    "job_family_index": job_family_index,
}
