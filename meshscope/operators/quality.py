"""Cleaning and data-quality profile of the ownership edge list (O-03 .. O-10).

All operators are single-pass DataFrame plans: a filter, or one grouped
aggregation.  Raw rows are shuffled by (company, owner) at most, other groups after a
partial (map-side) step, so hub companies or owners never concentrate raw rows in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshscope.plans.iterate import Workspace
from meshscope.sources import schemas as S

EDGE_COLUMNS = [S.COMPANY, S.OWNER, S.CAPITAL, S.PROFIT]


def dedup_edges(raw: DataFrame) -> DataFrame:
    """Distinct (company, owner, capital, profit) rows.

    Dedup is on the whole 4-tuple, so one (company, owner) pair may keep
    several rows with different shares.  Rows are dealt by pair, so what is
    grouped by pair afterwards needs no further shuffle.
    """
    return raw.select(*EDGE_COLUMNS).repartition(S.COMPANY, S.OWNER).distinct()


def clean_edges(
    raw: DataFrame,
    share: str = "capital",
    filter_anomalous: bool = False,
    lo: float = 95.0,
    hi: float = 105.0,
) -> DataFrame:
    """O-03: deduplicated edges with a non-zero share.

    ``share != 0`` is evaluated in SQL three-valued logic, so rows with a
    NULL share are dropped as well.  ``share='profit'`` filters on the profit
    column instead.  With ``filter_anomalous`` companies whose capital total
    lies outside [lo, hi] are removed (they are only reported by default).
    """
    column = {"capital": S.CAPITAL, "profit": S.PROFIT}[share]
    deduped = dedup_edges(raw)
    out = deduped.filter(F.col(column) != 0)
    if filter_anomalous:
        # Written first: the anti-join then reads a plain table and can be split.
        bad = Workspace(raw.sparkSession, "anomalies").materialize(
            capital_anomalies(deduped, lo=lo, hi=hi).select(S.COMPANY), "companies"
        )
        out = out.join(bad, S.COMPANY, "left_anti")
    return out


def null_share_rows(raw: DataFrame) -> DataFrame:
    """O-04: rows whose capital or profit share is NULL."""
    return raw.select(*EDGE_COLUMNS).filter(F.col(S.CAPITAL).isNull() | F.col(S.PROFIT).isNull())


def zero_share_profile(edges: DataFrame) -> DataFrame:
    """O-05: one row of counts of zero shares."""
    cap0 = F.col(S.CAPITAL) == 0
    pro0 = F.col(S.PROFIT) == 0
    return edges.agg(
        F.count_if(cap0 | pro0).alias("any_zero"),
        F.count_if(cap0 & pro0).alias("both_zero"),
        F.count_if(cap0 & (F.col(S.PROFIT) != 0)).alias("only_capital_zero"),
        F.count_if((F.col(S.CAPITAL) != 0) & pro0).alias("only_profit_zero"),
    )


def out_of_range_shares(edges: DataFrame, lo: float = 0.0, hi: float = 100.0) -> DataFrame:
    """O-06: rows with a share below ``lo`` or above ``hi``."""
    def outside(c: str):
        return (F.col(c) < lo) | (F.col(c) > hi)

    return edges.select(*EDGE_COLUMNS).filter(outside(S.CAPITAL) | outside(S.PROFIT))


def duplicate_edges(raw: DataFrame, min_count: int = 2) -> DataFrame:
    """O-07: repeated 4-tuples with their multiplicity ``c``."""
    return (
        raw.groupBy(*EDGE_COLUMNS)
        .agg(F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") >= min_count)
    )


def pair_multiplicity(edges: DataFrame, min_count: int = 1) -> DataFrame:
    """O-07: rows per (company, owner) pair; ``min_count=2`` keeps repeated pairs."""
    return (
        edges.groupBy(S.COMPANY, S.OWNER)
        .agg(F.count(F.lit(1)).alias("c"))
        .filter(F.col("c") >= min_count)
    )


def pair_means(edges: DataFrame, with_profit: bool = False) -> DataFrame:
    """Mean share per (company, owner): repeated pairs collapse to one edge."""
    aggs = [F.avg(S.CAPITAL).alias(S.CAPITAL)]
    if with_profit:
        aggs.append(F.avg(S.PROFIT).alias(S.PROFIT))
    return edges.groupBy(S.COMPANY, S.OWNER).agg(*aggs)


def composition_totals(edges: DataFrame, pair_mean: bool = False) -> DataFrame:
    """O-08: capital and profit totals per company.

    ``pair_mean=True`` first averages repeated (company, owner) pairs, as the
    opacity job does; the cleaning job sums the deduplicated rows.
    """
    base = pair_means(edges, with_profit=True) if pair_mean else edges
    return base.groupBy(S.COMPANY).agg(
        F.sum(S.CAPITAL).alias("CAPITAL"), F.sum(S.PROFIT).alias("UTILIDADES")
    )


def capital_anomalies(
    edges: DataFrame,
    lo: float = 95.0,
    hi: float = 105.0,
    pair_mean: bool = False,
    column: str = "CAPITAL",
) -> DataFrame:
    """O-08: companies whose total (capital by default) is above ``hi`` or below ``lo``."""
    totals = composition_totals(edges, pair_mean=pair_mean)
    return totals.filter((F.col(column) > hi) | (F.col(column) < lo))


def entity_lookup(
    df: DataFrame,
    prefix: str | None = None,
    entity: str | None = None,
    columns: Sequence[str] = (S.COMPANY,),
) -> DataFrame:
    """O-09: rows where any of ``columns`` starts with ``prefix`` or equals ``entity``.

    A prefix is matched literally (no wildcard characters), so it is a
    pushed-down ``StartsWith`` filter on the scan.
    """
    if (prefix is None) == (entity is None):
        raise ValueError("give exactly one of prefix / entity")
    cond = None
    for c in columns:
        test = F.col(c).startswith(prefix) if prefix is not None else F.col(c) == entity
        cond = test if cond is None else (cond | test)
    return df.filter(cond)


def group_coverage(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """O-10: how many known groups appear as companies of the edge list.

    One row: ``groups`` (distinct group rows), ``matched_edges`` (edge rows
    joined, i.e. the fan-out count) and ``matched_groups`` (distinct group
    ids with at least one edge).  Edges are counted per company before the
    join, so the join sees one row per company.
    """
    g = groups.select(S.GROUP_ID, S.GROUP_LABEL).distinct()
    per_company = edges.groupBy(F.col(S.COMPANY).alias(S.GROUP_ID)).agg(
        F.count(F.lit(1)).alias("n_edges")
    )
    joined = g.join(per_company, S.GROUP_ID, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("n_edges"), F.lit(0)).cast("bigint").alias("matched_edges"),
        F.count_distinct(F.when(F.col("n_edges").isNotNull(), F.col(S.GROUP_ID))).alias(
            "matched_groups"
        ),
    )
