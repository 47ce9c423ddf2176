"""Opacity propagation through the ownership mesh (O-11, O-12, O-20, O-22).

Semantics
---------
Edges are the clean edge list with repeated (company, owner) pairs
collapsed to their mean capital ``w``.  Each edge carries an owner score
``v``: the seed score of the owner when the seed has one (a seed score wins
even when the owner is a company), else the computed score of the owner
company once it is known.  A company is *complete* when none of its edges
lacks a score; its value is the capital-weighted mean ``sum(w*v) / sum(w)``
(NULL for a zero capital total).  Round 0 uses seed scores only; round k
also uses companies completed in rounds < k.  ``iterations`` is the round
in which a company completed.  Companies on an unseeded ownership cycle, or
with an owner that never gets a score, never complete and are absent.

Plan
----
* ``edges``: pair means joined once with the seed (one pass over the raw edge
  list; written).  Cleaning deals the rows by pair, so the means need no shuffle.
* ``state``: per company ``(sum w*v, sum w, open edge count)`` over the edges
  with a seed score; companies without an open edge are complete in round 0.
* A company with one open edge has a value that depends on that owner alone:
  ``a + b * value(owner)``.  Such *chain* companies point to their owner, and
  the pointers are followed by doubling (``plans.chains``), which composes the
  affine maps and counts the steps: a chain of n companies takes log2(n)
  rounds, whatever its depth.
* ``pending``: the open edges of the other companies, redirected from a chain
  company to the end of its chain (fixed; written once, bucketed on the owner,
  an owner with more than a fair share salted over several buckets).  Round k
  joins them with the companies completed in the round before and adds the
  matches to the state of the companies they belong to.

The state is log-structured: a round writes the new state of the companies it
touched and no others; the current state of a company is its last version.
When the versions since the last base outnumber the base, a new base of the
companies still open is written.  So what is written follows the touched
edges, not rounds times open companies.  ``iterations`` is carried along as a
value (one more than the largest of the open owners), so it does not depend
on how the rounds fell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshscope.operators.quality import pair_means
from meshscope.plans.chains import Chains, follow
from meshscope.plans.iterate import Workspace
from meshscope.sources import schemas as S

VALUE = "Value"
ITER = "iterations"


def _score():
    """Capital-weighted mean; NULL for a zero capital total."""
    return F.try_divide(F.col("swv"), F.col("sw"))


def unique_seed(seed: DataFrame, workspace: Workspace, on_duplicate: str = "fail") -> DataFrame:
    """Seed scores keyed by a unique, non-NULL ``CONT_RUT``.

    A repeated id would fan out every edge it owns.  With ``'fail'`` the
    checked seed is written first (a repeated id raises there), so the joins
    that follow read a plain table and AQE can split an owner of very many
    edges.  ``'trust'`` skips the check.  NULL ids are dropped: they can never
    match an owner.
    """
    s = seed.select(S.TAXPAYER, S.SEED_VALUE).filter(F.col(S.TAXPAYER).isNotNull())
    if on_duplicate == "trust":
        return s
    if on_duplicate != "fail":
        raise ValueError("on_duplicate must be 'fail' or 'trust'")
    g = s.groupBy(S.TAXPAYER).agg(
        F.count(F.lit(1)).alias("_n"), F.first(S.SEED_VALUE).alias(S.SEED_VALUE)
    )
    message = F.concat(F.lit("seed has repeated CONT_RUT values, e.g. "), F.col(S.TAXPAYER))
    checked = g.filter(F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.lit(True)))
    return workspace.materialize(checked.select(S.TAXPAYER, S.SEED_VALUE), "seed")


@dataclass
class OpacityRun:
    """Materialized result of one propagation run."""

    workspace: Workspace
    scored_edges: DataFrame  # c, o, w, seed v
    companies: DataFrame  # CONT_RUT, Value, iterations
    rounds: int  # the last round that completed a company

    def edges(self, before: int | None = None) -> DataFrame:
        """O-12: every edge with its owner's score.

        ``before`` gives the view of a bounded run: only owners completed in
        rounds ``0 .. before - 1`` have a score.
        """
        done = self.companies if before is None else self.companies.filter(F.col(ITER) < before)
        done = done.select(F.col(S.TAXPAYER).alias("_o"), F.col(VALUE).alias("_V"))
        e = self.scored_edges
        return e.join(done, e[S.OWNER] == done["_o"], "left").select(
            S.COMPANY,
            S.OWNER,
            S.CAPITAL,
            F.coalesce(F.col("v"), F.col("_V")).alias(S.SEED_VALUE),
        )


def run_opacity(
    edges: DataFrame,
    seed: DataFrame,
    max_rounds: int | None = None,
    on_duplicate: str = "fail",
    workspace: Workspace | None = None,
    _hot_rows: int | None = None,
) -> OpacityRun:
    """Propagate to the fixed point; return the written tables (see module doc).

    ``edges`` are clean edges (O-03), ``seed`` person scores.  The loop ends
    when a round completes no company.  With ``max_rounds`` a run that would
    need more rounds raises instead of returning a part of the result.
    """
    spark = edges.sparkSession
    ws = workspace or Workspace(spark, "opacity", many_keys=True)
    s = unique_seed(seed, ws, on_duplicate)
    w = pair_means(edges)
    scored = ws.materialize(
        w.join(s, w[S.OWNER] == s[S.TAXPAYER], "left").select(
            S.COMPANY, S.OWNER, S.CAPITAL, F.col(S.SEED_VALUE).alias("v")
        ),
        "edges",
    )

    cap, v = F.col(S.CAPITAL), F.col("v")
    is_open = v.isNull()
    # Numbers only: an aggregate over ids would sort all edges.
    state = ws.materialize(
        scored.groupBy(S.COMPANY).agg(
            F.coalesce(F.sum(cap * v), F.lit(0.0)).alias("swv"),
            F.coalesce(F.sum(F.when(v.isNotNull(), cap)), F.lit(0.0)).alias("sw"),
            F.count_if(is_open).alias("n_open"),
        ),
        "state",
    )
    # The companies with one open edge, and that edge.
    one = state.filter("n_open = 1").select(F.col(S.COMPANY).alias("_c"), "swv", "sw", "n_open")
    single = ws.materialize(
        scored.filter(is_open)
        .join(one, F.col(S.COMPANY).eqNullSafe(F.col("_c")))
        .select(S.COMPANY, F.col(S.OWNER).alias("to"), cap.alias("w"), "swv", "sw", "n_open"),
        "single_open",
    )
    total = F.col("sw") + F.col("w")
    is_chain = F.col("to").isNotNull() & (total != 0)
    chains = follow(
        single.filter(is_chain).select(
            F.col(S.COMPANY).alias("node"),
            "to",
            (F.col("swv") / total).alias("a"),
            (F.col("w") / total).alias("b"),
            F.lit(1).cast("bigint").alias("steps"),
        ),
        ws,
        "chains",
        lambda p, q: {
            "a": p("a") + p("b") * q("a"), "b": p("b") * q("b"), "steps": p("steps") + q("steps")
        },
    )
    first = state.filter("n_open = 0").select(
        F.col(S.COMPANY).alias(S.TAXPAYER), _score().alias(VALUE), F.lit(0).cast("bigint").alias(ITER)
    )
    numbers = [S.COMPANY, "swv", "sw", "n_open"]
    apart = state.filter("n_open > 1").select(*numbers).unionByName(single.filter(~is_chain).select(*numbers))
    closed = _close_open_companies(scored, apart, chains, first, ws, _hot_rows)
    heads = ws.materialize(first.unionByName(closed), "heads")
    known = heads.filter(F.col(VALUE).isNotNull()).withColumnRenamed(S.TAXPAYER, "to")
    along = chains.ended.join(known, "to").select(
        F.col("node").alias(S.TAXPAYER),
        (F.col("a") + F.col("b") * F.col(VALUE)).alias(VALUE),
        (F.col(ITER) + F.col("steps")).alias(ITER),
    )
    companies, seen = ws.materialize_observed(
        heads.unionByName(along).withColumn(ITER, F.col(ITER).cast("int")),
        ("companies",),
        rounds=F.max(ITER),
    )
    rounds = seen["rounds"] or 0
    if max_rounds is not None and rounds > max_rounds:
        raise RuntimeError(f"more than {max_rounds} rounds are needed")
    return OpacityRun(ws, scored, companies, rounds)


def _close_open_companies(
    scored: DataFrame, apart: DataFrame, chains: Chains, first: DataFrame, ws: Workspace, hot_rows
) -> DataFrame:
    """(CONT_RUT, Value, iterations) of the companies ``apart`` from the chains, with their open states.

    ``first`` are the companies complete from the start.
    """
    blank = F.lit(None).cast("bigint").alias(ITER)
    base, seen = ws.materialize_observed(
        apart.select("*", blank),
        ("base", "base=0"),
        rows=F.count(F.lit(1)),
    )
    nothing = first.filter(F.lit(False))
    if not seen["rows"]:
        return nothing
    open_edges = (
        scored.filter(F.col("v").isNull() & F.col(S.OWNER).isNotNull())
        .join(base.select(S.COMPANY), S.COMPANY, "left_semi")
        .select(S.COMPANY, S.OWNER, S.CAPITAL)
    )
    ended = chains.ended.withColumnRenamed("node", S.OWNER)
    cap = F.col(S.CAPITAL)
    pending = ws.materialize_bucketed(
        open_edges.join(ended, S.OWNER, "left").select(
            S.COMPANY,
            F.coalesce("to", S.OWNER).alias("via"),
            F.coalesce(cap * F.col("a"), F.lit(0.0)).alias("aw"),
            F.coalesce(cap * F.col("b"), cap).alias("bw"),
            cap.alias("w"),
            F.coalesce("steps", F.lit(0)).cast("bigint").alias("steps"),
        ),
        "pending",
        key="via",
        spread=S.COMPANY,
        _hot_rows=hot_rows,
    )
    done = (F.col("n_open") == 0) & (F.col("sw") != 0)
    frontier = first.filter(F.col(VALUE).isNotNull())
    base_rows, bases, versions, rows, k = seen["rows"], 0, [], 0, 0
    while True:
        k += 1
        known = frontier.select(F.col(S.TAXPAYER).alias("_o"), F.col(VALUE).alias("_V"), F.col(ITER).alias("_it"))
        delta = (
            pending.join(known, "_o")
            .groupBy(S.COMPANY)
            .agg(
                F.sum(F.col("aw") + F.col("bw") * F.col("_V")).alias("dwv"),
                F.sum("w").alias("dw"),
                F.count(F.lit(1)).alias("dn"),
                F.max(F.col("_it") + F.col("steps")).alias("dit"),
            )
        )
        touched = _states(base, versions, ws).join(ws.materialize(delta, "deltas", f"round={k}"), S.COMPANY)
        columns = ["swv", "sw", "n_open", ITER]
        now = F.max_by(F.struct(*columns), "version").alias("now")
        step = touched.groupBy(S.COMPANY, "dwv", "dw", "dn", "dit").agg(now).select(
            S.COMPANY,
            (F.col("now.swv") + F.col("dwv")).alias("swv"),
            (F.col("now.sw") + F.col("dw")).alias("sw"),
            (F.col("now.n_open") - F.col("dn")).alias("n_open"),
            F.greatest(f"now.{ITER}", "dit").alias(ITER),
        )
        level, seen = ws.materialize_observed(
            step, ("versions", f"version={k}"), closed=F.count_if(done), rows=F.count(F.lit(1))
        )
        versions.append(k)
        rows += seen["rows"]
        if not seen["closed"]:
            break
        frontier = level.filter(done).select(
            F.col(S.COMPANY).alias(S.TAXPAYER), _score().alias(VALUE), (F.col(ITER) + 1).alias(ITER)
        )
        if rows >= base_rows:
            last = F.max_by(F.struct(*columns), "version").alias("now")
            whole = _states(base, versions, ws).groupBy(S.COMPANY).agg(last).select(S.COMPANY, "now.*")
            bases += 1
            base, seen = ws.materialize_observed(
                whole.filter("n_open > 0"), ("base", f"base={bases}"), rows=F.count(F.lit(1))
            )
            base_rows, versions, rows = seen["rows"], [], 0
            if not base_rows:
                break
    ws.drop_tables()
    return (
        ws.read_rounds("versions", "version", k, first=1)
        .filter("n_open = 0")
        .select(F.col(S.COMPANY).alias(S.TAXPAYER), _score().alias(VALUE), (F.col(ITER) + 1).alias(ITER))
    )


def _states(base: DataFrame, versions: list[int], ws: Workspace) -> DataFrame:
    """The base and the versions of the open companies' states since, with their ``version``."""
    found = base.withColumn("version", F.lit(0))
    for k in versions:
        level = ws.spark.read.schema(base.schema).parquet(ws.path("versions", f"version={k}"))
        found = found.unionByName(level.withColumn("version", F.lit(k)))
    return found


def opacity_index(edges: DataFrame, seed: DataFrame, **kw) -> DataFrame:
    """O-11: completed companies ``(CONT_RUT, Value, iterations)``."""
    return run_opacity(edges, seed, **kw).companies


def opacity_edges(edges: DataFrame, seed: DataFrame, before: int | None = None, **kw) -> DataFrame:
    """O-12: edges ``(RUT_SOCIEDAD, RUT_SOCIO, PORCENTAJE_CAPITAL, Valor)``."""
    return run_opacity(edges, seed, **kw).edges(before)


def incomplete_companies(scored_edges: DataFrame) -> DataFrame:
    """O-22: companies left without a score and how many owners lack one.

    Input is the O-12 edge table.  ``N_SOCIOS`` counts owner edges (pairs),
    ``N_FALTANTES`` those whose owner has no score.
    """
    return (
        scored_edges.groupBy(S.COMPANY)
        .agg(
            F.count(F.lit(1)).alias("N_SOCIOS"),
            F.count_if(F.col(S.SEED_VALUE).isNull()).alias("N_FALTANTES"),
        )
        .filter(F.col("N_FALTANTES") > 0)
    )


def single_owner_check(
    edges: DataFrame, seed: DataFrame, scores: DataFrame, tol: float = 1e-9, workspace: Workspace | None = None
) -> DataFrame:
    """O-20: a company with a single owner must carry that owner's score.

    ``scores`` are completed companies (typically round 0).  Output per clean
    edge row of a single-owner company: the company score ``Oscuridad_PJ``,
    the owner's seed score ``Oscuridad_PN`` and ``Comp`` = 1 when they agree
    within ``tol``.
    """
    ws = workspace or Workspace(edges.sparkSession, "single_owner", many_keys=True)
    # Written before it is joined, so the edges of one company can be split.
    single = ws.materialize(
        pair_means(edges)
        .groupBy(S.COMPANY)
        .agg(F.count(S.OWNER).alias("N_SOCIOS"))
        .filter(F.col("N_SOCIOS") == 1)
        .select(S.COMPANY),
        "single",
    )
    sc = scores.select(F.col(S.TAXPAYER).alias(S.COMPANY), F.col(VALUE).alias(S.CHECK_COMPANY))
    sd = seed.select(F.col(S.TAXPAYER).alias(S.OWNER), F.col(S.SEED_VALUE).alias(S.CHECK_OWNER))
    out = (
        edges.select(S.COMPANY, S.OWNER, S.CAPITAL)
        .join(single, S.COMPANY, "left_semi")
        .join(sc, S.COMPANY)
        .join(sd, S.OWNER)
    )
    comp = F.when(F.abs(F.col(S.CHECK_COMPANY) - F.col(S.CHECK_OWNER)) <= tol, 1).otherwise(0)
    return out.select(
        S.COMPANY, S.OWNER, S.CAPITAL, S.CHECK_COMPANY, S.CHECK_OWNER, comp.alias(S.CHECK)
    )
