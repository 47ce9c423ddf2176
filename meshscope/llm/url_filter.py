"""URL filters: rules first, link-graph propagation for the rest.

A rule fits its host and all subdomains, if the url's path starts with the
rule's; the longest rule wins.  Hosts with allowed urls are trusted seeds, hosts
with blocked ones distrusted seeds.  Personalised PageRank carries trust along
the links between hosts and distrust against them (who links to a bad host is
suspect).  A url without a rule is blocked if its host's distrust exceeds its
trust and the threshold.

Links are grouped to host edges before any shuffle of rows; ranks are tables of
one row per host, written in every round, so that both sides of a round's join are
plain scans and AQE can split a host with very many links.  The rounds end when no
rank moves by more than ``SETTLED``; the change of all ranks shrinks by the
damping in every round, so they do end.

Defined results: a null url or one without ``://`` has empty host and path, no
rule, and is allowed; a null html has no links; a host without seeds near it is
allowed; repeated rows get equal verdicts; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshscope.llm.common import column
from meshscope.llm.html_extract import host_of
from meshscope.plans.iterate import Workspace

#: (verdict, host, path)
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DAMPING = 0.85
THRESHOLD = 1e-6
SETTLED = 1e-9  # ranks are rounded to 9 places


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None)
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(
            fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        ).otherwise(found)
    return found


def host_edges(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(src, dst, links): absolute links between different hosts, counted."""
    links = F.regexp_extract_all(
        column(html_col), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"), F.lit(1)
    )
    targets = F.transform(
        links, lambda x: host_of(F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x))
    )
    return (
        pages.select(host_of(column(url_col)).alias("src"), F.explode(targets).alias("dst"))
        .filter("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def seeds(judged: DataFrame) -> DataFrame:
    """(host, kind, seed): the share of a host's urls that rules allow (trust) or block (distrust)."""
    counts = judged.filter("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).alias("urls"),
        F.count_if(F.col("fit.verdict") == "allow").alias("trust"),
        F.count_if(F.col("fit.verdict") == "block").alias("distrust"),
    )
    return counts.select(
        "host",
        "urls",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("urls")).alias("seed"))
                    for k in ("trust", "distrust")
                ]
            )
        ),
    ).filter("seed > 0").select("host", "kind", "seed")


def propagate(start: DataFrame, edges: DataFrame, space: Workspace, settled: float = SETTLED) -> DataFrame:
    """(host, kind, rank): personalised PageRank of both kinds.

    Trust moves from src to dst, distrust from dst to src, each host sharing its
    rank among its links by their counts, until no rank moves by more than ``settled``.
    """
    out = space.materialize(edges.groupBy("src").agg(F.sum("links").alias("total")), "out")
    into = space.materialize(edges.groupBy("dst").agg(F.sum("links").alias("total")), "into")
    moves = space.materialize(
        edges.join(out, "src")
        .select(F.col("src").alias("host"), F.lit("trust").alias("kind"), F.col("dst").alias("to"), (F.col("links") / F.col("total")).alias("part"))
        .unionByName(
            edges.join(into, "dst").select(
                F.col("dst").alias("host"), F.lit("distrust").alias("kind"), F.col("src").alias("to"), (F.col("links") / F.col("total")).alias("part")
            )
        ),
        "moves",
    )
    ranks = start.withColumnRenamed("seed", "rank")
    if moves.isEmpty():
        return ranks
    none = F.lit(0.0)
    restart = start.select("host", "kind", ((1 - DAMPING) * F.col("seed")).alias("rank"), none.alias("before"))
    for k in count(1):
        moved = ranks.join(moves, ["host", "kind"]).select(
            F.col("to").alias("host"),
            "kind",
            (DAMPING * F.col("rank") * F.col("part")).alias("rank"),
            none.alias("before"),
        )
        old = ranks.select("host", "kind", none.alias("rank"), F.col("rank").alias("before"))
        summed = (
            restart.unionByName(moved)
            .unionByName(old)
            .groupBy("host", "kind")
            .agg(F.sum("rank").alias("rank"), F.sum("before").alias("before"))
        )
        made, seen = space.materialize_observed(
            summed, (f"ranks-{k}",), change=F.max(F.abs(F.col("rank") - F.col("before")))
        )
        ranks = made.select("host", "kind", "rank")
        space.drop(f"ranks-{k - 1}")
        if (seen["change"] or 0.0) <= settled:
            return ranks


def judge_urls(
    pages: DataFrame,
    rules=RULES,
    url_col: str = "url",
    html_col: str = "html",
    keep: list[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` of each url."""
    space = Workspace(pages.sparkSession, "url_filter")
    keep = list(pages.columns if keep is None else keep)
    judged = pages.select(
        F.struct(*[column(c) for c in keep]).alias("row"),
        host_of(column(url_col)).alias("host"),
        path_of(column(url_col)).alias("path"),
    ).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    start = space.materialize(seeds(judged), "seeds")
    edges = space.materialize(host_edges(pages, html_col, url_col), "edges")
    ranks = propagate(start, edges, space)
    hosts = space.materialize(
        ranks.groupBy("host").agg(
            F.round(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)), 9).alias("trust"),
            F.round(F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)), 9).alias("distrust"),
        ),
        "hosts",
    )
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    by_graph = F.when((distrust > trust) & (distrust > threshold), "block").otherwise("allow")
    return judged.join(hosts, "host", "left").select(
        "row",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", by_graph).alias("verdict"),
        trust.alias("trust"),
        distrust.alias("distrust"),
    )
