"""Following pointers: every node of a functional graph and where its chain ends.

Each node points to one other.  A round joins the nodes that still point to a
pointing node with the current rows of those, so the distance covered doubles: a
chain of n nodes takes log2(n) rounds.  Rows that have reached the end of their
chain are written once and never again; only the others are written in the next
round.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshscope.plans.iterate import Workspace

Compose = Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]]


@dataclass
class Chains:
    """``ended``: (node, to, carried columns), ``to`` being no node itself.  ``looped``: those
    whose chain enters a cycle; ``to`` is some node further on."""

    ended: DataFrame
    looped: DataFrame
    rounds: int
    n_ended: int
    n_looped: int


def follow(
    pointers: DataFrame, ws: Workspace, name: str, compose: Compose | None = None, to_cycles: bool = False
) -> Chains:
    """Follow ``pointers`` (node, to, carried columns; one row per node) to the ends of the chains.

    ``pointers`` is read twice and should be a projection of a written table.
    ``compose(a, b)`` gives the carried columns of a step a followed by a step b
    (functions from a column's name to the column).  With ``to_cycles`` the
    ``to`` of looped rows lie on their cycles, and all nodes of the cycles are
    among them.
    """
    carried = [c for c in pointers.columns if c not in ("node", "to")]
    nodes = pointers.select(F.col("node").alias("_n"))
    seen = {"open": F.count_if("open"), "ended": F.count_if(~F.col("open"))}
    level, now = ws.materialize_observed(
        pointers.join(nodes, F.col("to") == F.col("_n"), "left").select(
            "node", "to", *carried, F.col("_n").isNotNull().alias("open")
        ),
        (name, "jump=0"),
        **seen,
    )

    def places(rows: DataFrame) -> int | None:
        return rows.filter("open").select("to").distinct().count() if to_cycles else None

    k, ended, image = 0, now["ended"], None
    while now["open"]:
        k += 1
        active = level.filter("open").alias("a")
        known = ws.read_rounds(name, "jump", k - 1).filter("NOT open").select(*level.columns)
        further = known.unionByName(level.filter("open")).alias("b")
        carry = compose(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}")) if compose else {}
        step = active.join(further, F.col("a.to") == F.col("b.node")).select(
            F.col("a.node").alias("node"),
            F.col("b.to").alias("to"),
            *[carry[c].alias(c) for c in carried],
            F.col("b.open").alias("open"),
        )
        before = now["open"]
        level, now = ws.materialize_observed(step, (name, f"jump={k}"), **seen)
        ended += now["ended"]
        # While a chain that ends is not done, some chain ends in every round; while a way into a
        # cycle is not passed, the nodes pointed to become fewer.
        if now["open"] == before:
            image, last = places(level), image
            if image == last:
                break
    rows = ws.read_rounds(name, "jump", k).filter("NOT open").select("node", "to", *carried)
    return Chains(rows, level.filter("open").select("node", "to", *carried), k, ended, now["open"])


def along(steps: DataFrame, ws: Workspace, name: str) -> tuple[DataFrame, DataFrame]:
    """(node, via): the nodes of each chain from ``node`` on; (node, to): where it ends.  No cycles.

    The nodes at a distance below 2**(k+1) are those below 2**k of the node, and of the one
    2**k steps on.
    """
    found = follow(steps, ws, name)
    level = steps.select("node", F.col("node").alias("via"))
    for k in range(found.rounds):
        ahead = ws.read_rounds(name, "jump", k, first=k).filter("open").select("node", "to")
        further = level.select(F.col("node").alias("to"), "via")
        level = ws.materialize(
            level.unionByName(ahead.join(further, "to").select("node", "via")), f"{name}_along", f"round={k}"
        )
    return level, found.ended.select("node", "to")
