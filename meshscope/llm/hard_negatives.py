"""Hard negatives by anchor-clustered shared lists.

The anchors (query rows) are dealt into groups of about ``ANCHORS``, each clustered
once by direction (k-means on the sphere).  For an anchor u in a cluster with
centroid c, whose members lie at most an angle b from c, a row x at the angle t
from c has a product of at most |u| |x| cos(max(0, t - b)).  Without |u| this bound
is the same for the whole cluster: the rows of a block are sorted by it once, and
every member walks that list, in pages, until no row further on can enter its
result: it has its k rows and the last of them is above the bound, or the bound is
below all that it asks for.  The walk is exact; the bound only ends it.

Rows are dealt into blocks of about ``ROWS``; a task holds one block and one group
of anchors.  What the blocks return, k rows for each question, meets in a window
over the question.  Two walks are made: one for the positives (rows of the anchor's
label), one for the negatives, whose score must lie in a band below a positive's.

Products are exact: integer components, in doubles while products are below 2**53,
else in Python integers.

Defined results: rows with a null id, label, vector or component, or a component
that is not finite, take no part; equal rows (id, label and vector) count once; rows
of one id are never each other's positive or negative; rows meet only rows with
vectors of the same length; ties go to the smaller id, then label and vector in the
order of their hash; an anchor without positives has no negatives; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.llm.common import column
from meshscope.plans.iterate import Workspace

ROWS = 4096  # rows of a block
BLOCKS = 32  # blocks at least, so that small tables are spread out as well
ANCHORS = 4096  # anchors of a group
CLUSTERS = 16  # of the anchors of a group
PAGE = 256  # rows of a list that are scored at once
_SLACK = 1e-6  # of the floating bound

Walked = tuple[np.ndarray, np.ndarray, np.ndarray]  # question, row of the block, score


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1.0)


def clusters_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Cluster numbers of rows by direction: k-means from rows picked far from one another."""
    x = unit(x)
    centres = x[:1]
    near = x @ centres[0]
    for _ in range(1, min(k, len(x))):
        centres = np.concatenate([centres, x[[int(near.argmin())]]])
        near = np.maximum(near, x @ centres[-1])
    for _ in range(rounds):
        found = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, found, x)
        new = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, unit(sums), centres)
        if np.allclose(new, centres):
            break
        centres = new
    return (x @ centres.T).argmax(axis=1)


def bounds(members: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row the most that its product with a member can be, over the member's length."""
    directions = unit(members)
    centre = unit(directions.sum(axis=0, keepdims=True))[0]
    wide = np.arccos(np.clip(directions @ centre, -1, 1)).max()
    if not (members != 0).any(axis=1).all():
        wide = np.pi  # a zero member has no direction
    angle = np.arccos(np.clip(unit(rows) @ centre, -1, 1))
    return np.linalg.norm(rows, axis=1) * np.cos(np.maximum(0.0, angle - wide))


def products(members: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact products of integer vectors: (members, rows)."""
    most = np.abs(members).max(initial=0.0) * np.abs(rows).max(initial=0.0) * max(1, members.shape[1])
    if most < 2**53:
        return (members @ rows.T).astype(np.int64)
    whole = [np.vectorize(int, otypes=[object])(a) if a.size else a.astype(object) for a in (members, rows)]
    return (whole[0] @ whole[1].T).astype(np.int64)  # OverflowError beyond 64 bits


def walk(members, member_of, allowed, low, high, rows, ids, order, k) -> Walked:
    """The first k rows of each question, best score first, then by ``order``.

    Question j asks, for member ``member_of[j]``, for rows with ``allowed(member, rows)``
    and a score of ``low[j]`` to ``high[j]``.  The rows are sorted by their bound once.
    """
    bound = bounds(members, rows)
    sequence = np.lexsort((order, -bound))
    rows, ids, order, bound = rows[sequence], ids[sequence], order[sequence], bound[sequence]
    slack = _SLACK * (np.abs(bound).max(initial=0.0) + 1.0)
    length = np.linalg.norm(members, axis=1)[member_of]
    n = len(member_of)
    none = np.iinfo(np.int64).min
    best = np.full((n, k), none)
    place = np.full((n, k), -1)
    active = np.arange(n)
    for start in range(0, len(rows), PAGE):
        # Certified: the last of k rows, or all that is asked for, is above what may still come.
        most = (bound[start] + slack) * length[active]
        active = active[~((best[active, -1] > most) | (low[active] > most))]
        if not len(active):
            break
        page = slice(start, min(len(rows), start + PAGE))
        asking, back = np.unique(member_of[active], return_inverse=True)
        score = products(members[asking], rows[page])
        fit = allowed(asking, sequence[page])
        score, fit = score[back], fit[back]
        fit = fit & (score >= low[active, None]) & (score <= high[active, None]) & (score >= best[active, -1:])
        hit = fit.any(axis=1)
        if not hit.any():
            continue
        who = active[hit]
        value = np.concatenate([best[who], np.where(fit[hit], score[hit], none)], axis=1)
        where = np.concatenate(
            [place[who], np.broadcast_to(np.arange(page.start, page.stop), (len(who), page.stop - page.start))], axis=1
        )
        # best scores first; among equal ones the least in order (places not taken come last)
        rank = np.where(value == none, np.iinfo(np.int64).max, order[where])
        # ~value: its order is the reverse of value's, without overflow
        top = np.lexsort((rank, ~value), axis=1)[:, :k]
        best[who] = np.take_along_axis(value, top, axis=1)
        place[who] = np.where(best[who] == none, -1, np.take_along_axis(where, top, axis=1))
    question, column_ = np.nonzero(best != none)
    return question, sequence[place[question, column_]], best[question, column_]


def _vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(table.num_rows, -1)


def _same(a: pa.Table, b: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column in both tables as numbers, equal for equal values."""
    both = pa.concat_arrays([*a.column(name).chunks, *b.column(name).chunks]).dictionary_encode().indices.to_numpy()
    return both[: a.num_rows], both[a.num_rows :]


def keys_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _order(table: pa.Table) -> np.ndarray:
    """Places of the rows by id, then by the hash of the row."""
    place = np.empty(table.num_rows, dtype=np.int64)
    place[np.lexsort((table.column("h").to_numpy(), table.column("id").to_numpy()))] = np.arange(table.num_rows)
    return place


def _walk_block(anchors: pa.Table, rows: pa.Table, k: int, positive: bool) -> pa.Table:
    """The block's rows for every question of the group's anchors (one each, or one a band)."""
    vectors, members = _vectors(rows), _vectors(anchors)
    labels, row_labels = _same(anchors, rows, "label")
    keys, row_keys = _same(anchors, rows, "id")
    order, ids = _order(rows), keys_of(rows, "id")
    cluster = anchors.column("cluster").to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for c in np.unique(cluster):
        own = np.flatnonzero(cluster == c)
        if positive:
            member_of = np.arange(len(own))
            low, high = np.full(len(own), np.iinfo(np.int64).min), np.full(len(own), np.iinfo(np.int64).max)
        else:
            bands = [anchors.column("bands")[int(j)].as_py() for j in own]
            member_of = np.repeat(np.arange(len(own)), [len(b) for b in bands])
            low = np.array([x["low"] for b in bands for x in b], dtype=np.int64)
            high = np.array([x["high"] for b in bands for x in b], dtype=np.int64)

        def allowed(asking, page, own=own):
            same = labels[own[asking]][:, None] == row_labels[page][None, :]
            other = keys[own[asking]][:, None] != row_keys[page][None, :]
            return other & (same if positive else ~same)

        question, row, score = walk(members[own], member_of, allowed, low, high, vectors, ids, order, k)
        out.append((own[member_of[question]], low[question], high[question], row, score))
    at, low, high, row, score = (np.concatenate(x) for x in zip(*out))
    made = {"anchor_id": keys_of(anchors, "id")[at], "anchor_hash": keys_of(anchors, "h")[at], "low": low, "high": high}
    return pa.table(made | {"row_id": ids[row], "row_hash": keys_of(rows, "h")[row], "score": score})


QUESTION = ["anchor_id", "anchor_hash", "low", "high"]
_FOUND = [*QUESTION, "row_id", "row_hash", "score"]


def _search(anchors: DataFrame, rows: DataFrame, groups: int, blocks: int, k: int, positive: bool) -> DataFrame:
    """The first k rows of each question over all blocks, numbered ``rank``."""
    spread = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in _FOUND})
        return _walk_block(left, right, k, positive)

    key = ["size", "block", "g"]
    schema = ", ".join(f"{n} long" for n in _FOUND)
    found = asked.groupBy(*key).cogroup(spread.groupBy(*key)).applyInArrow(run, schema)
    first = W.partitionBy(*QUESTION).orderBy(F.desc("score"), "row_id", "row_hash")
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _hundredths(score: Column, share: int, up: bool) -> Column:
    """``share`` hundredths of a whole score, rounded up or down."""
    x = -share * score if up else share * score
    down = ((x - F.pmod(x, F.lit(100))) / 100).cast("long")
    return -down if up else down


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 5,
    band: tuple[int, int] = (80, 100),
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    The rows of ``vectors`` with ``is_anchor`` (over its columns) ask; vectors hold
    integer numbers.  A negative's score lies between ``band`` hundredths of the
    positive's, both included.
    """
    space = Workspace(vectors.sparkSession, "hard_negatives")
    vector = column(vector_col).cast("array<double>")
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        column(id_col).cast("long").alias("id"),
        column(label_col).alias("label"),
        vector.alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole)
    rows = rows.groupBy("id", "label", "vector").agg(F.max("asks").alias("asks"))
    rows, seen = space.materialize_observed(
        rows.select("*", F.size("vector").alias("size"), F.xxhash64("label", "vector").alias("h")),
        ("rows",),
        n=F.count(F.lit(1)),
        asks=F.count_if("asks"),
    )
    blocks = max(BLOCKS, -(-seen["n"] // ROWS))
    groups = max(1, -(-seen["asks"] // ANCHORS))
    dealt = rows.select(
        "id", "label", "vector", "size", "h", F.pmod(F.xxhash64("id", "h"), F.lit(blocks)).cast("int").alias("block")
    )
    asking = rows.filter("asks").select(
        "id", "label", "vector", "size", "h",
        F.pmod(F.xxhash64("h", "id"), F.lit(groups)).cast("int").alias("g"),
    )

    def cluster(group: pa.Table) -> pa.Table:
        found = clusters_of(_vectors(group), CLUSTERS) if group.column("size")[0].as_py() else [0] * group.num_rows
        return group.append_column("cluster", pa.array(found, pa.int32()))

    schema = T.StructType([*asking.schema.fields, T.StructField("cluster", T.IntegerType())])
    anchors = space.materialize(asking.groupBy("size", "g").applyInArrow(cluster, schema), "anchors")
    best = space.materialize(_search(anchors, dealt, groups, blocks, positives, True), "positives")
    best = best.select(
        "anchor_id",
        "anchor_hash",
        F.col("row_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        _hundredths(F.col("score"), band[0], True).alias("low"),
        _hundredths(F.col("score"), band[1], False).alias("high"),
    ).filter("low <= high")
    bands = space.materialize(
        best.groupBy("anchor_id", "anchor_hash").agg(F.collect_set(F.struct("low", "high")).alias("bands")), "bands"
    )
    asked = space.materialize(
        anchors.join(bands, (anchors["id"] == bands["anchor_id"]) & (anchors["h"] == bands["anchor_hash"])).drop(
            "anchor_id", "anchor_hash"
        ),
        "asked",
    )
    worst = _search(asked, dealt, groups, blocks, negatives, False)
    return best.join(worst, QUESTION).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("row_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
