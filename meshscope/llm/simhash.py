"""SimHash near-duplicates: a binary-trie self-join of 64-bit fingerprints.

Equal fingerprints are one trie leaf.  Two leaves are linked if at most
``max_bits`` bits differ.  The join walks pairs of trie nodes of equal depth
together, adds up the differing bits and drops a pair as soon as the sum leaves
its error budget.  To make the budget bite near the root, the trie is built for
each of eight byte rotations of the fingerprint: if the eight byte distances sum
to at most b, some rotation has at most i * b / 8 differing bits in its first i
bytes, for every i (the cycle lemma), so a walk with that rising budget loses no
pair.  With b < 8 the first byte agrees, which is how Spark deals the nodes out.

Inside a task, pairs of subtrees whose leaves are all in one component already
are dropped too; a task therefore returns a spanning forest, not all pairs of a
group.  Components over all tasks come from ``components``.

Defined results: a null text or one without words has fingerprint zero, which is
linked like any other; a null doc_id never is a component's id unless it stands
alone; repeated rows share a component; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.llm.common import append, struct
from meshscope.llm.components import connected_components
from meshscope.plans.iterate import Workspace

BYTES = 8
BITS = 64
SEED = 42
CHUNK = 1 << 16  # shingles counted at a time
FRONTIER = 1 << 20  # node pairs walked at a time
NODE_LEAVES = 1 << 16  # leaves of a first-byte node before it is dealt out at a deeper level
TASK_ROWS = 200_000

# ---- fingerprints ------------------------------------------------------------


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64-bit SimHash of one whole text, unsigned."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII spaces only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(stops), CHUNK):
        hashes = np.array(
            [digest(joined[a:b], SEED) for a, b in zip(starts[k : k + CHUNK], stops[k : k + CHUNK])],
            dtype="<u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    over = 2 * counts > len(stops)
    return int.from_bytes(np.packbits(over, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int, text_col: str = "text", keep=None) -> DataFrame:
    """``row`` (the kept columns) and ``fp``, the fingerprint as a signed long."""

    def make(texts):
        found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return [found.view(np.int64).tolist()]

    return append(docs, text_col, struct(fp=T.LongType()), make, keep)


# ---- the trie walk of one task -----------------------------------------------


def _budget(depth: int, max_bits: int) -> int:
    """Differing bits allowed in the first ``depth`` bits of a rotation."""
    return (-(-depth // BYTES)) * max_bits // BYTES


def _common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    depth = np.zeros(len(x), dtype=np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        high = x >> np.uint64(BITS - step) == 0
        depth += np.where(high, step, 0)
        x = np.where(high, x << np.uint64(step), x)
    return np.where(a == b, BITS, depth)


def _merge(labels: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """``labels`` after joining the labels of the leaves ``left`` with those of ``right``."""
    pairs = np.unique(np.stack([labels[left], labels[right]], axis=1), axis=0)
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    moved = np.arange(labels.max() + 1)
    for x in parent:
        moved[x] = root(x)
    return moved[labels]


def trie_join(blocks: np.ndarray, keys: np.ndarray, max_bits: int) -> np.ndarray:
    """Component label of each leaf; leaves are sorted by (block, key), keys differ in a block.

    Deep branching nodes come first: when the walk pairs the two children of a
    node, the links inside either child are known.
    """
    n = len(keys)
    labels = np.arange(n)
    if n < 2:
        return labels
    shared = np.where(blocks[1:] == blocks[:-1], _common_prefix(keys[1:], keys[:-1]), -1)
    ones = {}

    def split(depth, low, high):
        """Where the run [low, high) of one node turns from bit 0 to bit 1."""
        if depth not in ones:
            bit = (keys >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32)
        return high - (ones[depth][high] - ones[depth][low])

    for depth in range(BITS - 1, -1, -1):
        mid = np.flatnonzero(shared == depth)
        if not len(mid) or _budget(depth + 1, max_bits) < 1:
            continue
        breaks = np.concatenate([[-1], np.flatnonzero(shared < depth), [n - 1]])
        place = np.searchsorted(breaks, mid)
        low, high, mid = breaks[place - 1] + 1, breaks[place] + 1, mid + 1
        change = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        walk = [(depth + 1, np.stack([low, mid, mid, high, np.ones(len(mid), dtype=np.int64)]))]
        while walk:
            level, pairs = walk.pop()
            if pairs.shape[1] > FRONTIER:
                half = pairs.shape[1] // 2
                walk += [(level, pairs[:, :half]), (level, pairs[:, half:])]
                continue
            l1, h1, l2, h2, diff = pairs
            joined = (
                (change[h1 - 1] == change[l1])
                & (change[h2 - 1] == change[l2])
                & (labels[l1] == labels[l2])
            )
            single = (h1 - l1 == 1) & (h2 - l2 == 1) & ~joined
            if single.any():
                a, b = l1[single], l2[single]
                near = np.bitwise_count(keys[a] ^ keys[b]) <= max_bits
                if near.any():
                    found.append((a[near], b[near]))
            go = ~(joined | single)
            if level == BITS or not go.any():
                continue
            l1, h1, l2, h2, diff = pairs[:, go]
            m1, m2 = split(level, l1, h1), split(level, l2, h2)
            below = np.concatenate(
                [
                    np.stack([l1, m1, l2, m2, diff]),
                    np.stack([m1, h1, m2, h2, diff]),
                    np.stack([l1, m1, m2, h2, diff + 1]),
                    np.stack([m1, h1, l2, m2, diff + 1]),
                ],
                axis=1,
            )
            there = (below[1] > below[0]) & (below[3] > below[2])
            below = below[:, there & (below[4] <= _budget(level + 1, max_bits))]
            if below.shape[1]:
                walk.append((level + 1, below))
        if found:
            labels = _merge(labels, *[np.concatenate(x) for x in zip(*found)])
    return labels


# ---- all tasks ---------------------------------------------------------------


def node_pairs(distinct: DataFrame, max_bits: int, deeper: int) -> DataFrame:
    """(block, key): each fingerprint in each rotation, at every pair of nodes it is part of.

    A block is a rotation and a pair of nodes of depth 8 + ``deeper`` that may
    differ in as many of the deeper bits as the budget has at that depth.
    """
    if not 0 <= max_bits < BYTES:
        raise ValueError("max_bits must be below 8, so that some rotation starts with an equal byte")
    flips = [
        m for m in range(1 << deeper) if m.bit_count() <= _budget(BYTES + deeper, max_bits)
    ]
    turned = distinct.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(r).alias("turn"),
                        F.shiftleft("fp", 8 * r)
                        .bitwiseOR(F.shiftrightunsigned("fp", BITS - 8 * r) if r else F.lit(0))
                        .alias("key"),
                    )
                    for r in range(BYTES)
                ]
            )
        ).alias("t")
    ).select("t.*")
    node = F.shiftrightunsigned("key", BITS - BYTES - deeper)
    paired = turned.withColumn("node", node).withColumn(
        "flip", F.explode(F.array(*[F.lit(m).cast("long") for m in flips]))
    )
    other = F.col("node").bitwiseXOR(F.col("flip"))
    return paired.select(
        F.struct(
            "turn", F.least("node", other).alias("a"), F.greatest("node", other).alias("b")
        ).alias("block"),
        "turn",
        "key",
    )


def links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(u, v): fingerprint pairs that connect every component (u is a component's least, v another)."""
    spark = distinct.sparkSession
    leaves = distinct.count()
    deeper = min(8, max(0, (leaves // (256 * NODE_LEAVES)).bit_length()))
    dealt = node_pairs(distinct, max_bits, deeper)
    tasks = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        -(-leaves * BYTES * (1 + deeper) // TASK_ROWS),
    )
    dealt = dealt.select(F.xxhash64("block").alias("block"), "turn", "key").repartition(
        tasks, "block"
    )

    def join(batches):
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        if not rows:
            return
        blocks, turns, keys = (np.concatenate(x) for x in zip(*rows))
        keys = keys.view(np.uint64)
        order = np.lexsort((keys, blocks))
        blocks, turns, keys = blocks[order], turns[order].astype(np.uint64), keys[order]
        labels = trie_join(blocks, keys, max_bits)
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        back = np.uint64(8) * turns
        fp = (keys >> back) | np.where(back == 0, np.uint64(0), keys << ((np.uint64(BITS) - back) % np.uint64(BITS)))
        fp = fp.view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp[labels[moved]]), pa.array(fp[moved])], names=["u", "v"]
        )

    return dealt.mapInArrow(join, "u long, v long")


def near_duplicates(
    docs: DataFrame,
    shingle: int,
    max_bits: int,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: list[str] | None = None,
) -> DataFrame:
    """``row``, ``fp``, ``uid`` (a row number), ``component_id`` and ``first``.

    ``component_id`` is the least id reachable over links; ``first`` marks one
    row of each component, one with that id.
    """
    space = Workspace(docs.sparkSession, "simhash")
    keep = list(dict.fromkeys([*(docs.columns if keep is None else keep), id_col]))
    seen = space.materialize(
        fingerprints(docs, shingle, text_col, keep).withColumn(
            "uid", F.monotonically_increasing_id()
        ),
        "fingerprints",
    )
    own = F.struct(F.col("row")[id_col].isNull().alias("none"), F.col("row")[id_col].alias("id"), "uid")
    distinct = space.materialize(seen.groupBy("fp").agg(F.min(own).alias("least")), "distinct")
    pairs = space.materialize(links(distinct.select("fp"), max_bits), "links")
    found = connected_components(pairs, space).withColumnRenamed("node", "fp")
    classes = space.materialize(
        distinct.join(found, "fp", "left").select(
            "fp", "least", F.coalesce("component", "fp").alias("component")
        ),
        "classes",
    )
    heads = space.materialize(
        classes.groupBy("component").agg(F.min("least").alias("head")), "heads"
    )
    named = space.materialize(classes.join(heads, "component").select("fp", "head"), "named")
    return seen.join(named, "fp").select(
        "row",
        "fp",
        "uid",
        F.col("head.id").alias("component_id"),
        (F.col("uid") == F.col("head.uid")).alias("first"),
    )


def deduplicate(
    docs: DataFrame, shingle: int, max_bits: int, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """One row of each component, with all its columns."""
    found = near_duplicates(docs, shingle, max_bits, text_col, id_col)
    return found.filter("first").select("row.*")
