"""Language-model scoring by a probabilistic suffix tree over words.

A text is its words (A-Z taken as a-z) and one end token.  The states of the tree
are contexts of up to ``depth`` words; each predicts the next token by

    P(a | s) = (n(sa) - 1) / n(s) + (1 - kept) P(a | s'),   kept = sum of the first part,

absolute discounting by one, where s' is s without its oldest word: followers seen
once only raise the share of the shorter context.  The root is the smoothed share
of each token, (c + 0.1) / (N + 0.1 (V + 1)).  A context whose suffix is in the tree
joins it by a divergence test: the log-likelihood that its own distribution gains
over its suffix's, on what followed it, n(s) times their divergence, must exceed
``penalty`` for each follower seen twice or more.  A token is scored by the longest
suffix of what precedes it that is a state.

All counts come from all training texts, by shuffled sums.  The logarithm of a
score is additive over the n-grams of a text: a token's root share; for each state
that precedes a token, log(1 - kept); for each (state, follower) seen twice or more
the difference it makes, log P(a|s) - log P(a|s') - log(1 - kept).  (Where one is
known, so are all with shorter contexts.)  Scoring is therefore one join per context
length of the n-grams of the texts with a table of weights, and a sum per text; no
task holds the model.  N-grams are counted and joined in buckets, ranges of their
keys that hold about ``HELD`` tokens each whatever the size of the corpus; a task
sends an n-gram once for all its occurrences in what it has held, so a frequent one
weighs no more in its bucket than another.  N-grams that cannot have a weight are left out before the
shuffle by bit filters of a fixed size (``FILTER_BITS``; a full filter only lets more
n-grams through).

Words and n-grams are known by 64-bit keys (see ``tokens``).

Defined results: null texts are empty: one end token; without training texts every
token has the same root share, 1; equal texts and repeated rows get equal scores;
an empty table gives an empty table; other columns are kept in ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshscope.llm.common import column
from meshscope.llm.tokens import paired, slices, word_keys
from meshscope.plans.iterate import Workspace

DEPTH = 2  # words of the longest contexts
PENALTY = 2.0  # nats a state must gain for each follower
SMOOTH = 0.1
END = np.uint64(0xE4D0F7E87D0C3E11)  # the end token's key
FILTER_BITS = 1 << 27
HELD = 1 << 21  # n-grams that a task sorts at once
_BLOCK = 32768  # bits of one value of bitmap_construct_agg


# ---- n-grams of texts ------------------------------------------------------------


def _tokens(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token keys, the text of each and its place in the text."""
    keys, bounds = word_keys(part, lower=True)
    tokens = np.insert(keys, bounds[1:], END)
    sizes = np.diff(bounds) + 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    return tokens, text, np.arange(len(tokens)) - (np.cumsum(sizes) - sizes)[text]


def _inside(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(keys), dtype=bool)
    at = (keys >> np.uint64(64 - int(math.log2(FILTER_BITS)))).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _grams(part: pa.Array, level: int, before=None, after=None):
    """(context, suffix, text) of each n-gram of ``level`` + 1 tokens that the filters let through.

    The key of an n-gram is ``paired(context, suffix)``: of its first and its last
    ``level`` tokens.  At level 0, context is None and suffix the token.
    """
    key, text, place = _tokens(part)
    if not level:
        return None, key, text
    for _ in range(level - 1):
        key = paired(key[:-1], key[1:])
    ok = place[level:] >= level
    if before is not None or after is not None:
        known = _inside(before, key)
        ok &= known[:-1] & _inside(after, key[1:])
    return key[:-1][ok], key[1:][ok], text[level:][ok]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key: ranges of equal width, so that sorted keys have sorted buckets."""
    return ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _by_bucket(key: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys."""
    bucket = _bucket(key, buckets)
    cut = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets))) if len(key) else np.zeros(0, dtype=np.int64)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(cut, [*cut[1:], len(key)])]


def _word_counter(batches) -> Iterator[pa.RecordBatch]:
    """From texts to (key, n) of what a task has held at once."""

    def counted(held) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([_signed(key), pa.array(n)], names=["key", "n"])

    held, n = [], 0
    for batch in batches:
        for _, part in slices(batch.column(0)):
            held.append(_tokens(part)[0])
            n += len(held[-1])
            if n >= HELD:
                yield counted(held)
                held, n = [], 0
    if n:
        yield counted(held)


def _counter(level: int, buckets: int, before, after):
    """A mapInArrow function from texts to the n-grams of what a task has held at once, by bucket.

    ``context``, ``suffix`` and ``n`` hold the 64-bit numbers of many n-grams.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, part in slices(batch.column(0)):
                context, suffix, _text = _grams(part, level, before and before.value, after and after.value)
                held.append((context, suffix))
                n += len(suffix)
                if n >= HELD:
                    yield listed(held)
                    held, n = [], 0
        if n:
            yield listed(held)

    def listed(held) -> pa.RecordBatch:
        context, suffix = (np.concatenate(x) for x in zip(*held))
        key, context, suffix, n = _counted(context, suffix, np.ones(len(context), dtype=np.int64))
        parts = _by_bucket(key, buckets)
        blobs = [[x[a:b].tobytes() for _, a, b in parts] for x in (context, suffix, n)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in parts], pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]],
            names=["bucket", "context", "suffix", "n"],
        )

    return run


def _counted(context: np.ndarray, suffix: np.ndarray, n: np.ndarray):
    """Sums of ``n`` for each different n-gram, sorted by key: key, context, suffix, n."""
    key = paired(context, suffix)
    order = np.argsort(key)
    key, context, suffix, n = key[order], context[order], suffix[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    return key[new], context[new], suffix[new], np.add.reduceat(n, new) if len(key) else n


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    """The numbers in all values of a binary column."""
    return np.concatenate([np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()])


def _repeated(table: pa.Table) -> pa.Table:
    """The n-grams of a bucket that occur twice or more, with their counts."""
    _, context, suffix, n = _counted(
        _column(table, "context", np.uint64), _column(table, "suffix", np.uint64), _column(table, "n", np.int64)
    )
    more = n > 1
    return pa.table({"context": _signed(context[more]), "suffix": _signed(suffix[more]), "n": n[more]})


def _bits(keys: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits: one bit for the highest bits of each key."""
    at = F.shiftrightunsigned("key", 64 - int(math.log2(FILTER_BITS))) + 1
    found = keys.groupBy(F.bitmap_bucket_number(at).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for row in found.toLocalIterator():  # at most FILTER_BITS / _BLOCK rows of 4 KB
        out[(row["block"] - 1) * _BLOCK // 8 : row["block"] * _BLOCK // 8] = np.frombuffer(row["bits"], dtype=np.uint8)
    return out


# ---- fitting ---------------------------------------------------------------------


@dataclass
class SuffixTree:
    """Weights by n-gram key, one table for each length, and the filters of their keys."""

    space: Workspace
    tokens: int  # N
    types: int  # V
    weights: list[DataFrame]  # key, w (a key's rows add up), n (of tokens)
    states: list[DataFrame]  # context, log10 of (1 - kept); for contexts of 1, 2, ... words

    @property
    def buckets(self) -> int:
        """Into how many parts n-grams are dealt by key: about ``HELD`` tokens each."""
        return max(32, -(-self.tokens // HELD))

    @property
    def root(self) -> float:
        """log10 of N + 0.1 (V + 1)."""
        return math.log10(self.tokens + SMOOTH * (self.types + 1))


def _log_share(n: Column | float, root: float):
    if isinstance(n, Column):
        return F.log10(n + SMOOTH) - root
    return math.log10(n + SMOOTH) - root


def fit(docs: DataFrame, text_col: str = "text", depth: int = DEPTH, penalty: float = PENALTY) -> SuffixTree:
    """The tree of all texts of ``docs``; its tables lie in the checkpoint folder."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    space = Workspace(spark, "suffix_tree", many_keys=True)
    texts = docs.select(column(text_col).cast("string"))

    words, seen = space.materialize_observed(
        texts.mapInArrow(_word_counter, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")),
        ("words",),
        tokens=F.sum("n"),
        types=F.count(F.lit(1)),
    )
    tree = SuffixTree(space, seen["tokens"] or 0, seen["types"] or 0, [], [])
    buckets = tree.buckets

    def repeated(level: int, before, after) -> DataFrame:
        found = texts.mapInArrow(
            _counter(level, buckets, before, after), "bucket int, context binary, suffix binary, n binary"
        )
        return found.groupBy("bucket").applyInArrow(_repeated, "context long, suffix long, n long")

    totals = words  # key, n of what may be a context
    shares = words.select("key", _log_share(F.col("n"), tree.root).alias("lp"))
    parts: list[list[DataFrame]] = [[words.select("key", "n", _log_share(F.col("n"), tree.root).alias("w"))]]
    before = after = None
    for level in range(1, depth + 1):
        grams = space.materialize(repeated(level, before, after), f"grams-{level}")
        own = space.materialize(
            grams.groupBy("context").agg(
                F.sum(F.col("n") - 1).alias("kept"), F.sum("n").alias("again"), F.count(F.lit(1)).alias("followers")
            ),
            f"followers-{level}",
        )
        left = 1 - F.col("kept") / F.col("n")
        tried = space.materialize(
            own.join(totals.withColumnRenamed("key", "context"), "context").select(
                "context", F.col("n").alias("total"), left.alias("left"), (F.col("n") - F.col("again")).alias("once"), "followers"
            ),
            f"tried-{level}",
        )
        space.drop(f"followers-{level}", f"totals-{level - 1}")
        lower = shares.select(F.col("key").alias("suffix"), F.col("lp").alias("lower"))
        p = (F.col("n") - 1) / F.col("total") + F.col("left") * F.pow(F.lit(10.0), "lower")
        key = F.xxhash64("context", "suffix").alias("key")
        entries = space.materialize(
            grams.join(lower, "suffix").select("context", key, "n", "lower")
            .join(tried.select("context", "total", "left"), "context")
            .select("context", "key", "n", "lower", F.log10(p).alias("lp")),
            f"entries-{level}",
        )
        # what may be a context of the next level
        totals = space.materialize(grams.select(key, "n"), f"totals-{level}") if level < depth else None
        space.drop(f"grams-{level}")
        gained = space.materialize(
            entries.groupBy("context").agg(F.sum(F.col("n") * (F.col("lp") - F.col("lower"))).alias("gain")),
            f"gained-{level}",
        )
        log_left = F.log10("left")
        states = space.materialize(
            gained.join(tried, "context")
            .filter((F.col("gain") + F.col("once") * log_left) * math.log(10) > penalty * F.col("followers"))
            .select("context", log_left.alias("left")),
            f"states-{level}",
        )
        retained = space.materialize(
            entries.join(states, "context").select(
                "key", "lp", (F.col("lp") - F.col("lower") - F.col("left")).alias("w")
            ),
            f"retained-{level}",
        )
        space.drop(f"tried-{level}", f"entries-{level}", f"gained-{level}")
        parts[level - 1].append(states.select(F.col("context").alias("key"), F.col("left").alias("w")))
        parts.append([retained.select("key", "w")])
        tree.states.append(states)
        shares = retained.select("key", "lp")
        if level < depth:
            before = sc.broadcast(_bits(totals))
            # before the last level, all counts are needed: those of the next level's contexts
            after = sc.broadcast(_bits(retained)) if level + 1 == depth else before
    nothing = F.lit(None).cast("long").alias("n")
    for level, (found, *more) in enumerate(parts):
        rows = found.select("key", "w", "n" if not level else nothing)
        for x in more:
            rows = rows.unionByName(x.select("key", "w", nothing))
        tree.weights.append(space.materialize(rows, f"weights-{level}"))
    space.drop("words", *[f"retained-{level}" for level in range(1, depth + 1)])
    return tree


# ---- scoring ---------------------------------------------------------------------


def _place_kind(n: int):
    """The numbers of ``n`` places."""
    return np.uint16 if n <= 1 << 16 else np.uint32


def _requests(level: int, buckets: int, known):
    """A mapInArrow function from (uid, text) to the n-grams of what a task has held, by bucket.

    ``keys`` holds 64-bit numbers, sorted, ``sizes`` how many texts have each; ``places``
    are these texts' places in ``uids``, ``times`` how often each has the n-gram.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for first, part in slices(batch.column(1)):
                context, suffix, text = _grams(part, level)
                key = suffix if context is None else paired(context, suffix)
                if known is not None:
                    ok = _inside(known.value, key)
                    key, text = key[ok], text[ok]
                held.append((key, uids[first + text]))
                n += len(key)
                if n >= HELD:
                    yield listed(held)
                    held, n = [], 0
        if n:
            yield listed(held)

    def listed(held) -> pa.RecordBatch:
        key, uid = (np.concatenate(x) for x in zip(*held))
        # the texts in the order they came: few numbers instead of uids
        other = np.concatenate([[True], uid[1:] != uid[:-1]])
        low, at = uid[other], np.cumsum(other, dtype=np.uint32) - np.uint32(1)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (at[1:] != at[:-1])]))
        times = np.diff(np.append(new, len(key))).astype(np.uint32)
        key, at = key[new], at[new].astype(_place_kind(len(low)))
        parts = _by_bucket(key, buckets)
        blobs = [[], [], [], []]
        for _, a, b in parts:
            begin = np.flatnonzero(np.concatenate([[True], key[a + 1 : b] != key[a : b - 1]]))
            blobs[0].append(key[a:b][begin].tobytes())
            blobs[1].append(np.diff(np.append(begin, b - a)).astype(np.uint32).tobytes())
            blobs[2].append(at[a:b].tobytes())
            blobs[3].append(times[a:b].tobytes())
        texts = low.astype(np.int64).tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in parts], pa.int32()),
                *[pa.array(x, pa.binary()) for x in blobs],
                pa.array([texts] * len(parts), pa.binary()),
            ],
            names=["bucket", "keys", "sizes", "places", "times", "uids"],
        )

    return run


def _weights_by_bucket(buckets: int):
    """A mapInArrow function from (key, w, n) to the same by bucket, many in a row, keys sorted."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(
                    (
                        batch.column(0).to_numpy().view(np.uint64),
                        batch.column(1).to_numpy(),
                        batch.column(2).fill_null(0).to_numpy(),
                    )
                )
                n += batch.num_rows
            if n >= HELD // 2:
                yield listed(held)
                held, n = [], 0
        if n:
            yield listed(held)

    def listed(held) -> pa.RecordBatch:
        key, *values = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(key)
        parts = _by_bucket(key[order], buckets)
        blobs = [[x[order[a:b]].tobytes() for _, a, b in parts] for x in (key, *values)]
        return pa.RecordBatch.from_arrays(
            [pa.array([k for k, _, _ in parts], pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]],
            names=["bucket", "key", "w", "n"],
        )

    return run


_SUMS = ["uid", "tokens", "score", "base", "known"]


def _weighed(level: int, root: float):
    """A cogrouped function from a bucket's requests and weights to sums for each text."""

    def run(asked: pa.Table, weights: pa.Table) -> pa.Table:
        kinds = {"key": np.uint64, "w": np.float64, "n": np.int64}
        empty = not weights.num_rows
        key, w, count = (np.zeros(0, k) if empty else _column(weights, c, k) for c, k in kinds.items())
        order = np.argsort(key)
        key, w, count = key[order], w[order], count[order]
        if len(key):
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, w, count = key[new], np.add.reduceat(w, new), np.maximum.reduceat(count, new)
        unknown = math.log10(SMOOTH) - root
        parts = []
        for row in asked.to_pylist():
            keys = np.frombuffer(row["keys"], dtype=np.uint64)
            size = np.frombuffer(row["sizes"], dtype=np.uint32)
            times = np.frombuffer(row["times"], dtype=np.uint32).astype(float)
            at = np.searchsorted(key, keys)
            known = at < len(key)
            known[known] = key[at[known]] == keys[known]
            at = np.where(known, at, 0)
            one = np.where(known, w[at], unknown if not level else 0.0) if len(key) else np.full(len(keys), 0.0 if level else unknown)
            n = np.where(known, count[at], 0) if len(key) else np.zeros(len(keys))
            uids = np.frombuffer(row["uids"], dtype=np.int64)
            place = np.frombuffer(row["places"], dtype=_place_kind(len(uids)))
            sums = [np.bincount(place, times * np.repeat(one, size), len(uids))]
            if not level:
                base = np.log10(n + SMOOTH) - root
                values = (np.ones(len(keys)), base, n > 0)
                sums += [np.bincount(place, times * np.repeat(v, size), len(uids)) for v in values]
            met = np.flatnonzero(np.bincount(place, minlength=len(uids)))
            parts.append((uids[met], *[x[met] for x in sums]))
        if not parts:
            return pa.table({n: pa.array([], pa.int64() if n == "uid" else pa.float64()) for n in _SUMS})
        uid, *values = (np.concatenate(x) for x in zip(*parts))
        uids, at = np.unique(uid, return_inverse=True)
        added = [np.bincount(at, v, len(uids)) for v in values]
        added += [np.zeros(len(uids))] * (4 - len(added))
        return pa.table(dict(zip(_SUMS, [uids, added[1], added[0], added[2], added[3]])))

    return run


def score(docs: DataFrame, tree: SuffixTree, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), ``n_tokens``, ``n_known``, ``base_score`` and ``score`` (log10)."""
    spark = docs.sparkSession
    space = Workspace(spark, "suffix_tree_scores", many_keys=True)
    keep = list(docs.columns if keep is None else keep)
    stored = space.materialize(
        docs.select(
            F.struct(*[column(c) for c in keep]).alias("row"),
            column(text_col).cast("string").alias("text"),
            F.monotonically_increasing_id().alias("uid"),
        ),
        "documents",
    )
    texts = stored.select("uid", "text")
    parts = []
    for level, weights in enumerate(tree.weights):
        known = spark.sparkContext.broadcast(_bits(weights)) if level else None
        asked = texts.mapInArrow(
            _requests(level, tree.buckets, known),
            "bucket int, keys binary, sizes binary, places binary, times binary, uids binary",
        )
        dealt = weights.select("key", "w", "n").mapInArrow(
            _weights_by_bucket(tree.buckets), "bucket int, key binary, w binary, n binary"
        )
        sums = (
            asked.groupBy("bucket")
            .cogroup(dealt.groupBy("bucket"))
            .applyInArrow(_weighed(level, tree.root), "uid long, tokens double, score double, base double, known double")
        )
        parts.append(
            space.materialize(
                sums.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("tokens", "score", "base", "known")]),
                f"sums-{level}",
            )
        )
    total = parts[0]
    for more in parts[1:]:
        total = total.unionByName(more)
    total = total.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("tokens", "score", "base", "known")])
    return stored.select("uid", "row").join(total, "uid").select(
        "row",
        F.round("tokens").cast("long").alias("n_tokens"),
        F.round("known").cast("long").alias("n_known"),
        F.col("base").alias("base_score"),
        "score",
    )
