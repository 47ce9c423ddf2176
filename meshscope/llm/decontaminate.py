"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Items and texts are sequences of words (lower case, outer punctuation removed).
A text is contaminated by an item of n words if some passage of it is within
``floor((1 - similarity) * n)`` word edits of the item.  The search looks at
item-sized windows (n words) at every word of every text.  Windows may reach
beyond the text by up to the allowed edits, over places without a word, so that
passages with words left out are met at the text's start and end and as a whole
text shorter than the item:

1. A lossless filter: within e edits a window keeps at least n - 1 - 2e of the
   item's word pairs, so windows with fewer pairs of items of n words are passed
   over.
2. The CGK random walk embeds what is left: step j writes the current word and
   moves on if a random bit of (j, word) says so.  Few edits become a small
   Hamming distance.  ``REPEATS`` independent walks each sample ``SAMPLED``
   positions; a window and an item meet if one sample agrees.
3. Passages that meet are verified exactly by edit distance (best alignment of
   the whole item in the passage).

The benchmark is the stated query set.  It is broadcast in blocks of at most
``BLOCK_WORDS`` words; each block is one more pass inside the same job.

Defined results: null or empty texts match nothing; items of fewer than
``MIN_WORDS`` words (null and empty ones too) are not searched for, as they
occur in clean text; equal items are all reported; equal texts get equal rows;
an empty benchmark leaves every text clean.  Texts are searched whole.
"""

from __future__ import annotations

import re
import string
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.llm.common import append, column, struct, unpack

MIN_WORDS = 5
SIMILARITY = 0.8
REPEATS = 12
SAMPLED = 3
STRETCH = 3  # walk steps per word
BLOCK_WORDS = 1_000_000
WINDOWS = 1 << 18  # windows walked at a time
PUNCTUATION = string.punctuation + "¡¿«»“”„‘’–—…"
_SEED = np.uint64(0x9E3779B97F4A7C15)

HITS = T.ArrayType(
    struct(
        item_id=T.LongType(),
        distance=T.IntegerType(),
        item_words=T.IntegerType(),
        start_word=T.IntegerType(),
        end_word=T.IntegerType(),
    )
)


_AFTER = re.compile(rf"[{re.escape(PUNCTUATION)}]+(?!\S)")
_BEFORE = re.compile(rf"\s[{re.escape(PUNCTUATION)}]+")


def words_of(text: str | None) -> list[str]:
    text = _BEFORE.sub(" ", _AFTER.sub("", text or "").lstrip(PUNCTUATION))
    return text.lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: random-looking bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def allowed(n, similarity: float):
    """Word edits allowed for an item of ``n`` words."""
    return np.floor((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def pair_slots(ids: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Slot, of 2 ** bits, of the pair of neighbouring words at each place."""
    a, b = ids[at].astype(np.uint64), ids[at + 1].astype(np.uint64)
    return (mix(a * _SEED + b) >> np.uint64(64 - bits)).astype(np.int64)


def sample_keys(ids, starts, sizes, repeat_: int, symbols: int) -> np.ndarray:
    """The LSH key of windows ``ids[start : start + size]`` in one repetition.

    Sampled positions are fixed per repetition and size; a walk that has left
    its window writes a mark.  ``ids`` are below ``symbols``.
    """
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    order = np.argsort(sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    groups, begin = np.unique(sizes, return_index=True)
    shares = np.random.default_rng([repeat_, 7]).random(SAMPLED)
    events: dict[int, list[slice]] = {}  # the windows that sample a step
    for size, a, b in zip(groups.tolist(), begin.tolist(), [*begin[1:].tolist(), len(sizes)]):
        for share in shares:
            events.setdefault(int(share * STRETCH * size), []).append(slice(a, b))
    steps = max(events) + 1
    seeds = mix(np.arange(1, steps + 1, dtype=np.uint64) * _SEED + np.uint64(repeat_ * 1_000_003))
    marks = np.arange(symbols + 1, dtype=np.uint64) * _SEED
    ends, at = starts + sizes, starts.copy()
    keys = sizes.astype(np.uint64)
    last = len(ids) - 1
    for j in range(steps):
        symbol = np.where(at < ends, ids[np.minimum(at, last)] + 1, 0)
        for part in events.get(j, ()):
            keys[part] = mix(keys[part] * _SEED + symbol[part].astype(np.uint64))
        if symbols < len(symbol):
            at += (mix(marks ^ seeds[j]) >> np.uint64(63)).astype(np.int64)[symbol]
        else:
            at += (mix(marks[symbol] ^ seeds[j]) >> np.uint64(63)).astype(np.int64)
    out = np.empty_like(keys)
    out[order] = keys
    return out


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the whole item and any passage of ``text``; its start and end."""
    width = len(text) + 1
    place = np.arange(width)
    cost, start = np.zeros(width, dtype=np.int64), place.copy()
    for symbol in item:
        stay = cost + 1
        go = cost[:-1] + (text != symbol)
        best, came = stay.copy(), start.copy()
        better = go <= stay[1:]
        best[1:][better], came[1:][better] = go[better], start[:-1][better]
        # insertions: the least best[k] + (j - k) over k <= j
        level = (best - place) * (width + 1) + (width - place)
        run = np.minimum.accumulate(level)
        source = width - (run - np.floor_divide(run, width + 1) * (width + 1))
        cost, start = best[source] + place - source, came[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Block:
    """A bounded part of the benchmark, ready to search texts for."""

    def __init__(self, items: list[tuple[int, str]], similarity: float):
        self.similarity = similarity
        vocabulary: dict[str, int] = {}
        self.item_ids, rows = [], []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= MIN_WORDS:
                rows.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words]))
                self.item_ids.append(item_id)
        self.vocabulary, self.items = vocabulary, rows
        self.symbols = len(vocabulary) + 2
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.sizes = np.unique(sizes)
        if not rows:
            return
        flat, starts = np.concatenate(rows), np.cumsum(sizes) - sizes
        # bit k of a slot: the pair is in an item of the k-th size (modulo 64)
        self.pair_bits = max(10, int(16 * sizes.sum()).bit_length())
        self.pairs = np.zeros(1 << self.pair_bits, dtype=np.uint64)
        self.bits = np.arange(len(self.sizes), dtype=np.uint64) % np.uint64(64)
        bit_of = dict(zip(self.sizes.tolist(), (np.uint64(1) << self.bits).tolist()))
        for r in rows:
            slots = pair_slots(r, np.arange(len(r) - 1), self.pair_bits)
            self.pairs[slots] |= np.uint64(bit_of[len(r)])
        self.edits = allowed(self.sizes, similarity)
        self.need = np.maximum(0, self.sizes - 1 - 2 * self.edits)
        least = int(self.sizes[0]) - 1
        # any window that passes has a part of ``least`` pairs with so many known ones
        self.least, self.dense = least, int((-(-self.need // -(-(self.sizes - 1) // least))).min())
        # the slots of each item's pairs: a passage needs enough of them before it is aligned
        self.slots = [np.unique(pair_slots(r, np.arange(len(r) - 1), self.pair_bits)) for r in rows]
        self.tables = []
        for k in range(REPEATS):
            keys = sample_keys(flat, starts, sizes, k, self.symbols)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, size) of the windows of one text that pass the filter.

        A window of n words may start up to e words before the text and end up to
        e words after it, if at least n - e of its words are in the text.
        """
        none = (np.empty(0, dtype=np.int64),) * 2
        fitting = int(np.searchsorted(self.sizes - self.edits, len(ids), "right"))
        if not fitting:
            return none
        both = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0))
        if len(both) < self.dense:
            return none
        pad = int(self.edits[fitting - 1])  # places without a word on either side
        sets = np.zeros(len(ids) - 1 + 2 * pad, dtype=np.uint64)
        sets[pad + both] = self.pairs[pair_slots(ids, both, self.pair_bits)]
        total = np.concatenate([[0], np.cumsum(sets > 0)])
        part = total[self.least :] - total[: len(total) - self.least]
        if part.max() < self.dense:
            return none
        starts, sizes = [], []
        present = int(np.bitwise_or.reduce(sets))
        listed = zip(self.sizes[:fitting].tolist(), self.edits.tolist(), self.need.tolist(), self.bits)
        for size, edits, need, bit in listed:
            if need and not present >> int(bit) & 1:
                continue
            if need and (total[size - 1 :] - total[: len(total) - size + 1]).max() < need:
                continue  # too few pairs of items of any size
            known = np.concatenate([[0], np.cumsum((sets >> bit) & np.uint64(1), dtype=np.int64)])
            count = known[size - 1 :] - known[: len(known) - size + 1]
            first, last = pad - edits, pad + len(ids) - size + edits
            at = np.flatnonzero(count[first : last + 1] >= need) - edits
            starts.append(at)
            sizes.append(np.full(len(at), size))
        return (np.concatenate(starts), np.concatenate(sizes)) if starts else none

    def meet(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """(window, item) index pairs that agree in one repetition at least."""
        found = []
        for k, (keys, order) in enumerate(self.tables):
            mine = sample_keys(ids, starts, sizes, k, self.symbols)
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            count = high - low
            window = np.repeat(np.arange(len(mine)), count)
            rank = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            found.append(np.stack([window, order[np.repeat(low, count) + rank]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: list[str | None]) -> list[list[dict]]:
        """The hits of each text, in order of place and item."""
        hits: list[list[dict]] = [[] for _ in texts]
        if not self.items:
            return hits
        get = self.vocabulary.get
        held: list[tuple] = []  # text, its ids with the places around it, where it begins and ends, windows
        waiting = 0
        for k, text in enumerate(texts):
            ids = np.array(list(map(get, words_of(text), repeat(0))), dtype=np.int64)
            starts, sizes = self.windows(ids)
            if not len(starts):
                continue
            before, after = max(0, -int(starts.min())), max(0, int((starts + sizes).max()) - len(ids))
            bounds, starts = (before, before + len(ids)), starts + before
            if before or after:
                ids = np.pad(ids, (before, after))
            for a in range(0, len(starts), WINDOWS):
                held.append((k, ids, bounds, starts[a : a + WINDOWS], sizes[a : a + WINDOWS]))
                waiting += len(held[-1][3])
                if waiting >= WINDOWS:
                    self._verify(held, hits)
                    held, waiting = [], 0
        if held:
            self._verify(held, hits)
        for k, found in enumerate(hits):
            hits[k] = self._best(found)
        return hits

    def _verify(self, held: list[tuple], hits: list[list[dict]]) -> None:
        lengths = np.array([len(h[1]) for h in held])
        first = np.cumsum(lengths) - lengths
        flat = np.concatenate([h[1] for h in held])
        starts = np.concatenate([h[3] + f for h, f in zip(held, first)])
        sizes = np.concatenate([h[4] for h in held])
        text = np.repeat(np.arange(len(held)), [len(h[3]) for h in held])
        pairs = self.meet(flat, starts, sizes)
        if not len(pairs):
            return
        window, item = pairs[:, 0], pairs[:, 1]
        order = np.lexsort((starts[window], item, text[window]))
        window, item = window[order], item[order]
        at, size, where = starts[window], sizes[window], text[window]
        new = np.ones(len(at), dtype=bool)  # overlapping windows are verified as one passage
        new[1:] = (item[1:] != item[:-1]) | (where[1:] != where[:-1]) | (at[1:] > at[:-1] + size[1:])
        begin = np.flatnonzero(new)
        for a, b in zip(begin, [*begin[1:], len(at)]):
            k, row = int(where[a]), self.items[item[a]]
            slack = int(allowed(len(row), self.similarity))
            begins, ends = (int(first[k]) + x for x in held[k][2])
            low = max(int(at[a]) - slack, begins)
            high = min(int(at[b - 1]) + len(row) + slack, ends)
            passage = flat[low:high]
            pairs_of = pair_slots(passage, np.arange(len(passage) - 1), self.pair_bits)
            if np.isin(pairs_of, self.slots[item[a]]).sum() < len(row) - 1 - 2 * slack:
                continue
            distance, start, end = best_alignment(row, passage)
            if distance <= slack:
                hits[held[k][0]].append(
                    {
                        "item_id": self.item_ids[item[a]],
                        "distance": distance,
                        "item_words": len(row),
                        "start_word": low - begins + start,
                        "end_word": low - begins + end,
                    }
                )

    @staticmethod
    def _best(found: list[dict]) -> list[dict]:
        """One hit for each item and place, ordered."""
        seen = {(h["item_id"] is None, h["item_id"] or 0, h["start_word"], h["end_word"]): h for h in found}
        return [seen[k] for k in sorted(seen, key=lambda x: (x[2], x[3], x[0], x[1]))]


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of at most ``BLOCK_WORDS`` words (one longer item is its own block)."""
    sized = benchmark.select(
        column(id_col).cast("long").alias("id"),
        column(text_col).alias("text"),
        F.size(F.split(column(text_col), r"\s+")).cast("long").alias("n"),
    ).filter(F.col("n") >= MIN_WORDS)
    total = sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-2 * total // BLOCK_WORDS)) if total > BLOCK_WORDS else 1
    found = []
    for part in range(parts):
        mine = sized.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        found.append([(r["id"], r["text"]) for r in mine.select("id", "text").orderBy("id", "text").collect()])
    return found


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
) -> DataFrame:
    """``row`` (struct of the kept columns) and ``hits`` (array) of each text."""
    spark: SparkSession = docs.sparkSession
    keep = list(docs.columns if keep is None else keep)
    found = None
    for items in blocks(benchmark, item_id_col, item_text_col):
        block = spark.sparkContext.broadcast(Block(items, similarity))

        def search(texts, block=block):
            return [block.value.search(texts)]

        if found is None:
            carried = list(dict.fromkeys([*keep, text_col]))
            found = append(docs, text_col, struct(hits=HITS), search, carried)
        else:
            flat = found.select("row", F.col(f"row.`{text_col}`").alias("_text"), F.col("hits").alias("_hits"))
            more = append(flat, "_text", struct(hits=HITS), search, ["row", "_hits"])
            found = more.select("row.row", F.concat("row._hits", "hits").alias("hits"))
    return found.select(
        F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"), "hits"
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The texts without a hit, with all their columns."""
    return unpack(contamination(docs, benchmark, text_col, **options).filter(F.size("hits") == 0))
