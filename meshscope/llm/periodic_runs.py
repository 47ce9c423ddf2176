"""Periodic runs of words, found on a Re-Pair grammar of the word ids.

A run is a stretch of consecutive words with smallest period q, at least
``min_words`` and ``exponent`` * q words long, that no neighbouring word extends
with period q.  Per text:

* Stretches that cannot hold a run are ruled out first, exactly: a run has two
  equal windows of ``min_words * (exponent - 1) / exponent`` words one period
  apart, at every place but those of its last period.  Rows of places whose window
  comes again, close enough for the length of the row, go on, with one period more.
* Re-Pair replaces the most frequent pair of neighbouring symbols by a new one
  until no pair occurs twice; a balanced tree over what is left completes the
  grammar.
* A run lies within the expansion of some nonterminal and crosses the boundary of
  its two parts.  For each nonterminal, once, at one of its places: the periods
  at which the word beside the boundary comes again are extended to both sides
  (longest common extensions on the ranks of all windows of 2**k words), within
  the expansion.
* These runs are translated to every place that the nonterminal derives;
  stretches of the same period that overlap by it or lie in one another are one.

Words are compared exactly; 64-bit keys are used in the first step only, where
equal words always have equal keys.

Defined results: null texts have no words, no runs and an empty collapsed text;
texts of fewer than ``min_words`` words have no runs; equal texts and repeated rows
get equal results; an empty table gives an empty table; other columns are kept in
``row``.  A text is read whole by one task, in time n log n; tasks hold one Arrow
batch of texts.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from meshscope.llm.common import column, words_of
from meshscope.llm.tokens import mix, slices, word_keys

MIN_WORDS = 24
EXPONENT = 3

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])


# ---- the grammar ---------------------------------------------------------------


def re_pair(ids: list[int], symbols: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules (left, right) of the symbols ``symbols``, ``symbols + 1``, ... and the last sequence."""
    n = len(ids)
    sym, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    last_place: dict[tuple[int, int], int] = {}
    for p in range(n - 1):
        pair = (sym[p], sym[p + 1])
        if pair[0] == pair[1] and last_place.get(pair) == p - 1:
            continue  # it overlaps the last one
        places.setdefault(pair, []).append(p)
        last_place[pair] = p
    count = {pair: len(at) for pair, at in places.items()}
    heap = [(-c, pair) for pair, c in count.items() if c > 1]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        c, pair = heappop(heap)
        now = count.get(pair, 0)
        if now < 2:
            continue
        if now != -c:
            heappush(heap, (-now, pair))
            continue
        a, b = pair
        new = symbols + len(rules)
        rules.append(pair)
        del count[pair]
        made: dict[tuple[int, int], list[int]] = {}
        for p in places.pop(pair):
            q = after[p]
            if sym[p] != a or q >= n or sym[q] != b:
                continue
            left, right = before[p], after[q]
            if left >= 0:
                old = (sym[left], a)
                if old in count:
                    count[old] -= 1
            if right < n:
                old = (b, sym[right])
                if old in count:
                    count[old] -= 1
            sym[p], sym[q], after[p] = new, -1, right
            if right < n:
                before[right] = p
                made.setdefault((new, sym[right]), []).append(p)
            if left >= 0:
                made.setdefault((sym[left], new), []).append(left)
        for fresh, at in made.items():
            # a neighbour replaced later in this pass has left its pair
            at = [p for p in at if sym[p] == fresh[0] and after[p] < n and sym[after[p]] == fresh[1]]
            if len(at) > 1:
                places[fresh], count[fresh] = at, len(at)
                heappush(heap, (-len(at), fresh))
    left_over = []
    p = 0
    while p < n:
        left_over.append(sym[p])
        p = after[p]
    return rules, left_over


def _balanced(rules: list[tuple[int, int]], row: list[int], symbols: int) -> list[tuple[int, int]]:
    """The rules, and those of a balanced tree over ``row``; the last rule's symbol derives all."""
    rules = list(rules)
    while len(row) > 1:
        up = []
        for k in range(0, len(row) - 1, 2):
            up.append(symbols + len(rules))
            rules.append((row[k], row[k + 1]))
        row = up + row[len(up) * 2 :]
    return rules


class _Extensions:
    """Longest common extensions in ``x`` by the ranks of its windows of 2**k words."""

    def __init__(self, x: np.ndarray, longest: int):
        self.ranks, size = [x], 1
        while 2 * size <= longest and 2 * size <= len(x):
            r = self.ranks[-1]
            pairs = r[:-size].astype(np.int64) * (int(r.max()) + 1) + r[size:]
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].reshape(-1))
            size *= 2

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are equal, at most ``most``."""
        done = np.zeros_like(i)
        self._extend(i, j, most, done, 1)
        return done

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before i and before j are equal, at most ``most``."""
        done = np.zeros_like(i)
        self._extend(i, j, most, done, -1)
        return done

    def _extend(self, i, j, most, done, way):
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[k], 1 << k
            # the longest windows may be taken again and again, the others once
            while True:
                room = done + size <= most
                at = done if way > 0 else -done - size
                a, b = np.where(room, i + at, 0), np.where(room, j + at, 0)
                more = room & (rank[a] == rank[b])
                done += np.where(more, size, 0)
                if k < len(self.ranks) - 1 or not more.any():
                    break


def runs_of(ids: list[int], min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in a sequence of word ids 0, 1, ..., by start, then period."""
    n = len(ids)
    if n < max(min_words, exponent, 2):
        return []
    symbols = max(ids) + 1
    rules = _balanced(*re_pair(ids, symbols), symbols)
    size = [1] * symbols + [0] * len(rules)
    for k, (a, b) in enumerate(rules):
        size[symbols + k] = size[a] + size[b]
    first = [0] * len(size)
    for k in range(len(rules) - 1, -1, -1):
        a, b = rules[k]
        at = first[symbols + k]
        first[a], first[b] = at, at + size[a]

    # The periods to try at each nonterminal's boundary, at its first place.
    x = np.asarray(ids, dtype=np.int64)
    owners, places, periods = [], [], []
    for k, (a, b) in enumerate(rules):
        whole = size[symbols + k]
        if whole < min_words:
            continue
        o = first[symbols + k]
        mid, end, most = o + size[a], o + whole, whole // exponent
        right = np.flatnonzero(x[mid : min(end, mid + most)] == x[mid - 1]) + 1
        back = x[max(o, mid - most) : mid][::-1]
        left = np.flatnonzero(back == x[mid]) + 1
        periods += [right, left]
        places += [np.full(len(right), mid), mid - left]
        owners.append(np.full(len(right) + len(left), k))
    if not owners:
        return []
    owner, i, q = np.concatenate(owners), np.concatenate(places), np.concatenate(periods)
    if not len(owner):
        return []
    low = np.array(first[symbols:])[owner]
    high = low + np.array(size[symbols:])[owner]
    words = _Extensions(x, n)
    start = i - words.backward(i, i + q, i - low)
    stop = i + q + words.forward(i, i + q, high - i - q)
    long = stop - start >= np.maximum(min_words, exponent * q)
    if not long.any():
        return []
    owner, start, stop, q, low = owner[long], start[long], stop[long], q[long], low[long]

    # Every place that a nonterminal derives, from the top down.
    at: dict[int, list[np.ndarray]] = {symbols + len(rules) - 1: [np.zeros(1, dtype=np.int64)]}
    by_owner: dict[int, list[int]] = {}
    for row, k in enumerate(owner):
        by_owner.setdefault(int(k), []).append(row)
    found: list[np.ndarray] = []
    for k in range(len(rules) - 1, -1, -1):
        starts = at.pop(symbols + k, None)
        if starts is None or size[symbols + k] < min_words:
            continue
        starts = np.concatenate(starts)
        a, b = rules[k]
        at.setdefault(a, []).append(starts)
        at.setdefault(b, []).append(starts + size[a])
        rows = by_owner.get(k)
        if rows:
            shift = (starts[:, None] - low[rows][None, :]).ravel()
            each = np.tile(np.arange(len(rows)), len(starts))
            found.append(np.stack([q[rows][each], start[rows][each] + shift, stop[rows][each] + shift], axis=1))
    return _merged(np.concatenate(found))


def _merged(found: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal stretches of rows (period, start, stop), each with its smallest period."""
    found = found[np.lexsort((found[:, 0], found[:, 2], found[:, 1]))]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:, 1:] != found[:-1, 1:]).any(axis=1)
    found = found[new]  # of one stretch, the smallest period
    found = found[np.lexsort((-found[:, 2], found[:, 1], found[:, 0]))]
    runs: list[list[int]] = []
    for period, start, stop in found.tolist():
        top = runs[-1] if runs else None
        if top and top[0] == period and (stop <= top[2] or start + period <= top[2]):
            top[2] = max(top[2], stop)
        else:
            runs.append([period, start, stop])
    return sorted((s, e - s, p) for p, s, e in runs)


# ---- texts ---------------------------------------------------------------------


def _stretches(keys: np.ndarray, bounds: np.ndarray, min_words: int, exponent: int) -> list[tuple[int, int, int]]:
    """(text, from, to) of all stretches that may hold a run; words numbered in their text."""
    window = -(-min_words * (exponent - 1) // exponent)
    n = len(keys)
    if n < min_words:
        return []
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    grams, size = keys, 1
    for bit in bin(window)[3:]:  # windows of `window` words by doubling
        grams = mix(grams[: len(grams) - size] * np.uint64(3) + grams[size:])
        size *= 2
        if bit == "1":
            grams = mix(grams[: len(grams) - 1] * np.uint64(3) + keys[size : size + len(grams) - 1])
            size += 1
    at = np.flatnonzero(np.arange(len(grams)) + window <= bounds[1:][text[: len(grams)]])
    if not len(at):
        return []
    grams = grams[at] + mix(text[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(grams, kind="stable")
    equal = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    if not len(equal):
        return []
    p, later = at[order[equal]], at[order[equal + 1]]
    by_place = np.argsort(p)
    p, later = p[by_place], later[by_place]
    # A run of period q has at least (exponent - 1) * q - window + 1 such places in a row, each
    # with an equal window q words on or earlier; it ends one period and one window after the last.
    def rows(p):
        return np.cumsum(np.concatenate([[True], (np.diff(p) != 1) | (text[p[1:]] != text[p[:-1]])])) - 1

    row = rows(p)
    near = (later - p) * (exponent - 1) <= np.bincount(row)[row] + window - 1
    p = p[near]
    if not len(p):
        return []
    row = rows(p)
    count = np.bincount(row)
    head = p[np.flatnonzero(np.diff(row, prepend=-1))]
    tail = np.minimum(head + count - 1 + (count + window - 1) // (exponent - 1) + window, bounds[1:][text[head]])
    cover = np.zeros(n + 1, dtype=np.int64)
    np.add.at(cover, head, 1)
    np.add.at(cover, tail, -1)
    covered = np.cumsum(cover[:-1]) > 0
    covered = np.concatenate([[False], covered, [False]])
    starts = np.flatnonzero(covered[1:] & ~covered[:-1])
    stops = np.flatnonzero(covered[:-1] & ~covered[1:])
    out = []
    for a, b in zip(starts.tolist(), stops.tolist()):
        while a < b:  # texts that touch
            t = int(text[a])
            end = min(b, int(bounds[t + 1]))
            if end - a >= min_words:
                out.append((t, a - int(bounds[t]), end - int(bounds[t])))
            a = end
    return out


def _analysed(texts: pa.Array, min_words: int, exponent: int):
    """(words, runs) of each text; words only where there are runs."""
    for _, part in slices(texts):
        keys, bounds = word_keys(part)
        runs: dict[int, list[tuple[int, int, int]]] = {}
        words: dict[int, list[str]] = {}
        for t, a, b in _stretches(keys, bounds, min_words, exponent):
            if t not in words:
                words[t] = words_of(part[t].as_py().decode())
            known: dict[str, int] = {}
            ids = [known.setdefault(w, len(known)) for w in words[t][a:b]]
            found = runs_of(ids, min_words, exponent)
            if found:
                runs.setdefault(t, []).extend((a + s, n, p) for s, n, p in found)
        for t in range(len(part)):
            text = part[t].as_py()
            text = "" if text is None else text.decode()
            yield int(bounds[t + 1] - bounds[t]), runs.get(t, []), words.get(t) if t in runs else None, text


def _collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those after a run's first period, joined by one space."""
    gone = np.zeros(len(words), dtype=bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return " ".join([w for w, g in zip(words, gone.tolist()) if not g])


def find_runs(
    docs: DataFrame,
    text_col: str = "text",
    keep: list[str] | None = None,
    min_words: int = MIN_WORDS,
    exponent: int = EXPONENT,
) -> DataFrame:
    """``row`` (the kept columns), ``n_words``, ``runs`` (by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words, each run cut to its first period, joined by one space.
    """
    if exponent < 2 or min_words < exponent:
        raise ValueError("exponent must be 2 or more and min_words no less than it")
    keep = list(docs.columns if keep is None else keep)
    source = docs.select(*[column(c) for c in keep], column(text_col).alias("_text_of_runs"))
    out = T.StructType(
        [
            T.StructField("row", T.StructType([docs.schema[c] for c in keep]), False),
            T.StructField("n_words", T.LongType(), False),
            T.StructField("runs", T.ArrayType(RUN, False), False),
            T.StructField("collapsed", T.StringType(), False),
        ]
    )

    def run(batches):
        kind = pa.list_(pa.struct([pa.field(n, pa.int64(), False) for n in RUN.names]))
        for batch in batches:
            n_words, runs, collapsed = [], [], []
            for n, found, words, text in _analysed(batch.column(len(keep)), min_words, exponent):
                n_words.append(n)
                runs.append([dict(zip(RUN.names, r)) for r in sorted(found, key=lambda r: (r[0], r[2]))])
                collapsed.append(_collapsed(words, found) if found else " ".join(words_of(text)))
            rows = pa.StructArray.from_arrays([batch.column(k) for k in range(len(keep))], names=keep)
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array(n_words, pa.int64()), pa.array(runs, kind), pa.array(collapsed, pa.string())],
                names=out.names,
            )

    return source.mapInArrow(run, out)
