"""Document quality by a linear-chain conditional random field over lines.

Every line is labelled good or bad.  Its features are shares and counts of its
own text and those of the lines before and after it; the chain adds weights for
a label following a label.  Training lines carry the label of their document.
A document's score is the mean of its lines' forward-backward marginals of
"good", weighted by length.

The weights are fitted by L-BFGS; each gradient is a Spark job over the features
of a bounded sample (at most ``TRAIN_DOCS`` documents of either label, those
with the least hash), of which only sums reach the driver.

Defined results: a text without words (null, empty) is one empty line; without
training rows of both labels the score is the share of label 1 (0.5 without
any); equal texts get equal scores; an empty table gives an empty table.  Texts
are read whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import log1p, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.llm.common import append, column, struct, words_of
from meshscope.llm.quality_rules import SYMBOLS, repeated_words
from meshscope.plans.iterate import Workspace

TRAIN_DOCS = 3000  # documents of each label the field is fitted on
STEPS = 40  # at most so many L-BFGS steps
PENALTY = 1e-3
MEMORY = 8

_PLAIN = re.compile(r"(?<!\S)[(\"'«¿¡]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)\"'»]?(?!\S)")
_STOP = re.compile(r"[.!?](?=\s|$)")
#: A character of which ``str.isdigit`` may be true.
_DIGIT = re.compile(r"\d|[^\x00-\x7f]")
LINE_FEATURES = 16
FEATURES = 3 * LINE_FEATURES + 1  # the line's, the last one's, the next one's, and one constant
WEIGHTS = FEATURES + 4  # and transitions: bad-bad, bad-good, good-bad, good-good


def line_features(line: str, words: list[str], seen: set[str]) -> list[float]:
    n, size = len(words), max(1, len(line))
    if not n:
        return [0.0] * (LINE_FEATURES - 1) + [1.0]
    repeat, distinct, top = repeated_words(words)
    chars = sum(map(len, words))
    again = float(line in seen)
    seen.add(line)
    return [
        log1p(n),
        log1p(len(line)),
        chars / n,
        sum(line.count(c) for c in SYMBOLS) / n,
        len(_PLAIN.findall(line)) / n,
        sum(1 for w in words if len(w) > 1 and w.isupper()) / n,
        len(_STOP.findall(line)) / n,
        line.count(",") / n,
        line.count("!") / n,
        float(line.rstrip()[-1] in ".!?\"'»)"),
        distinct / sqrt(n),
        top / n,
        repeat / n,
        (sum(map(str.isdigit, line)) if _DIGIT.search(line) else 0) / size,
        again,
        0.0,
    ]


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, FEATURES) and the length of each line with a word (or of one empty line)."""
    split = [(x, words_of(x)) for x in (text or "").split("\n")]
    split = [(x, words) for x, words in split if words] or [("", [])]
    lines = [x for x, _ in split]
    seen: set[str] = set()
    own = np.array([line_features(x, words, seen) for x, words in split], dtype=np.float32)
    none = np.zeros((1, LINE_FEATURES), dtype=np.float32)
    last, next_ = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    one = np.ones((len(own), 1), dtype=np.float32)
    return np.concatenate([own, last, next_, one], axis=1), np.array([max(1, len(x)) for x in lines])


# ---- the field ---------------------------------------------------------------


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray):
    """Forward-backward over padded chains.

    ``scores``: (chains, lines) score of "good" over "bad"; ``moves``: (2, 2).
    Returns P(good) of each line, expected moves of each chain (chains, 2, 2) and
    log normalisers.
    """
    chains, width = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], axis=2)
    forward = np.empty((chains, width, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, width):
        forward[:, t] = _log_sum(forward[:, t - 1, :, None] + moves, 1) + emit[:, t]
    last = lengths - 1
    norm = _log_sum(forward[np.arange(chains), last], 1)
    backward = np.zeros((chains, width, 2))
    expected = np.zeros((chains, 2, 2))
    for t in range(width - 2, -1, -1):
        inside = t < last
        ahead = emit[:, t + 1] + backward[:, t + 1]
        step = _log_sum(moves + ahead[:, None, :], 2)
        backward[:, t] = np.where(inside[:, None], step, 0.0)
        joint = forward[:, t, :, None] + moves + ahead[:, None, :] - norm[:, None, None]
        expected += np.where(inside[:, None, None], np.exp(np.minimum(joint, 0.0)), 0.0)
    return np.exp(np.minimum(forward[:, :, 1] + backward[:, :, 1] - norm[:, None], 0.0)), expected, norm


def _padded(parts: list[np.ndarray], cells: int = 1 << 18):
    """Index lists of parts of similar length, each padded to at most ``cells`` lines."""
    order = sorted(range(len(parts)), key=lambda k: len(parts[k]))
    held: list[int] = []
    for k in order:
        if held and (len(held) + 1) * len(parts[k]) > cells:
            yield held
            held = []
        held.append(k)
    if held:
        yield held


def _run_chains(scores: list[np.ndarray], moves: np.ndarray):
    """``marginals`` of chains of any lengths: (chain, P(good) of its lines, moves, norm)."""
    for held in _padded(scores):
        lengths = np.array([len(scores[k]) for k in held])
        table = np.zeros((len(held), int(lengths.max())))
        for row, k in enumerate(held):
            table[row, : lengths[row]] = scores[k]
        good, expected, norm = marginals(table, lengths, moves)
        for row, k in enumerate(held):
            yield k, good[row, : lengths[row]], expected[row], norm[row]


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float | None = None  # the constant score if there was nothing to learn from

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.prior is not None:
            return [self.prior] * len(texts)
        w, moves = self.weights[:FEATURES], self.weights[FEATURES:].reshape(2, 2)
        chains, lengths = [], []
        for text in texts:
            x, size = document_features(text)
            chains.append(((x - self.mean) / self.scale) @ w)
            lengths.append(size)
        out = [0.0] * len(texts)
        for k, good, _, _ in _run_chains(chains, moves):
            out[k] = float(np.clip((good * lengths[k]).sum() / lengths[k].sum(), 0.0, 1.0))
        return out


def _loss_rows(weights, mean, scale):
    """A mapInArrow function: (loss and gradient of the documents of each batch)."""

    def run(batches):
        w, moves = weights[:FEATURES], weights[FEATURES:].reshape(2, 2)
        for batch in batches:
            labels = batch.column(0).to_pylist()
            parts = [
                (np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) - mean) / scale
                for b in batch.column(1).to_pylist()
            ]
            loss, slope = 0.0, np.zeros(WEIGHTS)
            for k, good, expected, norm in _run_chains([x @ w for x in parts], moves):
                x, y, n = parts[k], labels[k], len(parts[k])
                share = 1.0 / n  # every document weighs the same
                gold = (x @ w).sum() * y + (n - 1) * moves[y, y]
                loss += share * (norm - gold)
                slope[:FEATURES] += share * (x.T @ (good - y))
                seen = np.zeros((2, 2))
                seen[y, y] = n - 1
                slope[FEATURES:] += share * (expected - seen).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([loss]), pa.array([slope.tolist()])], names=["loss", "slope"]
            )

    return run


def _minimise(value_and_slope, start: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS with a halving line search."""
    x, (f, g) = start, value_and_slope(start)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step = 1.0
        for _ in range(12):
            new = x - step * q
            f_new, g_new = value_and_slope(new)
            if f_new <= f - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            return x
        s, y = new - x, g_new - g
        if s @ y > 1e-10:
            past = [*past, (s, y)][-MEMORY:]
        done = f - f_new < 1e-4 * max(1.0, abs(f))
        x, f, g = new, f_new, g_new
        if done:
            break
    return x


def sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` ids of each label: those with the least hash."""
    rows = labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    order = W.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    train_docs: int = TRAIN_DOCS,
) -> Field:
    """The field of the labelled rows; ``labels`` holds the rows to learn from only."""
    space = Workspace(docs.sparkSession, "line_crf")
    picked = space.materialize(
        sample(labels, id_col, label_col, train_docs).select("id", "label"), "sample"
    )
    # at most 2 * train_docs ids: a bounded side
    joined = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).join(
        F.broadcast(picked), "id"
    )

    def make(texts):
        return [[document_features(t)[0].tobytes() for t in texts]]

    lines = space.materialize(
        append(joined, "text", struct(lines=T.BinaryType()), make, ["label"]).select("row.label", "lines"),
        "lines",
    )

    def moments(batches):
        for batch in batches:
            x = np.concatenate(
                [np.frombuffer(b, dtype=np.float32).reshape(-1, FEATURES) for b in batch.column(1).to_pylist()]
            ).astype(float)
            labels_ = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(x)]),
                    pa.array([len(labels_)]),
                    pa.array([sum(labels_)]),
                    pa.array([x.sum(0).tolist()]),
                    pa.array([(x * x).sum(0).tolist()]),
                ],
                names=["n", "docs", "good", "a", "b"],
            )

    found = lines.mapInArrow(
        moments, "n long, docs long, good long, a array<double>, b array<double>"
    ).collect()
    docs_, good = sum(r["docs"] for r in found), sum(r["good"] for r in found)
    if not 0 < good < docs_:
        return Field(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(WEIGHTS), good / docs_ if docs_ else 0.5)
    n = sum(r["n"] for r in found)
    mean = sum(np.array(r["a"]) for r in found) / n
    scale = np.sqrt(np.maximum(sum(np.array(r["b"]) for r in found) / n - mean**2, 0.0))
    scale = np.where(scale < 1e-6, 1.0, scale)
    mean[-1], scale[-1] = 0.0, 1.0

    def value_and_slope(weights):
        sums = lines.mapInArrow(
            _loss_rows(weights, mean, scale), "loss double, slope array<double>"
        ).collect()
        loss = sum(r["loss"] for r in sums) / docs_
        slope = sum(np.array(r["slope"]) for r in sums) / docs_
        return loss + PENALTY * weights @ weights / 2, slope + PENALTY * weights

    return Field(mean, scale, _minimise(value_and_slope, np.zeros(WEIGHTS), STEPS))


def score(docs: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns) and ``score`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(texts):
        return [shared.value.scores(texts)]

    return append(docs, text_col, struct(score=T.DoubleType()), run, keep)
