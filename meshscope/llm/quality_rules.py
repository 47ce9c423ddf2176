"""Quality rules by weak supervision.

Each rule looks at counts of one document and votes good (1), bad (-1) or
abstains (0).  Documents are grouped by their vote pattern (a table bounded by
3 ** rules, whatever the corpus size), and expectation-maximisation over the
pattern counts estimates, for either class, how often each rule gives each
vote.  A document's verdict is its posterior probability of being good.

Defined results: a null or empty text has no words, every rule abstains, the
base rule fails and the document is rejected; equal texts get equal verdicts;
an empty table gives an empty table and the prior model.  Texts are read whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.llm.common import append, struct, unpack, words_of
from meshscope.plans.iterate import Workspace

SYMBOLS = "#*$%&|<>"
# A word of letters with at most one closing punctuation mark, between spaces.
_PLAIN = re.compile(r"(?<!\S)[(\"'«¿¡]?[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?)\"'»]?(?!\S)")
_STOP = re.compile(r"[.!?](?=\s|$)")

SIGNALS = struct(
    n_words=T.LongType(),
    word_chars=T.LongType(),
    n_symbols=T.LongType(),
    n_dup_lines=T.LongType(),
    n_repeat_words=T.LongType(),
    n_lines=T.LongType(),
    n_plain=T.LongType(),
    n_upper=T.LongType(),
    n_stops=T.LongType(),
    n_distinct=T.LongType(),
    n_top=T.LongType(),
)


SHORT = 64  # fewer words are counted without arrays


def _repeated_in_short(words: list[str]) -> tuple[int, int, int]:
    times: dict[str, int] = {}
    for w in words:
        times[w] = times.get(w, 0) + 1
    n, distinct = len(words), len(times)
    if n < 4 or distinct == n:
        return 0, distinct, max(times.values())
    windows = list(zip(words, words[1:], words[2:]))
    seen: set[tuple[str, ...]] = set()
    again = {x for x in windows if x in seen or seen.add(x)}
    hit = {i + k for i, x in enumerate(windows) if x in again for k in range(3)} if again else ()
    return len(hit), distinct, max(times.values())


def repeated_words(words: list[str]) -> tuple[int, int, int]:
    """Words inside 3-word windows that occur at least twice; distinct words; the top word's count."""
    n = len(words)
    if not n:
        return 0, 0, 0
    if n < SHORT:
        return _repeated_in_short(words)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    distinct, top = len(number), int(np.bincount(ids).max())
    if n < 4 or distinct == n:
        return 0, distinct, top
    pair = ids[:-2] * distinct + ids[1:-1]
    if distinct > 2_000_000:  # the product of three numbers would leave 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, place, count = np.unique(pair * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = count[place] > 1
    hit = np.zeros(n, dtype=bool)
    for shift in range(3):
        hit[shift : shift + len(again)] |= again
    return int(hit.sum()), distinct, top


def signals_of(text: str | None) -> tuple[int, ...]:
    """The counts of ``SIGNALS`` for one whole text."""
    text = text or ""
    words = words_of(text)
    repeat, distinct, top = repeated_words(words)
    lines = [x for x in text.split("\n") if words_of(x)] if "\n" in text else [text] * bool(words)
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat,
        len(lines),
        len(_PLAIN.findall(text)),
        sum(1 for w in words if len(w) > 1 and w.isupper()),
        len(_STOP.findall(text)),
        distinct,
        top,
    )


def _signal_columns(texts: list[str | None]) -> list:
    rows = [signals_of(t) for t in texts]
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in SIGNALS.fields]


def signals(docs: DataFrame, text_col: str = "text", keep=None) -> DataFrame:
    """``row`` (struct of the kept columns) and the counts of each document."""
    return append(docs, text_col, SIGNALS, _signal_columns, keep)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules: each maps the counts of one document to -1, 0 or 1.

    Rules on shares abstain on texts without words (shares are null there).
    """
    n = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    share = {k: F.col(k) / n for k in ("n_symbols", "n_plain", "n_upper", "n_repeat_words", "n_stops", "n_top", "word_chars")}
    dup = F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)).cast("double")
    variety = F.col("n_distinct") / F.sqrt(n)
    stops, chars, top = share["n_stops"], share["word_chars"], share["n_top"]
    return {
        "symbols": _vote(share["n_symbols"] > 0.10, share["n_symbols"] < 0.02),
        "plain_words": _vote(share["n_plain"] < 0.70, share["n_plain"] > 0.90),
        "capitals": _vote(share["n_upper"] > 0.30, share["n_upper"] < 0.10),
        "repeats": _vote(share["n_repeat_words"] > 0.40, share["n_repeat_words"] < 0.15),
        "sentences": _vote((stops < 0.01) | (stops > 0.5), (stops > 0.02) & (stops < 0.35)),
        "top_word": _vote(top > 0.25, (top < 0.15) & (n >= 30)),
        "variety": _vote((variety < 2.0) & (n >= 30), variety > 4.0),
        "word_length": _vote((chars < 2.5) | (chars > 12), (chars > 3.2) & (chars < 9)),
        "dup_lines": _vote((dup > 0.5) & (F.col("n_lines") >= 4), F.lit(False)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vote_column() -> Column:
    return F.array(*[v.cast("int") for v in votes().values()])


# ---- the label model ---------------------------------------------------------

OUTCOMES = (-1, 0, 1)
PRIOR_WEIGHT = 0.10  # pseudo-documents of the prior, as a share of all documents
EXPECTED = {"good": (0.02, 0.18, 0.80), "bad": (0.40, 0.25, 0.35)}  # votes -1, 0, 1


@dataclass(frozen=True)
class LabelModel:
    """``log_good[j][k]``: log probability of outcome k of rule j for good documents."""

    log_odds: float
    log_good: tuple[tuple[float, ...], ...]
    log_bad: tuple[tuple[float, ...], ...]

    def probability(self, vote: Column) -> Column:
        """Posterior probability of good, as an expression over the vote array."""
        total = F.lit(self.log_odds)
        for j, (g, b) in enumerate(zip(self.log_good, self.log_bad)):
            gain = [x - y for x, y in zip(g, b)]
            v = vote[j]
            total = total + F.when(v == -1, gain[0]).when(v == 1, gain[2]).otherwise(gain[1])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_label_model(
    patterns: list[tuple[list[int], int]], rules: int, rounds: int = 100, tolerance: float = 1e-6
) -> LabelModel:
    """Expectation-maximisation over (vote pattern, documents with it).

    Starts from "bad if more rules say bad than half of those that say good";
    the prior of ``EXPECTED`` keeps the classes from changing places.  Its weight
    is a share of the documents, so the fit is the same at every corpus size.
    """
    patterns = sorted((tuple(p), n) for p, n in patterns)
    counts = np.array([n for _, n in patterns], dtype=float)
    votes_ = np.array([p for p, _ in patterns], dtype=int).reshape(len(patterns), rules)
    total = max(counts.sum(), 1.0)
    hot = np.stack([votes_ == o for o in OUTCOMES], axis=2).astype(float)  # pattern, rule, outcome
    prior = {k: PRIOR_WEIGHT * total * np.array(v) for k, v in EXPECTED.items()}
    bad_votes, good_votes = (votes_ == -1).sum(1), (votes_ == 1).sum(1)
    good = np.where(bad_votes >= 2, 0.1, np.where(bad_votes > 0, 0.4, np.where(good_votes > 0, 0.9, 0.5)))
    odds, like = 0.0, None
    for _ in range(rounds):
        g, b = counts * good, counts * (1 - good)
        p_good = (np.einsum("p,pro->ro", g, hot) + prior["good"]) / (g.sum() + prior["good"].sum())
        p_bad = (np.einsum("p,pro->ro", b, hot) + prior["bad"]) / (b.sum() + prior["bad"].sum())
        share = (g.sum() + 0.8 * PRIOR_WEIGHT * total) / (total * (1 + PRIOR_WEIGHT) if counts.size else PRIOR_WEIGHT)
        odds = math.log(share / (1 - share))
        like = (np.log(p_good), np.log(p_bad))
        score = odds + np.einsum("pro,ro->p", hot, like[0] - like[1])
        new = 1 / (1 + np.exp(-score))
        moved = np.abs(new - good).max(initial=0.0)
        good = new
        if moved < tolerance:
            break
    return LabelModel(odds, *[tuple(map(tuple, x.tolist())) for x in like])


def count_patterns(voted: DataFrame) -> list[tuple[list[int], int]]:
    """Documents by vote pattern: at most 3 ** rules rows reach the driver."""
    rows = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return [(list(r["votes"]), r["n"]) for r in rows]


def judge(docs: DataFrame, text_col: str = "text", keep=None, threshold: float = 0.5) -> DataFrame:
    """``row``, the counts, ``votes``, ``quality_probability``, ``base_failed`` and ``kept``.

    The counts (with the kept columns) are written once to the shared folder;
    the label model is fitted on them and applied to them, so each text is
    analysed once.
    """
    space = Workspace(docs.sparkSession, "quality_rules")
    seen = space.materialize(
        signals(docs, text_col, keep).withColumn("votes", vote_column()), "signals"
    )
    model = fit_label_model(count_patterns(seen), len(votes()))
    return (
        seen.withColumn("quality_probability", model.probability(F.col("votes")))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))
    )


def filter_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return unpack(judge(docs, text_col).filter("kept"))
