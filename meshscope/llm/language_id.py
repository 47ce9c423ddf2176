"""Language identification by word-first backoff.

A known word scores, for each language, the log of its relative frequency there.
A word the model does not know falls back to its character 5-grams, and if none
of those is known to 4-grams, and so on down to single letters.  A text's
language has the highest sum over its words.

The model is fitted on at most ``TRAIN_DOCS`` documents of each language (those
with the least hash) and keeps the ``MAX_GRAMS`` most frequent words and n-grams
of each order and language, so what is broadcast is bounded by parameters.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if no language could be learned; ties go to the language that
comes first in order; equal texts get equal results; an empty table gives an
empty table; more than ``MAX_LANGUAGES`` languages are an error.  Texts are read
whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.llm.common import Remembered, append, column, struct

TRAIN_DOCS = 3000  # documents of each language the model is fitted on
MAX_GRAMS = 50_000  # words, and n-grams of each order, kept for each language
MIN_COUNT = 2  # a word seen once in training counts as unseen
MAX_LANGUAGES = 500  # the model has a column for each
ORDERS = (5, 4, 3, 2, 1)
WORDS = 0  # the order number of whole words
SMOOTHING = 0.5
REMEMBER = 100_000  # unseen words a task remembers
UNKNOWN = "und"

#: Marks that go on with a word (letters are told from other word signs by ``str.isalpha``).
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1F000)) if unicodedata.category(c)[0] == "M")
_LETTERS = re.compile(rf"[^\W\d_]+(?:[{_MARKS}]+[^\W\d_]*)*")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and marks with a letter; numbers such as ½ or Ⅷ are none."""
    found = _LETTERS.findall((text or "").lower())
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams; from two characters on, word ends count as characters."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


# ---- fit ---------------------------------------------------------------------

_COUNTS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("order", T.IntegerType()),
        T.StructField("gram", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def sample(train: DataFrame, lang_col: str, key: Column, most: int) -> DataFrame:
    """At most ``most`` rows of each language: those with the least hash of ``key``."""
    totals = train.groupBy(column(lang_col).alias("_lang")).agg(F.count(F.lit(1)).alias("_total"))
    known = totals.limit(MAX_LANGUAGES + 1).collect()
    if len(known) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    totals = train.sparkSession.createDataFrame(known, totals.schema)  # bounded by the check
    hashed = train.withColumn("_hash", F.pmod(key, F.lit(1 << 40)) / F.lit(1 << 40))
    near = hashed.join(F.broadcast(totals), column(lang_col) == F.col("_lang")).filter(
        F.col("_hash") < 2.0 * most / F.col("_total")
    )
    order = W.partitionBy("_lang").orderBy("_hash")
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= most)


def count_grams(rows: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, order, gram, n) over the texts of ``rows``."""
    import pyarrow as pa

    def count(batches):
        for batch in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in found.items():
                for order in (WORDS, *ORDERS):
                    counts = words
                    if order:
                        counts = Counter()
                        for w, n in words.items():
                            for g in grams_of(w, order):
                                counts[g] += n
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(counts), pa.string()),
                            pa.array([order] * len(counts), pa.int32()),
                            pa.array(list(counts), pa.string()),
                            pa.array(list(counts.values()), pa.int64()),
                        ],
                        names=_COUNTS.names,
                    )

    picked = rows.select(column(lang_col).alias("lang"), column(text_col).alias("text"))
    return picked.mapInArrow(count, _COUNTS).groupBy("lang", "order", "gram").agg(
        F.sum("n").alias("n")
    )


@dataclass
class LanguageModel:
    """Log frequencies: for each order a gram -> row index and a matrix (row, language)."""

    languages: list[str]
    index: dict[int, dict[str, int]]
    logs: dict[int, np.ndarray]

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that is not in the lexicon: the longest n-grams that are known."""
        for n in ORDERS:
            known = self.index[n]
            rows = [known[g] for g in grams_of(word, n) if g in known]
            if rows:
                return self.logs[n][rows].mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        guesses, scores = [], []
        lexicon, logs = self.index[WORDS], self.logs[WORDS]
        unseen = Remembered(self.unseen, REMEMBER)
        for text in texts:
            words = words_of(text)
            if not words or not self.languages:
                guesses.append(UNKNOWN)
                scores.append(0.0)
                continue
            rows = np.fromiter(map(lexicon.get, words, repeat(-1)), dtype=np.int64, count=len(words))
            total = logs[rows[rows >= 0]].sum(axis=0)
            for k in np.flatnonzero(rows < 0):
                total = total + unseen[words[k]]
            best = int(total.argmax())
            guesses.append(self.languages[best])
            scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        return guesses, scores


def fit(train: DataFrame, lang_col: str = "lang", text_col: str = "text", key: Column | None = None) -> LanguageModel:
    """The model of the rows of ``train`` whose language is not null."""
    known = train.filter(column(lang_col).isNotNull() & column(text_col).isNotNull())
    key = F.xxhash64(column(text_col)) if key is None else key
    counts = count_grams(sample(known, lang_col, key, TRAIN_DOCS), lang_col, text_col)
    order = W.partitionBy("lang", "order").orderBy(F.desc("n"), "gram")
    totals = F.sum("n").over(W.partitionBy("lang", "order"))
    kept = (
        counts.withColumn("total", totals)
        .withColumn("rank", F.row_number().over(order))
        .filter((F.col("rank") <= MAX_GRAMS) & ((F.col("order") != WORDS) | (F.col("n") >= MIN_COUNT)))
        .select("lang", "order", "gram", "n", "total")
        .toArrow()
    )
    languages = sorted(kept.column("lang").unique().to_pylist())
    place = {x: k for k, x in enumerate(languages)}
    index, logs = {}, {}
    for n in (WORDS, *ORDERS):
        part = kept.filter(pc.equal(kept.column("order"), n)).to_pandas()
        grams = sorted(part["gram"].unique())
        index[n] = {g: k for k, g in enumerate(grams)}
        table = np.zeros((len(grams), len(languages)), dtype=np.float32)
        table[part["gram"].map(index[n]).astype(int), part["lang"].map(place).astype(int)] = part["n"]
        totals_ = np.ones(len(languages))
        for lang, total in part.groupby("lang")["total"].first().items():
            totals_[place[lang]] = total
        logs[n] = np.log((table + SMOOTHING) / (totals_ + SMOOTHING * max(1, len(grams))))
    return LanguageModel(languages, index, logs)


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the kept columns), ``lang_pred`` and ``score`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        return list(shared.value.predict(texts))

    return append(docs, text_col, struct(lang_pred=T.StringType(), score=T.DoubleType()), run, keep)
