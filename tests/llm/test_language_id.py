"""Language identification: backoff, held-out accuracy, odd rows."""

import math

import pytest
from pyspark.sql import functions as F

from meshscope.llm import language_id as li
from meshscope.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return li.fit(docs.filter(~held_out(F.col("doc_id"))), key=F.xxhash64("doc_id", "text"))


def test_held_out_accuracy(docs, model):
    found = li.identify(docs.filter(held_out(F.col("doc_id"))), model)
    right, n = found.agg(F.count_if(F.col("row.lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 150 and right / n > 0.97


def test_word_then_shorter_grams(spark):
    rows = [("aa", "tree tree tree house"), ("bb", "baum baum haus haus"), (None, "tree")]
    model = li.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert set(model.index[li.WORDS]) == {"tree", "baum", "haus"}  # seen once is unseen
    seen = model.logs[li.WORDS][model.index[li.WORDS]["tree"]]
    assert math.isclose(seen[0], math.log((3 + 0.5) / (4 + 0.5 * 3)))
    assert model.predict(["treeish", "hausbau", "q"])[0][:2] == ["aa", "bb"]
    assert model.unseen("q").tolist() == [0.0, 0.0]
    grams = [g for g in li.grams_of("trees", 5) if g in model.index[5]]
    assert grams == ["<tree"]
    assert model.unseen("trees").tolist() == model.logs[5][model.index[5]["<tree"]].tolist()


def test_odd_rows(make_docs, model):
    rows = [(1, None), (2, ""), (3, "12 -- 34"), (None, "the of and that with"), (5, "x" * 50_000), (5, "x" * 50_000)]
    found = li.identify(make_docs(rows, extra=("row", "lang_pred", "held_out")), model).collect()
    by_text = {r["row"]["text"]: r for r in found}
    assert len(found) == len(rows)
    assert [(by_text[t]["lang_pred"], by_text[t]["score"]) for t in (None, "", "12 -- 34")] == [("und", 0.0)] * 3
    assert by_text["the of and that with"]["lang_pred"] == "en"
    assert all(0.0 <= r["score"] <= 1.0 for r in found)


def test_bounded_sample(make_docs):
    docs = make_docs([(i, "same text") for i in range(40)])
    picked = li.sample(docs, "lang", F.xxhash64("doc_id"), 7)
    assert picked.count() == 7


def test_nothing_to_learn_from(make_docs):
    model = li.fit(make_docs([]))
    assert li.identify(make_docs([(1, "some words")]), model).first()["lang_pred"] == "und"
    assert li.identify(make_docs([]), model).count() == 0


def test_words_are_letters_and_marks():
    from meshscope.llm.language_id import words_of

    assert words_of("½ ² ① Ⅷ 12 _ ٣") == []
    assert words_of("हिन्दी x² Été a1b") == ["हिन्दी", "x²", "été", "a", "b"]
    assert words_of("été l'eau") == ["été", "l", "eau"]
