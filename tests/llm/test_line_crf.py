"""The chain against enumeration of all labellings; held-out accuracy; odd rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshscope.llm import line_crf as crf
from meshscope.llm.common import held_out

SF = "/root/testdata/sf0.1"


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(2, 2))
    chains = [rng.normal(size=n) for n in (1, 4, 2, 5)]
    got = {k: (good, expected, norm) for k, good, expected, norm in crf._run_chains(chains, moves)}
    for k, scores in enumerate(chains):
        total, good, seen = 0.0, np.zeros(len(scores)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(scores)):
            value = math.exp(
                sum(s for s, y in zip(scores, labels) if y) + sum(moves[a, b] for a, b in zip(labels, labels[1:]))
            )
            total += value
            good += value * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                seen[a, b] += value
        assert np.allclose(got[k][0], good / total)
        assert np.allclose(got[k][1], seen / total)
        assert math.isclose(got[k][2], math.log(total))


def test_slope_is_the_derivative():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(n, crf.FEATURES)).astype(np.float32) for n in (1, 3, 5)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 0, 1]), pa.array([p.tobytes() for p in parts], pa.binary())], names=["label", "lines"]
    )
    mean, scale = np.zeros(crf.FEATURES), np.ones(crf.FEATURES)
    weights = rng.normal(size=crf.WEIGHTS) / 5

    def value(w):
        row = next(crf._loss_rows(w, mean, scale)([batch])).to_pylist()[0]
        return row["loss"], np.array(row["slope"])

    slope = value(weights)[1]
    for k in (0, 7, crf.FEATURES - 1, crf.FEATURES, crf.WEIGHTS - 1):
        step = np.zeros(crf.WEIGHTS)
        step[k] = 1e-5
        measured = (value(weights + step)[0] - value(weights - step)[0]) / 2e-5
        assert math.isclose(measured, slope[k], rel_tol=1e-4, abs_tol=1e-6)


def test_minimise():
    a = np.diag([1.0, 10.0, 100.0])
    goal = np.array([1.0, -2.0, 3.0])
    found = crf._minimise(lambda x: ((x - goal) @ a @ (x - goal) / 2, a @ (x - goal)), np.zeros(3), 60)
    assert np.allclose(found, goal, atol=0.05)


@pytest.fixture(scope="module")
def field(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    return crf.fit(docs, labels.filter(~held_out(F.col("doc_id"))), train_docs=400)


def test_held_out_accuracy(spark, field):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = docs.join(labels.select("doc_id", "quality"), "doc_id").filter(held_out(F.col("doc_id")))
    rows = crf.score(judged, field, keep=["quality"]).select("row.quality", "score").collect()
    right = sum((r["score"] >= 0.3) == bool(r["quality"]) for r in rows)
    good = [r["score"] >= 0.3 for r in rows if r["quality"]]
    assert right / len(rows) > 0.97 and sum(good) / len(good) > 0.99


def test_odd_rows(make_docs, field):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "A text. With words in it."), (5, "a b\n" * 20_000), (5, "x" * 100_000)]
    found = crf.score(make_docs(rows, extra=("row", "score", "label")), field).collect()
    assert len(found) == len(rows) and all(0.0 <= r["score"] <= 1.0 for r in found)
    empty = {r["score"] for r in found if not (r["row"]["text"] or "").strip()}
    assert len(empty) == 1


def test_nothing_to_learn_from(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = make_docs([(1, "some words")])
    assert crf.score(docs, crf.fit(docs, none)).first()["score"] == 0.5
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 7)], "doc_id long, quality int")
    assert crf.score(docs, crf.fit(docs, one)).first()["score"] == 1.0
    assert crf.score(make_docs([]), crf.fit(make_docs([]), none)).count() == 0
