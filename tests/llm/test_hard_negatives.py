"""Mined negatives against brute force over all pairs, and the registered query against its SQL."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshscope.llm import hard_negatives, registry


def plain(rows, is_anchor, positives=5, negatives=5, band=(80, 100)):
    """rows: (id, label, vector) of distinct rows that take part."""
    out = []
    for i, label, x in rows:
        if not is_anchor(i):
            continue
        met = [
            (-sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in rows if j != i and len(y) == len(x)
        ]
        same = sorted((s, j) for s, j, m in met if m == label)[:positives]
        for s, j in same:
            fit = sorted(
                (t, n) for t, n, m in met if m != label and band[0] * -s <= 100 * -t <= band[1] * -s
            )[:negatives]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def table(spark, rows, extra=()):
    names = ["vec_id long", "label int", "embedding array<float>", *[f"`{c}` string" for c in extra]]
    return spark.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], ", ".join(names))


def test_bound_and_walk():
    r = np.random.default_rng(5)
    rows = r.integers(-40, 60, size=(700, 8)).astype(float)
    rows[::9] = rows[3]  # many equal rows
    members = np.concatenate([rows[:20], np.zeros((1, 8))])
    for c in np.unique(groups := hard_negatives.clusters_of(members, 4)):
        own = members[groups == c]
        bound = hard_negatives.bounds(own, rows)
        assert (own @ rows.T <= np.linalg.norm(own, axis=1)[:, None] * bound + 1e-3).all()
    order = np.arange(len(rows))
    low, high = np.full(21, -500), np.full(21, 3000)
    got = hard_negatives.walk(
        members, np.arange(21), lambda a, p: np.ones((len(a), len(p)), bool), low, high, rows, order, order, 5
    )
    found = {}
    for q, row, s in zip(*got):
        found.setdefault(int(q), []).append((int(s), int(row)))
    for q in range(21):
        scores = (rows @ members[q]).astype(int)
        want = sorted(((-s, k) for k, s in enumerate(scores) if -500 <= s <= 3000))[:5]
        assert sorted((-s, k) for s, k in found.get(q, [])) == want


@pytest.mark.parametrize("spread", [1, 3])
def test_mine(spark, monkeypatch, spread):
    if spread == 3:  # several groups, blocks and pages
        for name, value in (("ROWS", 40), ("ANCHORS", 7), ("PAGE", 8), ("CLUSTERS", 3), ("BLOCKS", 1)):
            monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(spread)
    rows = []
    for i in range(260):
        size = 3 if i % 50 == 1 else 6
        rows.append((i, r.randint(0, 3), [float(r.randint(-9, 12)) for _ in range(size)]))
    rows += [(1000 + i, i % 2, [5.0] * 6) for i in range(40)]  # ties
    rows += [(2000, 1, [0.0] * 6), (2010, 1, [])]
    asks = lambda i: i % 10 == 0
    want = plain(rows, asks)
    again = rows + rows[:30]  # equal rows count once
    again += [(None, 1, [1.0] * 6), (5000, None, [1.0] * 6), (5010, 1, None), (5020, 1, [1.0, None]), (5030, 1, [float("nan")])]
    got = hard_negatives.mine(table(spark, again, ["anchor_id", "block", "h"]), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 300


def test_large_numbers_are_exact():
    a = np.array([[2.0**40, 1.0]])
    b = np.array([[2.0**22, 3.0], [2.0**22, 4.0]])
    assert hard_negatives.products(a, b).tolist() == [[2**62 + 3, 2**62 + 4]]


def test_query_matches_sql(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, r.randint(0, 9), [r.gauss(0.02, 0.1) for _ in range(16)]) for i in range(700)]
    rows += [(700, None, [0.1] * 16), (1400, 3, None), (900, 2, [float("inf")] * 16), (901, 2, [None] * 16)]
    table(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = con.execute(registry.ORACLE_SQL["op13_hard_negatives"])
    names = [c[0] for c in found.description]
    df = registry.op13_hard_negatives(spark, str(tmp_path))
    assert df.columns == names
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_empty_table(spark):
    got = hard_negatives.mine(table(spark, []), F.lit(True))
    assert got.collect() == []
    assert got.columns[0] == "anchor_id"
