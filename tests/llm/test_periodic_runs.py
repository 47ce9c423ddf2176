"""Runs against a plain search over all periods, and the registered query against a plain restatement."""

import hashlib
import random
import zlib

import pytest

from meshscope.llm import periodic_runs, registry
from meshscope.llm.common import words_of


def smallest_period(x):
    fail, k = [0] * len(x), 0
    for i in range(1, len(x)):
        while k and x[i] != x[k]:
            k = fail[k - 1]
        k += x[i] == x[k]
        fail[i] = k
    return len(x) - fail[-1]


def plain_runs(x, min_words=24, exponent=3):
    out = []
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_words, exponent * q) and smallest_period(x[i : i + length]) == q:
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def some_words(r):
    x = []
    for _ in range(r.randint(1, 6)):
        if r.random() < 0.5:
            x += [r.randint(0, r.choice([1, 2, 5, 300])) for _ in range(r.randint(0, 60))]
        else:
            period = [r.randint(0, r.choice([0, 1, 3, 300])) for _ in range(r.randint(1, 20))]
            length = r.randint(1, 120)
            x += (period * length)[:length]
            if r.random() < 0.3:
                x[r.randrange(len(x))] = 7
            if r.random() < 0.2:
                x = x * 3
    return x


@pytest.mark.parametrize("min_words, exponent", [(24, 3), (6, 2), (12, 4), (8, 3)])
def test_runs_of_ids(min_words, exponent):
    r = random.Random(min_words)
    for _ in range(60):
        known = {}
        ids = [known.setdefault(v, len(known)) for v in some_words(r)]
        assert periodic_runs.runs_of(ids, min_words, exponent) == plain_runs(ids, min_words, exponent)


def test_grammar_derives_the_sequence():
    r = random.Random(3)
    for _ in range(100):
        known = {}
        ids = [known.setdefault(v, len(known)) for v in some_words(r)]
        if not ids:
            continue
        symbols = len(known)
        rules, left = periodic_runs.re_pair(ids, symbols)
        text = left
        for k in range(len(rules) - 1, -1, -1):
            text = [y for s in text for y in (rules[k] if s == symbols + k else (s,))]
        assert text == ids
        pairs = list(zip(left, left[1:]))
        assert all(a == b or pairs.count((a, b)) == 1 for a, b in pairs)  # none occurs twice


def plain_row(doc_id, text):
    words = words_of(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = None
    for run in runs:
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return (
        doc_id,
        len(runs),
        *(top or (None, None, None)),
        1000 * top[1] // top[2] if top else None,
        hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query(spark, make_docs, tmp_path):
    r = random.Random(11)
    rows = [(i, "\n".join(" ".join(f"w{v}é" for v in some_words(r)) for _ in range(2))) for i in range(60)]
    long = " ".join(f"v{r.randint(0, 50)}" for _ in range(700))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "a " * 500), (203, "a " * 500), (204, "A\x0ba " * 30)]
    rows += [(k, long) for k in range(300, 320)]  # some of them get a long planted period
    make_docs(rows, ["runs", "row", "n_words"]).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(x) for x in registry.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_row(i, t) for i, t in rows), key=str)
    assert any(x[4] and x[4] > 40 for x in got)


def test_defined_results(make_docs):
    docs = make_docs([(1, None), (2, "x y " * 12), (2, "x y " * 12)], ["runs", "row", "collapsed"])
    found = {(x.row.doc_id, x.n_words, tuple(map(tuple, x.runs)), x.collapsed) for x in periodic_runs.find_runs(docs).collect()}
    assert found == {(1, 0, (), ""), (2, 24, ((0, 24, 2),), "x y")}
    assert periodic_runs.find_runs(docs).first().row.collapsed in ("x1", "x2")
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(docs, exponent=1)
