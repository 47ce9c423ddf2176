"""Counts against plain restatements; the label model on planted votes."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from meshscope.llm import quality_rules as q


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i])
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t\r#\x1c ", max_size=80) | st.none())
def test_counts(text):
    assert q.signals_of(text)[:5] == plain_counts(text)


def prose(rng, n):
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(n)]
    for i in range(9, n, 10):
        words[i] += "."
    return " ".join(words)


def test_verdicts(make_docs):
    rng = random.Random(5)
    good = [prose(rng, 120) for _ in range(60)]
    noise = [" ".join(w + "***" for w in prose(rng, 120).split()) for _ in range(8)]
    shout = [" ".join(w.upper() + "!!" for w in prose(rng, 120).split()) for _ in range(8)]
    loops = [" ".join(["again"] * 60 + ["more"] * 60) for _ in range(4)]
    rows = [*enumerate([*good, *noise, *shout, *loops]), (None, good[0]), (900, None), (901, ""), (902, "too short")]
    docs = make_docs(rows, extra=("kept", "votes", "row", "n_words"))
    found = {(r["row"]["doc_id"], r["row"]["text"]): r for r in q.judge(docs).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        r = found[i, text]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_counts(text)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (text in good)
    kept = q.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == len(good) + 1


def test_label_model_recovers_planted_rules():
    rng, counts = random.Random(3), {}
    rates = [(0.05, 0.7), (0.02, 0.5), (0.1, 0.8), (0.03, 0.6), (0.05, 0.6)]  # bad votes on good, on bad
    truth = []
    for _ in range(4000):
        good = rng.random() < 0.8
        vote = tuple(-1 if rng.random() < r[not good] else 1 for r in rates)
        counts.setdefault(vote, [0, 0])[good] += 1
        truth.append((vote, good))
    model = q.fit_label_model([(list(v), sum(n)) for v, n in counts.items()], len(rates))
    score = lambda v: model.log_odds + sum(
        g[x + 1] - b[x + 1] for x, g, b in zip(v, model.log_good, model.log_bad)
    )
    right = sum((score(v) > 0) == good for v, good in truth)
    best = sum(max(n) for n in counts.values())
    assert right > 0.98 * best


def test_fit_does_not_depend_on_size():
    patterns = [([1, 1, -1], 50), ([1, 1, 1], 500), ([-1, -1, 0], 70)]
    a = q.fit_label_model(patterns, 3)
    b = q.fit_label_model([(v, 1000 * n) for v, n in patterns], 3)
    assert abs(a.log_odds - b.log_odds) < 1e-6


def test_empty_table(make_docs):
    assert q.judge(make_docs([])).count() == 0
