"""Scores against a plain suffix tree in dictionaries, and the registered query on small tables."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshscope.llm import registry, suffix_tree, tokens
from meshscope.plans.iterate import Workspace

END = object()


def plain_tokens(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return [*words, END]


class Plain:
    """The same tree, by the definition: the longest state, probabilities by recursion."""

    def __init__(self, texts, depth, penalty):
        self.n = Counter()
        for text in texts:
            t = plain_tokens(text)
            for k in range(depth + 1):
                for i in range(len(t) - k):
                    self.n[tuple(t[i : i + k + 1])] += 1
        one = [c for g, c in self.n.items() if len(g) == 1]
        self.N, self.V = sum(one), len(one)
        self.followers = defaultdict(dict)
        for g, c in self.n.items():
            if len(g) > 1:
                self.followers[g[:-1]][g[-1]] = c
        self.states = {()}
        for size in range(1, depth + 1):
            for s, next_ in self.followers.items():
                if len(s) == size and s[1:] in self.states:
                    again = [(a, c) for a, c in next_.items() if c > 1]
                    gain = sum(c * math.log(self.share(s, a) / self.share(s[1:], a)) for a, c in again)
                    once = self.n[s] - sum(c for _, c in again)
                    gain += once * math.log(self.left(s))
                    if again and gain > penalty * len(again):
                        self.states.add(s)

    def left(self, s):
        return 1 - sum(c - 1 for c in self.followers[s].values()) / self.n[s]

    def root(self, a):
        return (self.n[(a,)] + 0.1) / (self.N + 0.1 * (self.V + 1))

    def share(self, s, a):
        if not s:
            return self.root(a)
        return max(self.followers[s].get(a, 1) - 1, 0) / self.n[s] + self.left(s) * self.share(s[1:], a)

    def row(self, text, depth):
        t = plain_tokens(text)
        score = 0.0
        for i, a in enumerate(t):
            s = next(s for k in range(min(depth, i), -1, -1) if (s := tuple(t[i - k : i])) in self.states)
            score += math.log10(self.share(s, a))
        base = sum(math.log10(self.root(a)) for a in t)
        return len(t), sum(self.n[(a,)] > 0 for a in t), base, score


def some_texts(r, n):
    words = ["the", "of", "The", "a", "é", "x1", *[f"w{k}" for k in range(40)]]
    phrase = [r.choice(words) for _ in range(12)]
    out = []
    for _ in range(n):
        t = [r.choice(words[: r.choice([4, 46])]) for _ in range(r.randint(0, 40))]
        if r.random() < 0.4:
            t += phrase[: r.randint(1, 12)]
        out.append(r.choice([" ", "\n", "\t "]).join(t))
    return out


def test_keys():
    r = random.Random(2)
    texts = [None, "", " ", "a", *some_texts(r, 50), "A b\x0bc d e", "x" * 5000 + " y", "end"]
    keys, bounds = tokens.word_keys(pa.array(texts), lower=True)
    words = [w for t in texts for w in plain_tokens(t)[:-1]]
    sizes = [len(plain_tokens(t)) - 1 for t in texts]
    assert np.diff(bounds).tolist() == sizes
    assert len(set(zip(words, keys.tolist()))) == len(set(words)) == len(set(keys.tolist()))
    cut = [tokens.word_keys(part, lower=True)[0] for _, part in tokens.slices(pa.array(texts))]
    assert np.concatenate(cut).tolist() == keys.tolist()


def test_pair_keys_agree_with_the_engine(spark):
    r = np.random.default_rng(1)
    a, b = (r.integers(-(2**63), 2**63 - 1, 50) for _ in range(2))
    df = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long")
    got = [x[0] for x in df.select(F.xxhash64("a", "b")).collect()]
    assert tokens.paired(a.view(np.uint64), b.view(np.uint64)).view(np.int64).tolist() == got


def test_filter_holds_its_keys(spark):
    keys = np.random.default_rng(4).integers(-(2**63), 2**63 - 1, 3000)
    bits = suffix_tree._bits(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert suffix_tree._inside(bits, keys.view(np.uint64)).all()
    assert int(np.unpackbits(bits).sum()) <= 3000


@pytest.mark.parametrize("depth, penalty", [(2, 0.5), (3, 0.1), (1, 2.0)])
def test_scores(make_docs, monkeypatch, depth, penalty):
    r = random.Random(depth)
    if depth == 3:
        monkeypatch.setattr(suffix_tree, "HELD", 300)
    train = [*some_texts(r, 150), None, ""]
    other = [*some_texts(r, 40), None, "", "unseen words only", "the " * 70000 if depth == 1 else "of of", train[0], train[0]]
    tree = suffix_tree.fit(make_docs(list(enumerate(train))), depth=depth, penalty=penalty)
    plain = Plain(train, depth, penalty)
    assert (tree.tokens, tree.types) == (plain.N, plain.V)
    assert [s.count() for s in tree.states] == [sum(len(s) == k for s in plain.states) for k in range(1, depth + 1)]
    if depth > 1:
        assert tree.states[1].count() > 3
    docs = make_docs(list(enumerate(other)), ["uid", "score", "key"])
    got = {x.row.doc_id: (x.n_tokens, x.n_known, x.base_score, x.score) for x in suffix_tree.score(docs, tree).collect()}
    for i, text in enumerate(other):
        want = plain.row(text, depth)
        assert got[i][:2] == want[:2]
        assert got[i][2:] == pytest.approx(want[2:], rel=1e-9, abs=1e-9)


def test_nothing_to_learn_from(make_docs):
    tree = suffix_tree.fit(make_docs([]))
    got = suffix_tree.score(make_docs([(1, "a b"), (1, "a b"), (2, None)]), tree)
    found = sorted((x.row.doc_id, x.n_tokens, x.n_known, x.base_score, x.score) for x in got.collect())
    assert found == [(1, 3, 0, 0.0, 0.0), (1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)]
    assert suffix_tree.score(make_docs([]), tree).count() == 0


def test_query(spark, make_docs, tmp_path):
    r = random.Random(12)
    rows = list(enumerate(some_texts(r, 200)))
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in registry.op12_suffix_tree(spark, str(tmp_path)).collect()}
    out = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0}
    plain = Plain([t for i, t in rows if i not in out], suffix_tree.DEPTH, suffix_tree.PENALTY)
    for i, text in rows:
        x = got[i]
        assert x.held_out == (i in out) and x.train_tokens == plain.N
        assert (x.n_tokens, x.n_known, *map(lambda v: round(v, 7), (x.base_score, x.score))) == tuple(
            round(v, 7) for v in plain.row(text, suffix_tree.DEPTH)
        )
    held = [got[i] for i in out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)


def test_tables_go_when_no_longer_read(make_docs, monkeypatch):
    """While the pairs of the last level are joined, the counts of the level before are gone."""
    there = {}
    written = Workspace.materialize

    def noted(self, df, *parts):
        names = ("totals-1", "followers-1", "followers-2", "tried-2", "retained-1", "words")
        there[parts[0]] = {n for n in names if self.exists(self.path(n))}
        return written(self, df, *parts)

    monkeypatch.setattr(Workspace, "materialize", noted)
    tree = suffix_tree.fit(make_docs(list(enumerate(some_texts(random.Random(5), 60)))), depth=2, penalty=0.1)
    assert there["entries-2"] == {"tried-2", "retained-1", "words"}
    assert tree.weights[2].count() and not tree.space.exists(tree.space.path("retained-2"))
