"""Fingerprints and the trie join against plain restatements."""

import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from meshscope.llm import simhash
from meshscope.llm.components import connected_components
from meshscope.plans.iterate import Workspace


def plain_fingerprint(text, shingle):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashes = [xxhash.xxh64(" ".join(words[i : i + shingle]).encode(), seed=42).intdigest() for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, max_bits):
    label = {v: v for v in values}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= max_bits:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {v: root(v) for v in values}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBcÉ \t\n\x0b1", max_size=60), st.integers(1, 5))
def test_fingerprint(text, shingle):
    assert simhash.fingerprint(text, shingle) == plain_fingerprint(text, shingle)


def test_hash_agrees_with_the_engine(spark):
    from pyspark.sql import functions as F

    words = ["the quick brown fox", "é ü", "a"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] % (1 << 64) for r in got] == [xxhash.xxh64(w.encode(), seed=42).intdigest() for w in words]


def cloud(seed, groups=25):
    rng, out = random.Random(seed), {0, (1 << 64) - 1}
    for _ in range(groups):
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.randrange(12)):
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_trie_join_loses_no_link(spark):
    for seed, max_bits in ((1, 4), (2, 3), (3, 0), (4, 7)):
        values = cloud(seed)
        signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
        fps = spark.createDataFrame([(x,) for x in signed], "fp long")
        space = Workspace(spark, "test-trie")
        for deeper in (0, 3):
            pairs = simhash.node_pairs(fps, max_bits, deeper)
            assert pairs.select("key").count() >= 8 * len(values)
        edges = space.materialize(simhash.links(fps, max_bits), "links")
        found = {r["node"] % (1 << 64): r["component"] for r in connected_components(edges, space).collect()}
        want = plain_components(values, max_bits)
        groups = {}
        for v in values:
            groups.setdefault(want[v], set()).add(v)
        for members in groups.values():
            assert len({found.get(v, ("alone", v)) for v in members}) == 1
        assert len({found.get(v, ("alone", v)) for v in values}) == len(groups)


def test_deeper_nodes_give_the_same_links():
    values = np.array(cloud(9, 60), dtype=np.uint64)
    want = plain_components(values.tolist(), 4)
    root = {v: v for v in values.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for turn in range(8):
        turned = (values << np.uint64(8 * turn)) | (values >> np.uint64(64 - 8 * turn) if turn else np.uint64(0))
        blocks = {}
        for key, value in zip(turned.tolist(), values.tolist()):
            node = key >> (64 - 8 - 3)
            for flip in (0, 1, 2, 4):
                blocks.setdefault((min(node, node ^ flip), max(node, node ^ flip)), []).append((key, value))
        for members in blocks.values():
            members.sort()
            keys = np.array([k for k, _ in members], dtype=np.uint64)
            labels = simhash.trie_join(np.zeros(len(keys), dtype=np.int64), keys, 4)
            for k, label in enumerate(labels):
                a, b = find(members[k][1]), find(members[label][1])
                root[max(a, b)] = min(a, b)
    assert {v: find(v) for v in values.tolist()} == want


def test_components_of_documents(make_docs):
    base = " ".join(f"word{i}" for i in range(300))
    near = base.replace("word150", "other")
    rows = [(7, base), (3, base), (3, base), (5, near), (None, base), (8, None), (9, ""), (10, " \t"), (11, "short one")]
    docs = make_docs(rows, extra=("fp", "uid", "row", "component_id", "head"))
    found = simhash.near_duplicates(docs, 4, 4).collect()
    want_fp = {t: simhash.fingerprint(t, 4) for _, t in rows}
    assert sorted(r["fp"] % (1 << 64) for r in found) == sorted(want_fp[t] for _, t in rows)
    want = plain_components(sorted(set(want_fp.values())), 4)
    for r in found:
        fp = want_fp[r["row"]["text"]]
        same = [i for i, t in rows if want[want_fp[t]] == want[fp] and i is not None]
        assert r["component_id"] == min(same)
    assert sum(r["first"] for r in found) == len(set(want.values()))
    kept = simhash.deduplicate(docs, 4, 4)
    assert kept.columns == docs.columns and kept.count() == len(set(want.values()))


def test_empty_table(make_docs):
    assert simhash.near_duplicates(make_docs([]), 4, 4).count() == 0
