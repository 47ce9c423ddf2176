"""Contamination against exact search of every passage."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from meshscope.llm import decontaminate as d

ITEMS = "item_id long, text string"


def plain_distance(item, text):
    """Least edits between the whole item and any passage of the text."""
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        now = [i]
        for j, b in enumerate(text, 1):
            now.append(min(last[j - 1] + (a != b), last[j] + 1, now[j - 1] + 1))
        last = now
    return min(last)


def vocabulary(rng, n=400):
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 8))) for _ in range(n)]


def edit(rng, words, edits, vocab):
    words = list(words)
    for _ in range(edits):
        k, op = rng.randrange(len(words)), rng.randrange(3)
        if op == 0:
            words[k] = rng.choice(vocab)
        elif op == 1:
            words.insert(k, rng.choice(vocab))
        else:
            del words[k]
    return words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8), st.lists(st.integers(0, 3), max_size=14))
def test_best_alignment(item, text):
    distance, start, end = d.best_alignment(np.array(item), np.array(text, dtype=np.int64))
    assert distance == plain_distance(item, text)
    assert plain_distance(item, text[start:end]) == distance


def planted(seed=2):
    rng = random.Random(seed)
    vocab = vocabulary(rng)
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(12, 60)))) for k in range(30)]
    docs = []
    for k in range(150):
        words = rng.choices(vocab, k=rng.randrange(20, 200))
        if k % 2 == 0:
            item = items[rng.randrange(30)][1].split()
            most = int(0.2 * len(item) + 1e-9) + rng.choice([0, 0, 0, 2])
            at = rng.randrange(len(words))
            words[at:at] = edit(rng, item, rng.randrange(most + 1), vocab)
        docs.append((k, " ".join(words)))
    return items, docs


def test_against_exact_search(spark, make_docs):
    items, rows = planted()
    items += [(100, None), (101, ""), (102, "too short"), (103, items[0][1]), (None, items[1][1])]
    rows += [(500, None), (501, ""), (502, "... ---"), (503, items[0][1].upper().replace(" ", ", ")), (503, rows[0][1]), (None, rows[2][1])]
    docs = make_docs(rows, extra=("hits", "row", "item_id"))
    found = d.contamination(docs, spark.createDataFrame(items, ITEMS)).collect()
    want = got = missed = 0
    by_text = {}
    for r in found:
        by_text.setdefault(r["row"]["text"], []).append({h["item_id"]: h for h in r["hits"]})
    for text, hits in by_text.items():
        words = d.words_of(text)
        for item_id, item in items:
            own = d.words_of(item)
            exact = len(own) >= d.MIN_WORDS and plain_distance(own, words) <= int(0.2 * len(own) + 1e-9)
            for h in hits:
                if exact:
                    want += 1
                    missed += item_id not in h
                else:
                    assert item_id not in h
                if item_id in h:
                    got += 1
                    hit = h[item_id]
                    passage = words[hit["start_word"] : hit["end_word"]]
                    assert plain_distance(own, passage) == hit["distance"] <= int(0.2 * len(own) + 1e-9)
    assert want > 60 and missed <= 0.03 * want
    clean = d.decontaminate(docs, spark.createDataFrame(items, ITEMS))
    assert clean.columns == docs.columns
    assert sorted(str(r["text"]) for r in clean.collect()) == sorted(str(r["row"]["text"]) for r in found if not r["hits"])


def cut_passages(size, seed=5):
    """(item, text, start, end): items with a fifth cut off at the text's ends or as the whole text."""
    rng = random.Random(seed)
    vocab, other = vocabulary(rng), ["".join(rng.choices("qrstuv", k=6)) for _ in range(200)]
    for _ in range(20):
        item = rng.choices(vocab, k=size)
        rest, most = rng.choices(other, k=50), size // 5
        head, tail = item[: size - most], item[most:]
        one = rng.randrange(size)
        yield "end", item, rest + head
        yield "start", item, tail + rest
        yield "whole head", item, head
        yield "whole tail", item, tail
        yield "one word less", item, item[:one] + item[one + 1 :]


def test_cut_items_at_the_ends_of_a_text():
    for size in (20, 40):
        found = {}
        for kind, item, words in cut_passages(size):
            (hits,) = d.Block([(7, " ".join(item))], d.SIMILARITY).search([" ".join(words)])
            found.setdefault(kind, []).append(len(hits))
            for hit in hits:
                assert 0 <= hit["start_word"] < hit["end_word"] <= len(words)
                passage = words[hit["start_word"] : hit["end_word"]]
                assert plain_distance(item, passage) == hit["distance"] <= size // 5
        for kind, counts in found.items():
            assert sum(map(bool, counts)) >= 0.95 * len(counts), (size, kind, sum(counts))


def test_texts_shorter_than_the_item():
    block = d.Block([(1, "a b c d e")], d.SIMILARITY)
    texts = ["a b c d", "b c d e", "a b c", "a", "", None, "x a b c d", "b c d e x"]
    want = [bool(t) and plain_distance("a b c d e".split(), t.split()) <= 1 for t in texts]
    found = block.search(texts)
    assert [bool(h) for h in found][2:6] == want[2:6] == [False] * 4
    assert all(w or not h for w, h in zip(want, found))
    assert found[0] and found[1]


def test_blocks_give_the_same_hits(spark, make_docs, monkeypatch):
    items, rows = planted(6)
    docs, benchmark = make_docs(rows), spark.createDataFrame(items, ITEMS)

    def hits():
        return {
            r["row"]["doc_id"]: sorted((h["item_id"], h["distance"]) for h in r["hits"])
            for r in d.contamination(docs, benchmark).collect()
        }

    whole = hits()
    monkeypatch.setattr(d, "BLOCK_WORDS", 300)
    assert len(d.blocks(benchmark, "item_id", "text")) > 2
    assert hits() == whole


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], ITEMS)
    assert d.decontaminate(make_docs([(1, "a b c d e f")]), none).count() == 1
    assert d.contamination(make_docs([]), none).count() == 0
