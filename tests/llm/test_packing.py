"""Tokens against the tokenizer itself, packings against their definition."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshscope.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aB'stΣİé \n\x1c\x85 <|endoftext|>12²,.", max_size=60))
def test_encoder(text):
    own = packing.encoder(packing.tokenizer_path())
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == want


def test_remembered_words_are_forgotten(tokenizer):
    own = packing.WordEncoder(packing.tokenizer_path())
    own.words.most = own.parts.most = 3
    text = "One two, three four five six two one seven eight. Nine ten two"
    for _ in range(3):
        assert np.frombuffer(own.encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(own.words) <= 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_pack_group(lengths):
    bins = packing.pack_group(np.array(lengths, dtype=np.int64), 40)
    fill = np.bincount(bins, weights=lengths) if lengths else np.zeros(0)
    assert (fill <= 40).all() and (fill > 0).all()
    fewest = packing.best_fit_decreasing(np.array([x for x in lengths if x < 40], dtype=np.int64), 40)
    assert len(fill) <= (fewest.max(initial=-1) + 1) + sum(x == 40 for x in lengths)


def test_local_search_beats_best_fit():
    rng = random.Random(0)
    lengths = np.array([rng.randrange(513, 922) for _ in range(200)])
    first = packing.best_fit_decreasing(lengths, 2048)
    better = packing.LocalSearch(lengths, first, 2048)
    before = int((better.fill**2).sum())
    better.run()
    assert (better.fill > 0).sum() < first.max() + 1
    assert (better.fill**2).sum() > before and better.fill.max() <= 2048


def test_pack(spark, make_docs, tokenizer):
    long_text = " ".join(f"token{i}" for i in range(1500))
    rows = [(1, "hello world"), (1, "hello world"), (2, None), (3, ""), (None, "null id"), (4, long_text)]
    docs = make_docs(rows, extra=("piece", "row", "offset", "_group"))
    packed = packing.pack(docs, with_ids=True)
    found = packed.collect()
    ids = {t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows}
    for r in found:
        text, start, n = r["row"]["text"], r["start"], r["length"]
        part = ids[text][start : start + n]
        assert len(part) == n and start == 2048 * r["piece"]
        assert n == 2048 or start + n == len(ids[text])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    assert len(found) == sum(-(-len(ids[t]) // 2048) for _, t in rows)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(len(ids[t]) for _, t in rows)
    assert len(by_sequence) == -(-total // 2048)
    made = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    assert {k: len(v) for k, v in made.items()} == {k: sum(n for _, n in v) for k, v in by_sequence.items()}


def test_empty_table(make_docs):
    assert packing.pack(make_docs([])).count() == 0
