"""The table against its definition; placement against the definition of a slot."""

import hashlib
from collections import Counter

import pytest

from meshscope.llm import sharding


def plain_table(shards, slots):
    """Each shard's whole order written out; shards take turns."""
    number = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    orders = []
    for s in shards:
        start, skip = number(f"offset:{s}") % slots, number(f"skip:{s}") % (slots - 1) + 1
        orders.append(iter([(start + i * skip) % slots for i in range(slots)]))
    table = [None] * slots
    while None in table:
        for k, order in enumerate(orders):
            slot = next((x for x in order if table[x] is None), None)
            if slot is not None:
                table[slot] = k
    return table


def test_table():
    shards = [f"s{k}" for k in range(7)]
    assert sharding.fill_table(shards, 251) == plain_table(shards, 251)


def test_even_and_stable():
    shards = [f"s{k}" for k in range(20)]
    table = sharding.fill_table(shards, 4099)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(shards[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 19)
    assert moved < 0.25 * 4099


def test_weights():
    counts = Counter(sharding.fill_table(["a", "b"], 1009, [1, 3]))
    assert abs(counts[1] - 3 * counts[0]) <= 4


def test_wrong_parameters():
    for bad in (([], 7, None), (["a", "a"], 7, None), (["a"], 8, None), (["a"], 7, [0]), (["a", "b"], 2, [2, 1])):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_place(make_docs):
    rows = [(1, "x"), (1, "x"), (None, None), (-5, ""), (2**62, "y")]
    shards = ["a", "b", "c"]
    table = plain_table(shards, 101)
    found = sharding.place(make_docs(rows, extra=("slot", "shard", "k")), shards, slots=101).collect()
    assert len(found) == len(rows)
    for r in found:
        key = "" if r["row"]["doc_id"] is None else str(r["row"]["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, shards[table[slot]])
    assert sharding.place(make_docs([]), shards, slots=101).count() == 0
