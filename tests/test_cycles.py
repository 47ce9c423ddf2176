"""Owners above ownership cycles, deep chains, large path counts and resumed runs, against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from meshscope.operators import ownership, propagation
from meshscope.plans import iterate
from meshscope.plans.chains import follow
from meshscope.plans.iterate import Workspace

EDGE = "RUT_SOCIEDAD string, RUT_SOCIO string, PORCENTAJE_CAPITAL double, PORCENTAJE_UTILIDADES double"


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, w, w) for a, b, w in pairs], EDGE)


def seed_of(spark, ids):
    return spark.createDataFrame([(p, (k % 7) / 10) for k, p in enumerate(ids)], "CONT_RUT string, Valor double")


def plain_owners(pairs, persons):
    """Path counts by recursion; distinct leaves above cycles."""
    up = {}
    for a, b, _ in pairs:
        up.setdefault(a, []).append(b)

    def reach(c):
        seen, todo = set(), [c]
        while todo:
            for b in up.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    reached = {c: reach(c) for c in up}
    above = {c for c in up if any(x in reached.get(x, ()) for x in reached[c] | {c})}
    counts = {}

    def paths(c):
        if c not in counts:
            counts[c] = {}
            for b in up[c]:
                for leaf, n in (paths(b) if b in up else {b: 1}).items():
                    counts[c][leaf] = counts[c].get(leaf, 0) + n
        return counts[c]

    rows = []
    for c in up:
        if c in above:
            leaves = [x for x in reached[c] if x not in up]
            rows += [(c, x, x if x in persons else None, None, True) for x in leaves] or [(c, None, None, None, True)]
        else:
            rows += [(c, x, x if x in persons else None, n, False) for x, n in paths(c).items()]
    return sorted(rows, key=str)


def collected(owners):
    return sorted(
        ((r[0], r[1], r[2], None if r[3] is None else int(r[3]), r[4]) for r in owners.collect()), key=str
    )


CASES = {
    "ring_with_tail": [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("c", "p1", 1.0), ("t", "a", 1.0),
                       ("u", "t", 1.0), ("u", "p2", 1.0), ("g", "p3", 1.0), ("b", "g", 1.0)],
    "two_components": [("a", "b", 1.0), ("b", "a", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("d", "c", 1.0),
                       ("d", "p1", 1.0), ("a", "x", 1.0), ("x", "y", 1.0), ("y", "b", 1.0), ("y", "p2", 1.0),
                       ("z", "a", 1.0), ("z", "d", 1.0), ("s", "s", 1.0), ("s", "a", 1.0)],
}


@pytest.mark.parametrize("name", CASES)
def test_owners_above_cycles(spark, name):
    pairs, persons = CASES[name], ["p1", "p3"]
    got = collected(ownership.ultimate_owners(edges_of(spark, pairs), seed_of(spark, persons)))
    assert got == plain_owners(pairs, persons)


@pytest.mark.parametrize("k", range(3))
def test_owners_of_random_graphs(spark, k):
    r = random.Random(k)
    pairs = []
    for g in range(12):  # many small graphs in one run
        n = r.randint(2, 14)
        for c in range(n):
            for _ in range(r.choice([1, 1, 1, 2, 3])):
                owner = f"c{g}_{r.randrange(n)}" if r.random() < 0.75 else f"p{r.randrange(8)}"
                pairs.append((f"c{g}_{c}", owner, 1.0))
    persons = [f"p{i}" for i in range(6)]
    owners = ownership.ultimate_owners(edges_of(spark, pairs), seed_of(spark, persons))
    want = plain_owners(pairs, persons)
    assert collected(owners) == want
    assert sum(x[4] for x in want) > 20
    per_person = {x.CONT_RUT: x.SOCIEDADES_RELACIONADAS for x in ownership.companies_per_person(owners, distinct=True).collect()}
    assert per_person == {p: len({x[0] for x in want if x[2] == p}) for p in {x[2] for x in want} - {None}}


def test_large_path_counts(spark):
    ladder = [(f"l{k:03d}", f"l{k + 1:03d}", 1.0) for k in range(60) for _ in range(5)]
    ladder.append(("l060", "p1", 1.0))
    rows = ownership.ultimate_owners(edges_of(spark, ladder), seed_of(spark, ["p1"])).collect()
    counts = {r.RUT_SOCIEDAD: r.n_paths for r in rows}
    assert counts["l033"] == 5**27 and counts["l010"] == 5**50  # beyond 64 bits
    assert counts["l000"] is None and not any(r.above_cycle for r in rows)  # beyond 38 digits
    pool = {r.RUT_SOCIEDAD: r for r in ownership.owner_pool(ownership.ultimate_owners(
        edges_of(spark, ladder), seed_of(spark, ["p1"])), distinct=True).collect()}
    assert pool["l000"].TOTAL == 1 and pool["l000"].eligible


def test_a_chain_of_2000_companies(spark, monkeypatch):
    n = 2000
    pairs = [(f"c{k}", f"c{k + 1}", 40.0) for k in range(n - 1)] + [(f"c{n - 1}", "p1", 50.0)]
    pairs += [(f"c{k}", "p2", 60.0) for k in range(n)]
    names = []
    written = Workspace.materialize_observed

    def counted(self, df, parts, **metrics):
        names.append(parts)
        return written(self, df, parts, **metrics)

    monkeypatch.setattr(Workspace, "materialize_observed", counted)
    seed = spark.createDataFrame([("p1", 1.0), ("p2", 0.0)], "CONT_RUT string, Valor double")
    run = propagation.run_opacity(edges_of(spark, pairs), seed)
    assert len(names) < 20
    got = {r.CONT_RUT: (r.Value, r.iterations) for r in run.companies.collect()}
    value, want = 50 / 110, {f"c{n - 1}": (50 / 110, 0)}
    for k in range(n - 2, -1, -1):
        value = 0.4 * value
        want[f"c{k}"] = (value, n - 1 - k)
    assert {c: i for c, (_, i) in got.items()} == {c: i for c, (_, i) in want.items()}
    assert all(got[c][0] == pytest.approx(v, abs=1e-12) for c, (v, _) in want.items())


def test_rounds_write_touched_companies_only(spark):
    """Companies with two open owners on a ladder: a round's table has the one that it touched."""
    pairs = []
    for k in range(8):
        pairs += [(f"c{k}", f"c{k + 1}", 10.0), (f"c{k}", f"d{k + 1}", 10.0),
                  (f"d{k}", f"c{k + 1}", 10.0), (f"d{k}", f"d{k + 1}", 10.0)]
    pairs += [("c8", "p1", 1.0), ("d8", "p2", 1.0)]
    # companies that never close and are never touched
    pairs += [(f"e{k}", x, 1.0) for k in range(50) for x in (f"x{k}", f"y{k}")]
    ws = Workspace(spark, "touched")
    seed = spark.createDataFrame([("p1", 1.0), ("p2", 0.0)], "CONT_RUT string, Valor double")
    run = propagation.run_opacity(edges_of(spark, pairs), seed, workspace=ws)
    assert run.rounds == 8
    sizes = [r[0] for r in ws.read_rounds("versions", "version", 8, first=1).groupBy("version").count().select("count").collect()]
    assert sizes == [2] * 8
    ws.cleanup()


def test_compaction_keeps_the_states(spark):
    r = random.Random(4)
    pairs, depth = [], 7
    for k in range(depth):
        for j in range(5):
            pairs += [(f"c{k}_{j}", f"c{k + 1}_{x}", float(r.randint(1, 9))) for x in r.sample(range(5), 3)]
    pairs += [(f"c{depth}_{j}", f"p{j}", 1.0) for j in range(5)]
    values = {f"p{j}": j / 4 for j in range(5)}
    seed = spark.createDataFrame(list(values.items()), "CONT_RUT string, Valor double")
    ws = Workspace(spark, "compacted")
    got = {x.CONT_RUT: x.Value for x in propagation.run_opacity(edges_of(spark, pairs), seed, workspace=ws).companies.collect()}
    for k in range(depth, -1, -1):
        for j in range(5):
            own = [(b, w) for a, b, w in pairs if a == f"c{k}_{j}"]
            values[f"c{k}_{j}"] = sum(w * values[b] for b, w in own) / sum(w for _, w in own)
    assert got == pytest.approx({c: v for c, v in values.items() if c[0] == "c"})
    assert ws.exists(ws.path("base", "base=1"))
    ws.cleanup()


def test_a_lost_run_goes_on_after_its_last_round(spark, monkeypatch):
    pairs = []
    for k in range(6):
        pairs += [(f"c{k}", f"c{k + 1}", 10.0), (f"c{k}", f"d{k + 1}", 30.0), (f"d{k}", f"c{k + 1}", 20.0), (f"d{k}", f"d{k + 1}", 5.0)]
    pairs += [("c6", "p1", 1.0), ("d6", "p2", 1.0)]
    edges = edges_of(spark, pairs)
    seed = spark.createDataFrame([("p1", 1.0), ("p2", 0.0)], "CONT_RUT string, Valor double")
    want = sorted(map(tuple, propagation.run_opacity(edges, seed).companies.collect()))
    written, log = Workspace._record, []

    def record(self, parts, metrics):
        written(self, parts, metrics)
        log.append(parts)
        if stop and parts == ("versions", "version=3"):
            raise KeyboardInterrupt

    monkeypatch.setattr(Workspace, "_record", record)
    stop = True
    with pytest.raises(KeyboardInterrupt):
        propagation.run_opacity(edges, seed, workspace=Workspace(spark, "lost", run_id="r1"))
    stop, first = False, list(log)
    log.clear()
    ws = Workspace(spark, "lost", run_id="r1")
    assert sorted(map(tuple, propagation.run_opacity(edges, seed, workspace=ws).companies.collect())) == want
    assert not set(log) & set(first)  # no table is written twice
    assert ("versions", "version=4") in log
    log.clear()
    again = propagation.run_opacity(edges, seed, workspace=Workspace(spark, "lost", run_id="r1"))
    assert sorted(map(tuple, again.companies.collect())) == want and log == []
    ws.cleanup()


def test_follow(spark):
    steps = [("a", "b"), ("b", "c"), ("c", "end"), ("r", "s"), ("s", "t"), ("t", "r"), ("l", "k"), ("k", "m"), ("m", "s")]
    rows = spark.createDataFrame([(a, b, 1) for a, b in steps], "node string, to string, n int")
    found = follow(rows, Workspace(spark, "follow"), "f", lambda p, q: {"n": p("n") + q("n")}, to_cycles=True)
    assert sorted(map(tuple, found.ended.collect())) == [("a", "end", 3), ("b", "end", 2), ("c", "end", 1)]
    looped = {r.node: r.to for r in found.looped.collect()}
    assert set(looped) == set("rstlkm") and set(looped.values()) == set("rst")


def test_folders_go_with_the_session(spark):
    assert iterate.Workspace(spark, "gone").exists(iterate.Workspace(spark, "gone").root)


def _chain_with_leaves(n, leaves):
    pairs = [(f"c{k:02d}", f"c{k + 1:02d}", 1.0) for k in range(n - 1)]
    return pairs + [(f"c{k:02d}", f"p{k:02d}_{i}", 1.0) for k in range(n) for i in range(leaves)]


def test_leaves_are_not_written_one_by_one(spark, monkeypatch):
    rows = []
    for name in ("materialize", "materialize_observed"):
        def counted(self, df, *parts, _written=getattr(Workspace, name), **metrics):
            out = _written(self, df, *parts, **metrics)
            rows.append((out[0] if isinstance(out, tuple) else out).count())
            return out

        monkeypatch.setattr(Workspace, name, counted)
    pairs = _chain_with_leaves(32, 30)
    owners = ownership.ultimate_owners(edges_of(spark, pairs), seed_of(spark, ["p00_0"]))
    assert sum(rows) < owners.count() == 30 * 32 * 33 // 2


@pytest.mark.parametrize("limit", [2, 10_000])
def test_many_leaves_and_odd_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(ownership, "LEAVES_PER_LIST", limit)
    monkeypatch.setattr(ownership, "LISTS_PER_TASK", 2)
    pairs = _chain_with_leaves(5, 1) + [("c01", "c03", 1.0), ("c02", "p04_0", 1.0), ("c02", "p04_0", 2.0)]
    pairs += [("c03", f"q{i}", 1.0) for i in range(7)] + [("d", "a\x01b", 1.0), ("d", "", 1.0), ("e", "", 1.0)]
    persons = ["p04_0", "q1", "a\x01b", ""]
    got = collected(ownership.ultimate_owners(edges_of(spark, pairs), seed_of(spark, persons)))
    assert got == plain_owners(pairs, persons)


def test_a_leaf_without_id(spark):
    edges = edges_of(spark, [("a", "b", 1.0), ("a", None, 1.0), ("b", None, 1.0), ("b", "p", 1.0)])
    got = {(r[0], r[1], r[2], int(r[3])) for r in ownership.ultimate_owners(edges, seed_of(spark, ["p"])).collect()}
    assert got == {("a", None, None, 2), ("a", "p", "p", 1), ("b", None, None, 1), ("b", "p", "p", 1)}
