"""The hand graph of FIXTURES.md §3: chain, diamond, cycle, self-loop,
seeded company, unknown person, repeated pair, NULL owner, NULL score."""

import pytest
from pyspark.sql import functions as F

from meshscope.operators import family, ownership, propagation, quality
from meshscope.plans import jobs
from meshscope.plans.iterate import Workspace, checkpoint_root

EDGES = [
    ("A", "p1", 60.0), ("A", "p2", 40.0),
    ("B", "A", 50.0), ("B", "p3", 50.0),
    ("C", "B", 30.0), ("C", "p1", 30.0),
    ("D", "p1", 50.0), ("D", "p9", 50.0),
    ("E", "F", 100.0), ("F", "E", 100.0),
    ("G", "G", 50.0), ("G", "p1", 50.0),
    ("H", "p1", 10.0), ("H", "p1", 30.0), ("H", "p2", 20.0),
    ("S", "p9", 100.0),
    ("K", "S", 100.0),
    ("M", "B", 50.0), ("M", "A", 50.0),
    ("N", "p5", 100.0),
    ("Z", None, 100.0),
]
SEED = [("p1", 0.2), ("p2", 0.5), ("p3", 1.0), ("p5", None), ("S", 0.9)]
FAMILY = [("p1", "p2", "X"), ("p2", "p1", "X"), ("p3", "p3", "X")]

OPACITY = {"A": (0.32, 0), "B": (0.66, 1), "C": (0.43, 2), "H": (0.35, 0), "K": (0.9, 0),
           "M": (0.49, 2)}
POOLS = {  # company: (TOTAL, NONULOS, eligible, FAMILIARES, rate)
    "A": (2, 2, True, 2, 100.0), "B": (3, 3, True, 2, 66.666667), "C": (4, 4, True, 2, 50.0),
    "D": (2, 1, False, 0, 0.0), "E": (None, None, False, 0, None), "F": (None, None, False, 0, None),
    "G": (None, None, False, 0, None), "H": (3, 3, True, 2, 66.666667), "S": (1, 0, False, 0, 0.0),
    "K": (1, 0, False, 0, 0.0), "M": (5, 5, True, 2, 40.0), "N": (1, 1, True, 0, 0.0),
    "Z": (1, 0, False, 0, 0.0),
}


@pytest.fixture(scope="module")
def frames(spark):
    edges = spark.createDataFrame(
        [(c, o, cap, cap) for c, o, cap in EDGES],
        "RUT_SOCIEDAD string, RUT_SOCIO string, PORCENTAJE_CAPITAL double, PORCENTAJE_UTILIDADES double",
    )
    seed = spark.createDataFrame(SEED, "CONT_RUT string, Valor double")
    fam = spark.createDataFrame(FAMILY, "CONT_RUT string, RUT_FAM string, TIPO_RELACION string")
    return quality.clean_edges(edges), seed, fam


def test_opacity(frames):
    edges, seed, _ = frames
    got = {r.CONT_RUT: (r.Value, r.iterations)
           for r in propagation.opacity_index(edges, seed).collect()}
    assert set(got) == set(OPACITY)
    for c, (v, it) in OPACITY.items():
        assert got[c][0] == pytest.approx(v, abs=1e-12), c
        assert got[c][1] == it, c


def test_opacity_edges_and_incomplete(frames):
    edges, seed, _ = frames
    run = propagation.run_opacity(edges, seed)
    scored = {(r.RUT_SOCIEDAD, r.RUT_SOCIO): r.Valor for r in run.edges().collect()}
    assert scored[("K", "S")] == pytest.approx(0.9)  # the seed wins over the company
    assert scored[("M", "B")] == pytest.approx(0.66)
    assert scored[("H", "p1")] == pytest.approx(0.2)  # repeated pair collapsed to one edge
    inc = {r.RUT_SOCIEDAD for r in propagation.incomplete_companies(run.edges()).collect()}
    assert inc == {"D", "E", "F", "G", "S", "N", "Z"}


def test_a_bound_that_is_too_low_raises(frames):
    edges, seed, _ = frames
    with pytest.raises(RuntimeError, match="rounds are needed"):
        propagation.opacity_index(edges, seed, max_rounds=1)
    assert propagation.opacity_index(edges, seed, max_rounds=2).count() == len(OPACITY)


def test_a_workspace_used_twice_gives_the_same_rows(spark, frames):
    edges, seed, fam = frames
    short = edges.filter("RUT_SOCIEDAD IN ('A', 'H')")
    with Workspace(spark, "twice") as ws:
        rows = lambda e: sorted(map(str, propagation.opacity_index(e, seed, workspace=ws).collect()))
        first = rows(edges)
        assert len(rows(short)) == 2
        assert rows(edges) == first
        owners = lambda e: sorted(map(str, ownership.ultimate_owners(e, seed, workspace=ws).collect()))
        before = owners(edges)
        assert len(owners(short)) == 4
        assert owners(edges) == before
        levels = lambda h: family.family_closure_levels(fam, hops=h, workspace=ws).collect()
        assert {r.hop for r in levels(4)} == {1, 3}
        assert {r.hop for r in levels(1)} == {1}


def test_owner_pools(frames):
    edges, seed, fam = frames
    owners = ownership.ultimate_owners(edges, seed)
    pool = {r.RUT_SOCIEDAD: (r.TOTAL, r.NONULOS, r.eligible)
            for r in ownership.owner_pool(owners).collect()}
    assert pool == {c: v[:3] for c, v in POOLS.items()}
    per_person = {r.CONT_RUT: r.SOCIEDADES_RELACIONADAS
                  for r in ownership.companies_per_person(owners).collect()}
    assert per_person == {"p1": 9, "p2": 6, "p3": 3, "p5": 1}


def test_family_index(frames):
    edges, seed, fam = frames
    owners = ownership.ultimate_owners(edges, seed)
    rel = family.family_relations(fam)
    assert sorted(map(tuple, rel.collect())) == [("p1", "p2"), ("p2", "p1")]
    got = {r.RUT_SOCIEDAD: (r.FAMILIARES, r.TASA_FAMILIARIDAD)
           for r in family.family_index(owners, rel).collect()}
    for c, v in POOLS.items():
        assert got[c][0] == v[3], c
        assert got[c][1] == (v[4] if v[4] is None else pytest.approx(v[4], abs=1e-6)), c
    nulls = {r.RUT_SOCIEDAD: r.FAMILIARES
             for r in family.family_index(owners, rel, unrelated_fill="null").collect()}
    assert nulls["N"] is None and nulls["A"] == 2
    dropped = family.family_index(owners, rel, unrelated_fill="drop")
    assert {r.RUT_SOCIEDAD for r in dropped.collect()} == {"A", "B", "C", "H", "M"}


def test_co_owner_pairs_bag_multiplicity(frames):
    edges, seed, fam = frames
    owners = ownership.ultimate_owners(edges, seed)
    members = ownership.pool_members(owners, ownership.owner_pool(owners))
    pairs = {(r.RUT_SOCIEDAD, r.RUT_SOCIO_1, r.RUT_SOCIO_2): r.n_pairs
             for r in ownership.co_owner_pairs(members, family.family_relations(fam)).collect()}
    # H: p1 reached by two edge rows, p2 by one.
    assert pairs[("H", "p1", "p2")] == 2 and pairs[("H", "p2", "p1")] == 2
    assert ("N", "p5", "p5") not in pairs


def test_single_owner_check(frames):
    edges, seed, _ = frames
    round0 = propagation.opacity_index(edges, seed).filter("iterations = 0")
    rows = propagation.single_owner_check(edges, seed, round0).collect()
    # K is single-owner and complete in round 0, but its owner S is a company
    # with a seed score; the check joins the seed, so it appears with Comp = 1.
    assert [(r.RUT_SOCIEDAD, r.Comp) for r in rows] == [("K", 1)]


def test_ego_network(frames):
    edges, _, _ = frames
    rows = ownership.ego_network(edges, ["A"]).collect()
    got = sorted((r.RUT_SOCIO, r.RUT_SOCIEDAD, r.DIRECCION, r.BANDA, r.ETIQUETA) for r in rows)
    assert got == [
        ("A", "B", "out", 50, "50.0%"),
        ("A", "M", "out", 50, "50.0%"),
        ("p1", "A", "in", 60, "60.0%"),
        ("p2", "A", "in", 40, "40.0%"),
    ]
    loop = ownership.ego_network(edges, ["G"]).collect()
    assert sorted((r.RUT_SOCIO, r.DIRECCION) for r in loop) == [("G", "self"), ("p1", "in")]


def test_companies_above_a_cycle_have_a_flag_and_no_paths(frames):
    edges, seed, _ = frames
    rows = ownership.ultimate_owners(edges, seed).collect()
    flagged = {(r.RUT_SOCIEDAD, r.RUT_SOCIO, r.n_paths) for r in rows if r.above_cycle}
    assert flagged == {("E", None, None), ("F", None, None), ("G", "p1", None)}
    assert all(r.n_paths >= 1 for r in rows if not r.above_cycle)


def test_a_large_pool_reports_its_relatives(spark):
    n = 1200
    rows = [("X", f"q{i}", 1.0, 1.0) for i in range(n)]
    edges = spark.createDataFrame(
        rows, "RUT_SOCIEDAD string, RUT_SOCIO string, PORCENTAJE_CAPITAL double, PORCENTAJE_UTILIDADES double")
    seed = spark.createDataFrame([(f"q{i}", 0.5) for i in range(n)], "CONT_RUT string, Valor double")
    rel = spark.createDataFrame([("q1", "q2")], "CONT_RUT string, RUT_FAM string")
    owners = ownership.ultimate_owners(edges, seed)
    row = family.family_index(owners, rel).first()
    assert (row.TOTAL, row.FAMILIARES) == (n, 2)


def test_family_index_over_the_closure(frames):
    edges, seed, fam = frames
    owners = ownership.ultimate_owners(edges, seed)
    chain = fam.sparkSession.createDataFrame(
        [("p1", "x", "X"), ("x", "p3", "X")], "CONT_RUT string, RUT_FAM string, TIPO_RELACION string")
    pairs = family.family_closure(family.family_closure_levels(chain, hops=2))
    got = {r.RUT_SOCIEDAD: r.FAMILIARES
           for r in family.family_index(owners, pairs, unrelated_fill="drop").collect()}
    assert got == {"B": 2, "C": 2, "M": 2}


def test_whole_job(spark, frames, tmp_path):
    edges, seed, fam = frames
    root = checkpoint_root(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/meshscope")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    jobs_left = lambda: [x for x in fs.listStatus(path) if "/job-" in x.getPath().toString()]
    tables = lambda: sorted(t.name for t in spark.catalog.listTables())
    before = tables()
    out = jobs.run_job(edges, seed, fam, str(tmp_path / "out"))
    assert [p.rsplit("/", 1)[1] for p in out] == jobs.OUTPUTS
    read = {p.rsplit("/", 1)[1]: spark.read.parquet(p) for p in out}
    assert {r.CONT_RUT for r in read["opacity_companies"].collect()} == set(OPACITY)
    assert read["family_index"].count() == read["family_index_copy"].count() == len(POOLS)
    assert read["describe_scores"].count() == 16 and read["edges"].count() == edges.count()
    assert not jobs_left() and tables() == before
