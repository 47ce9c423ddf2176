"""What the shared steps shuffle and sort, read from their plans."""

from meshscope.operators import propagation, quality
from meshscope.plans import iterate, registry
from meshscope.plans.iterate import Workspace


def _edges(spark):
    rows = [(f"c{k}", f"p{k % 5}", 10.0 + k % 3, 1.0) for k in range(40)] + [("c1", "c2", 5.0, 5.0), (None, "p1", 1.0, 1.0)]
    return spark.createDataFrame(
        rows + rows[:7], "RUT_SOCIEDAD string, RUT_SOCIO string, PORCENTAJE_CAPITAL double, PORCENTAJE_UTILIDADES double"
    )


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaning_and_pair_means_share_one_shuffle(spark):
    raw = _edges(spark).toDF(*quality.EDGE_COLUMNS)
    clean = quality.clean_edges(raw)
    assert _plan(quality.pair_means(clean)).count("Exchange ") == 1
    assert clean.count() == 42


def test_opacity_sorts_no_edges_to_sum_them(spark, monkeypatch):
    plans = {}
    written = Workspace.materialize

    def noted(self, df, *parts):
        plans["/".join(parts)] = _plan(df)
        return written(self, df, *parts)

    monkeypatch.setattr(Workspace, "materialize", noted)
    seed = spark.createDataFrame([(f"p{k}", k / 10) for k in range(5)], "CONT_RUT string, Valor double")
    run = propagation.run_opacity(quality.clean_edges(_edges(spark).toDF(*quality.EDGE_COLUMNS)), seed)
    got = {r.CONT_RUT: r.iterations for r in run.companies.collect()}
    assert "SortAggregate" not in plans["state"]
    assert "pairs" not in plans
    assert got["c1"] == 1 and got[None] == 0 and len(got) == 41


def test_opacity_joins_small_partitions_by_hash(spark, monkeypatch):
    """Shuffled sides are not sorted; the session keeps its own settings."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in [*names, *iterate.MANY_KEYS_CONF]}
    plans = {}
    settings = Workspace._write_settings
    written = Workspace.materialize

    def noted(self, df, *parts):
        again = df.select("*")
        with settings(self):
            again.collect()
            plans["/".join(parts)] = _plan(again).split("== Initial Plan ==")[0]
        return written(self, df, *parts)

    monkeypatch.setattr(Workspace, "materialize", noted)
    seed = spark.createDataFrame([(f"p{k}", k / 10) for k in range(5)], "CONT_RUT string, Valor double")
    try:
        for n in names:
            spark.conf.set(n, "-1")
        run = propagation.run_opacity(quality.clean_edges(_edges(spark).toDF(*quality.EDGE_COLUMNS)), seed)
        got = {r.CONT_RUT: r.iterations for r in run.companies.collect()}
    finally:
        for n in names:
            spark.conf.unset(n) if before[n] is None else spark.conf.set(n, before[n])
    assert "ShuffledHashJoin" in plans["edges"] and "SortMergeJoin" not in plans["edges"]
    assert got["c1"] == 1 and got[None] == 0 and len(got) == 41
    assert {n: spark.conf.get(n, None) for n in before} == before
    inner = Workspace(spark, "many", many_keys=True).folder("inner")
    assert inner.many_keys and not Workspace(spark, "few").many_keys


def test_single_owner_check_cleans_once(spark, monkeypatch, tmp_path):
    calls = []
    plan = propagation.opacity_index
    monkeypatch.setattr(propagation, "opacity_index", lambda edges, *a, **k: calls.append(_plan(edges)) or plan(edges, *a, **k))
    for name, rows, schema in [
        ("lineitem", [(k, k % 3, 1, 5.0, 0.1) for k in range(1, 30)], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double"),
        ("orders", [(k, k % 4) for k in range(1, 500)], "o_orderkey long, o_custkey long"),
        ("customer", [(k,) for k in range(4)], "c_custkey long"),
        ("supplier", [(k,) for k in range(3)], "s_suppkey long"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = registry.single_owner_check(spark, str(tmp_path))
    assert {r.RUT_SOCIEDAD for r in found.collect()} >= {"O36", "O48", "G400"}
    assert len(calls) == 1 and "Exchange" not in calls[0]
