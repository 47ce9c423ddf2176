"""DuckDB oracle SQL for every registered query.

Plain SQL over the pre-registered test views.  Iterative operators are recursive
queries without a bound, written in another form than the Spark loops (a score
is a sum over ownership paths, cycles come from the transitive closure, path
bags are listed, pools are self-joined), so the oracle is an independent
restatement and cannot share a cut.  Computed doubles
are rounded to 6 places and integer aggregates cast to BIGINT, as in the
registered queries.
"""

from __future__ import annotations

from meshscope.functions.columns import POSITION_DIGITS
from meshscope.plans import registry as R


def _id(prefix: str, expr: str) -> str:
    return f"'{prefix}' || CAST({expr} AS VARCHAR)"


D0 = "CAST(0 AS DOUBLE)"

FIXTURE = f"""
ownership AS (
  SELECT {_id('O', 'l_orderkey')} AS RUT_SOCIEDAD, {_id('S', 'l_suppkey')} AS RUT_SOCIO,
         CASE WHEN l_linenumber = 7 THEN {D0} ELSE l_quantity END AS PORCENTAJE_CAPITAL,
         CASE WHEN l_linenumber = 7 OR l_discount = 0 THEN {D0} ELSE l_quantity END AS PORCENTAJE_UTILIDADES
  FROM lineitem
  UNION ALL
  SELECT {_id('O', 'l_orderkey')}, {_id('S', 'l_suppkey')}, l_quantity,
         CASE WHEN l_discount = 0 THEN {D0} ELSE l_quantity END
  FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 5 = 0
  UNION ALL
  SELECT {_id('O', 'o_orderkey')}, {_id('C', 'o_custkey')}, CAST(20 AS DOUBLE), CAST(20 AS DOUBLE) FROM orders
  UNION ALL
  SELECT {_id('O', 'o_orderkey')}, {_id('O', 'o_orderkey - 1')}, CAST(10 AS DOUBLE), CAST(10 AS DOUBLE)
  FROM orders WHERE o_orderkey % 12 <> 0
  UNION ALL
  SELECT {_id('O', 'o_orderkey')}, {_id('O', 'o_orderkey + 1')}, CAST(5 AS DOUBLE), CAST(5 AS DOUBLE)
  FROM orders WHERE o_orderkey % 240 = 0
  UNION ALL
  SELECT {_id('O', 'o_orderkey')}, 'S0', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
  FROM orders WHERE o_orderkey % 500 = 1
  UNION ALL
  SELECT {_id('G', 'o_orderkey')}, 'P1', CAST(100 AS DOUBLE), CAST(100 AS DOUBLE)
  FROM orders WHERE o_orderkey % 400 = 0
),
seed AS (
  SELECT {_id('C', 'c_custkey')} AS CONT_RUT, CAST(c_custkey % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS Valor
  FROM customer WHERE c_custkey % 50 <> 7
  UNION ALL
  SELECT {_id('S', 's_suppkey')}, CAST(s_suppkey % 97 AS DOUBLE) / CAST(100 AS DOUBLE)
  FROM supplier WHERE s_suppkey % 100 <> 13
  UNION ALL
  SELECT 'P1', CAST(1 AS DOUBLE)
),
family AS (
  SELECT {_id('S', 's_suppkey')} AS CONT_RUT, {_id('S', 's_suppkey + 1')} AS RUT_FAM, 'NEXT' AS TIPO_RELACION
  FROM supplier
  UNION ALL
  SELECT {_id('S', 's_suppkey')}, {_id('S', 's_suppkey + 7')}, 'NEXT' FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL
  SELECT {_id('S', 's_suppkey')}, {_id('S', 's_suppkey')}, 'SELF' FROM supplier WHERE s_suppkey % 10 = 0
  UNION ALL
  SELECT {_id('C', 'c_custkey')}, {_id('S', 'c_custkey // 15 + 1')}, 'CLIENT' FROM customer
  UNION ALL
  SELECT {_id('C', 'c_custkey')}, 'S1', 'HUB' FROM customer WHERE c_custkey % 20 = 0
),
known_groups AS (
  SELECT {_id('O', 'o_orderkey')} AS PARU_RUT_E, o_orderpriority AS COM FROM orders WHERE o_orderkey % 500 = 0
  UNION ALL
  SELECT {_id('X', 'i')}, 'none' FROM range(5) t(i)
),
dedup AS (
  SELECT DISTINCT RUT_SOCIEDAD, RUT_SOCIO, PORCENTAJE_CAPITAL, PORCENTAJE_UTILIDADES FROM ownership
),
clean AS (SELECT * FROM dedup WHERE PORCENTAJE_CAPITAL <> 0)"""


OPACITY = """pm AS (
  SELECT RUT_SOCIEDAD, RUT_SOCIO, avg(PORCENTAJE_CAPITAL) AS w FROM clean GROUP BY RUT_SOCIEDAD, RUT_SOCIO
),
e AS (
  SELECT pm.RUT_SOCIEDAD, pm.RUT_SOCIO, pm.w, s.Valor AS v
  FROM pm LEFT JOIN seed s ON pm.RUT_SOCIO = s.CONT_RUT
),
tot AS (SELECT RUT_SOCIEDAD AS c, sum(w) AS sw FROM e GROUP BY RUT_SOCIEDAD),
-- unscored owners that are companies, and all companies above a company
ce AS (SELECT e.RUT_SOCIEDAD AS c, e.RUT_SOCIO AS o FROM e JOIN tot ON e.RUT_SOCIO = tot.c WHERE e.v IS NULL),
up AS (SELECT c, o FROM ce UNION SELECT up.c, ce.o FROM up JOIN ce ON up.o = ce.c),
stuck AS (
  SELECT e.RUT_SOCIEDAD AS c FROM e LEFT JOIN tot ON e.RUT_SOCIO = tot.c WHERE e.v IS NULL AND tot.c IS NULL
  UNION SELECT c FROM up WHERE c = o
),
bad AS (SELECT c FROM stuck UNION SELECT up.c FROM up JOIN stuck ON up.o = stuck.c),
-- every ownership path of the other companies, with its share of the capital
walk AS (
  SELECT e.RUT_SOCIEDAD AS c, e.RUT_SOCIO AS node, e.w / tot.sw AS f, e.v, 0 AS depth
  FROM e JOIN tot ON e.RUT_SOCIEDAD = tot.c
  WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.c = e.RUT_SOCIEDAD)
  UNION ALL
  SELECT walk.c, e.RUT_SOCIO, walk.f * e.w / tot.sw, e.v, walk.depth + 1
  FROM walk JOIN e ON walk.node = e.RUT_SOCIEDAD JOIN tot ON e.RUT_SOCIEDAD = tot.c WHERE walk.v IS NULL
),
res AS (
  SELECT c AS CONT_RUT, sum(f * v) AS Value, CAST(max(depth) AS INTEGER) AS iterations
  FROM walk WHERE v IS NOT NULL GROUP BY c
),
scored_edges AS (
  SELECT e.RUT_SOCIEDAD, e.RUT_SOCIO, e.w AS PORCENTAJE_CAPITAL, coalesce(e.v, res.Value) AS Valor
  FROM e LEFT JOIN res ON e.RUT_SOCIO = res.CONT_RUT
)"""

OWNERS = """bag AS (
  SELECT RUT_SOCIEDAD AS c, RUT_SOCIO AS o, count(*) AS m FROM clean GROUP BY RUT_SOCIEDAD, RUT_SOCIO
),
co AS (SELECT DISTINCT c FROM bag),
held AS (SELECT bag.c, bag.o FROM bag JOIN co ON bag.o = co.c),
above AS (SELECT c, o FROM held UNION SELECT above.c, held.o FROM above JOIN held ON above.o = held.c),
loops AS (SELECT c FROM above WHERE c = o),
cyc AS (SELECT c FROM loops UNION SELECT above.c FROM above JOIN loops ON above.o = loops.c),
paths AS (
  SELECT c, o AS node, m AS n FROM bag WHERE NOT EXISTS (SELECT 1 FROM cyc WHERE cyc.c = bag.c)
  UNION ALL
  SELECT paths.c, bag.o, paths.n * bag.m FROM paths JOIN bag ON paths.node = bag.c
),
cyc_reach AS (
  SELECT bag.c, bag.o AS node FROM bag JOIN cyc ON bag.c = cyc.c
  UNION SELECT cyc_reach.c, bag.o FROM cyc_reach JOIN bag ON cyc_reach.node = bag.c
),
cyc_leaves AS (SELECT c, node FROM cyc_reach WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.c = cyc_reach.node)),
uo AS (
  SELECT p.c AS RUT_SOCIEDAD, p.node AS RUT_SOCIO, s.CONT_RUT, CAST(sum(p.n) AS BIGINT) AS n_paths,
         FALSE AS above_cycle
  FROM paths p LEFT JOIN seed s ON p.node = s.CONT_RUT
  WHERE NOT EXISTS (SELECT 1 FROM co WHERE co.c = p.node)
  GROUP BY p.c, p.node, s.CONT_RUT
  UNION ALL
  SELECT r.c, r.node, s.CONT_RUT, CAST(NULL AS BIGINT), TRUE FROM cyc_leaves r LEFT JOIN seed s ON r.node = s.CONT_RUT
  UNION ALL
  SELECT c, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), TRUE FROM cyc
  WHERE c NOT IN (SELECT c FROM cyc_leaves)
),
pool AS (
  SELECT RUT_SOCIEDAD, CAST(sum(n_paths) AS BIGINT) AS TOTAL,
         CAST(sum(CASE WHEN CONT_RUT IS NOT NULL THEN n_paths ELSE n_paths * 0 END) AS BIGINT) AS NONULOS
  FROM uo GROUP BY RUT_SOCIEDAD
),
pool_flag AS (
  SELECT RUT_SOCIEDAD, TOTAL, NONULOS, coalesce(TOTAL = NONULOS, FALSE) AS eligible FROM pool
),
members AS (
  SELECT uo.RUT_SOCIEDAD, uo.CONT_RUT AS p, uo.n_paths AS n
  FROM uo JOIN pool_flag f ON uo.RUT_SOCIEDAD = f.RUT_SOCIEDAD
  WHERE f.eligible AND uo.CONT_RUT IS NOT NULL
)"""


RELATIONS = """rel AS (
  SELECT DISTINCT CONT_RUT, RUT_FAM FROM (
    SELECT CONT_RUT, RUT_FAM FROM family WHERE CONT_RUT <> RUT_FAM
    UNION ALL
    SELECT RUT_FAM, CONT_RUT FROM family WHERE CONT_RUT <> RUT_FAM)
),
related AS (
  SELECT a.RUT_SOCIEDAD, a.p AS RUT_SOCIO_1, b.p AS RUT_SOCIO_2, a.n * b.n AS n_pairs
  FROM rel JOIN members a ON a.p = rel.CONT_RUT
  JOIN members b ON b.p = rel.RUT_FAM AND b.RUT_SOCIEDAD = a.RUT_SOCIEDAD
)"""


def _closure_ctes(hops: int = 4, exclude: str | None = None) -> str:
    cond = "CONT_RUT IS NOT NULL AND RUT_FAM IS NOT NULL"
    if exclude is not None:
        cond += f" AND CONT_RUT <> '{exclude}' AND RUT_FAM <> '{exclude}'"
    parts = [
        f"""st AS (
  SELECT DISTINCT CONT_RUT AS a, RUT_FAM AS b FROM family WHERE {cond}
),
l1 AS (SELECT a, b FROM st)"""
    ]
    for h in range(2, hops + 1):
        parts.append(
            f"l{h} AS (SELECT DISTINCT l.a, s.b FROM l{h - 1} l JOIN st s ON l.b = s.a)"
        )
    levels = "\n  UNION ALL ".join(
        f"SELECT a, b, {h} AS hop FROM l{h} WHERE a <> b" for h in range(1, hops + 1)
    )
    parts.append(f"lv AS (\n  {levels}\n)")
    return ",\n".join(parts)


def _with(*blocks: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([FIXTURE, *blocks]) + "\n"


def _r6(expr: str, name: str) -> str:
    return f"round(({expr}) + {R.ROUND_NUDGE}, 6) AS {name}"


def _hist_sql(column: str, bins: int, where: str = "TRUE") -> str:
    width = "((b.hi - b.lo) / " + str(bins) + ")"
    return _with(OPACITY) + f""", vals AS (
  SELECT CAST({column} AS DOUBLE) AS v FROM res WHERE {column} IS NOT NULL AND {where}
),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM vals),
binned AS (
  SELECT CAST(CASE WHEN b.hi = b.lo THEN 1
              ELSE least({bins}, floor(round((v - b.lo) / (b.hi - b.lo), {POSITION_DIGITS}) * {bins}) + 1) END AS INTEGER) AS bin
  FROM vals, b
),
counts AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin),
grid AS (SELECT CAST(i + 1 AS INTEGER) AS bin FROM range({bins}) t(i))
SELECT g.bin,
       {_r6('coalesce(b.lo, 0) + (g.bin - 1) * coalesce(' + width + ', 0)', 'lo')},
       {_r6('coalesce(b.lo, 0) + g.bin * coalesce(' + width + ', 0)', 'hi')},
       CAST(coalesce(c.n, 0) AS BIGINT) AS count,
       CAST(sum(coalesce(c.n, 0)) OVER (ORDER BY g.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
         AS cumulative
FROM grid g CROSS JOIN b LEFT JOIN counts c ON g.bin = c.bin
"""


EDGE_COLS = "RUT_SOCIEDAD, RUT_SOCIO, PORCENTAJE_CAPITAL, PORCENTAJE_UTILIDADES"

_DESCRIBE_STATS = [
    ("count", "CAST(count({c}) AS DOUBLE)"),
    ("mean", "avg({c})"),
    ("std", "stddev_samp({c})"),
    ("min", "min({c})"),
    ("25%", "quantile_cont({c}, 0.25)"),
    ("50%", "quantile_cont({c}, 0.5)"),
    ("75%", "quantile_cont({c}, 0.75)"),
    ("max", "max({c})"),
]


def _describe_selects(source: str, columns: tuple[str, ...]) -> str:
    selects = []
    for col in columns:
        c = f"CAST({col} AS DOUBLE)"
        for name, expr in _DESCRIBE_STATS:
            selects.append(
                f"SELECT '{col}' AS variable, '{name}' AS stat, "
                f"{_r6(expr.format(c=c), 'value')} FROM {source}"
            )
    return "\n UNION ALL ".join(selects)


_FAMILY_INDEX = """, fc AS (
  SELECT RUT_SOCIEDAD, count(DISTINCT RUT_SOCIO_1) AS FAMILIARES FROM related GROUP BY RUT_SOCIEDAD
),
fi AS (
  SELECT p.RUT_SOCIEDAD, CAST(coalesce(fc.FAMILIARES, 0) AS BIGINT) AS FAMILIARES, p.TOTAL,
         CAST(coalesce(fc.FAMILIARES, 0) AS DOUBLE) / p.TOTAL * 100 AS TASA_FAMILIARIDAD
  FROM pool_flag p LEFT JOIN fc ON p.RUT_SOCIEDAD = fc.RUT_SOCIEDAD
)
"""
_ANOMALIES = """, anomalies AS (
  SELECT * FROM (SELECT RUT_SOCIEDAD, sum(PORCENTAJE_CAPITAL) AS CAPITAL, sum(PORCENTAJE_UTILIDADES) AS UTILIDADES
  FROM dedup GROUP BY RUT_SOCIEDAD) WHERE CAPITAL > 105 OR CAPITAL < 95
)
"""
_SYMMETRIC_CLOSURE = """, sym AS (SELECT DISTINCT CONT_RUT, RUT_FAM FROM (
  SELECT a AS CONT_RUT, b AS RUT_FAM FROM lv UNION ALL SELECT b, a FROM lv)),
related_c AS (
  SELECT a.RUT_SOCIEDAD, a.p FROM sym JOIN members a ON a.p = sym.CONT_RUT
  JOIN members b ON b.p = sym.RUT_FAM AND b.RUT_SOCIEDAD = a.RUT_SOCIEDAD AND a.p <> b.p
),
fcc AS (SELECT RUT_SOCIEDAD, count(DISTINCT p) AS FAMILIARES FROM related_c GROUP BY RUT_SOCIEDAD)
"""


def oracle_sql() -> dict[str, str]:
    opa = _with(OPACITY)
    owners = _with(OWNERS)
    fam_all = _with(OWNERS, RELATIONS)
    closure = _with(_closure_ctes(4))
    closure2 = _with(_closure_ctes(2, R.CLOSURE_EXCLUDE))
    sql = {
        "clean_edges_profit": _with() + f"SELECT {EDGE_COLS} FROM dedup WHERE PORCENTAJE_UTILIDADES <> 0",
        "clean_edges_no_anomalies": _with()
        + f"""SELECT {EDGE_COLS} FROM clean c WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT RUT_SOCIEDAD, sum(PORCENTAJE_CAPITAL) AS t FROM dedup GROUP BY RUT_SOCIEDAD) a
  WHERE a.RUT_SOCIEDAD = c.RUT_SOCIEDAD AND (a.t > 105 OR a.t < 95))""",
        "opacity_edges_filled": opa
        + f"""SELECT e.RUT_SOCIEDAD, e.RUT_SOCIO, {_r6('e.w', 'PORCENTAJE_CAPITAL')},
       {_r6('coalesce(e.v, p.Value)', 'Valor')}
FROM e LEFT JOIN (SELECT * FROM res WHERE iterations < {R.BEFORE_ROUND}) p ON e.RUT_SOCIO = p.CONT_RUT""",
        "opacity_index_notebook_rounds": opa
        + f"SELECT CONT_RUT, {_r6('Value', 'Value')}, iterations FROM res WHERE iterations <= {R.NOTEBOOK_ROUNDS}",
        "owner_pool_small": owners
        + f"SELECT RUT_SOCIEDAD, TOTAL, NONULOS, eligible FROM pool_flag WHERE TOTAL <= {R.SMALL_POOL}",
        "companies_per_person_distinct": owners
        + "SELECT CONT_RUT, CAST(count(*) AS BIGINT) AS SOCIEDADES_RELACIONADAS FROM uo "
        "WHERE CONT_RUT IS NOT NULL GROUP BY CONT_RUT",
        "family_index_variant": fam_all
        + f""", sizes AS (
  SELECT RUT_SOCIEDAD, count(CONT_RUT) AS TOTAL, count(CONT_RUT) = count(*) AS eligible FROM uo GROUP BY RUT_SOCIEDAD
),
fc AS (
  SELECT a.RUT_SOCIEDAD, count(DISTINCT a.CONT_RUT) AS FAMILIARES
  FROM rel JOIN uo a ON a.CONT_RUT = rel.CONT_RUT
  JOIN uo b ON b.CONT_RUT = rel.RUT_FAM AND b.RUT_SOCIEDAD = a.RUT_SOCIEDAD
  JOIN sizes s ON s.RUT_SOCIEDAD = a.RUT_SOCIEDAD AND s.eligible
  GROUP BY a.RUT_SOCIEDAD
)
SELECT s.RUT_SOCIEDAD, CAST(fc.FAMILIARES AS BIGINT) AS FAMILIARES, CAST(s.TOTAL AS BIGINT) AS TOTAL,
       {_r6('CAST(fc.FAMILIARES AS DOUBLE) / s.TOTAL * 100', 'TASA_FAMILIARIDAD')}, s.eligible
FROM sizes s LEFT JOIN fc ON s.RUT_SOCIEDAD = fc.RUT_SOCIEDAD""",
        "family_closure_two_hops": closure2
        + """SELECT DISTINCT CONT_RUT, RUT_FAM FROM (
  SELECT a AS CONT_RUT, b AS RUT_FAM FROM lv UNION ALL SELECT b, a FROM lv)""",
        "load_edges": _with() + f"SELECT {EDGE_COLS} FROM ownership",
        "write_round_trip": _with() + f"SELECT {EDGE_COLS} FROM clean",
        "clean_edges": _with() + f"SELECT {EDGE_COLS} FROM clean",
        "null_share_rows": _with()
        + f"SELECT {EDGE_COLS} FROM ownership WHERE PORCENTAJE_CAPITAL IS NULL OR PORCENTAJE_UTILIDADES IS NULL",
        "zero_share_profile": _with()
        + """SELECT
  CAST(count(*) FILTER (WHERE PORCENTAJE_CAPITAL = 0 OR PORCENTAJE_UTILIDADES = 0) AS BIGINT) AS any_zero,
  CAST(count(*) FILTER (WHERE PORCENTAJE_CAPITAL = 0 AND PORCENTAJE_UTILIDADES = 0) AS BIGINT) AS both_zero,
  CAST(count(*) FILTER (WHERE PORCENTAJE_CAPITAL = 0 AND PORCENTAJE_UTILIDADES <> 0) AS BIGINT) AS only_capital_zero,
  CAST(count(*) FILTER (WHERE PORCENTAJE_CAPITAL <> 0 AND PORCENTAJE_UTILIDADES = 0) AS BIGINT) AS only_profit_zero
FROM dedup""",
        "out_of_range_shares": _with()
        + f"""SELECT {EDGE_COLS} FROM dedup
WHERE PORCENTAJE_CAPITAL < 0 OR PORCENTAJE_CAPITAL > {R.OUT_OF_RANGE_HI}
   OR PORCENTAJE_UTILIDADES < 0 OR PORCENTAJE_UTILIDADES > {R.OUT_OF_RANGE_HI}""",
        "duplicate_edges": _with()
        + f"SELECT {EDGE_COLS}, CAST(count(*) AS BIGINT) AS c FROM ownership GROUP BY ALL HAVING count(*) >= 2",
        "pair_multiplicity": _with()
        + "SELECT RUT_SOCIEDAD, RUT_SOCIO, CAST(count(*) AS BIGINT) AS c FROM dedup "
        "GROUP BY RUT_SOCIEDAD, RUT_SOCIO HAVING count(*) >= 2",
        "composition_totals": _with()
        + f"SELECT RUT_SOCIEDAD, {_r6('sum(PORCENTAJE_CAPITAL)', 'CAPITAL')}, "
        f"{_r6('sum(PORCENTAJE_UTILIDADES)', 'UTILIDADES')} FROM dedup GROUP BY RUT_SOCIEDAD",
        "capital_anomalies": _with()
        + f"""SELECT RUT_SOCIEDAD, {_r6('CAPITAL', 'CAPITAL')}, {_r6('UTILIDADES', 'UTILIDADES')} FROM (
  SELECT RUT_SOCIEDAD, sum(PORCENTAJE_CAPITAL) AS CAPITAL, sum(PORCENTAJE_UTILIDADES) AS UTILIDADES
  FROM dedup GROUP BY RUT_SOCIEDAD) WHERE CAPITAL > 105 OR CAPITAL < 95""",
        "capital_anomalies_pair_mean": _with()
        + f"""SELECT RUT_SOCIEDAD, {_r6('CAPITAL', 'CAPITAL')}, {_r6('UTILIDADES', 'UTILIDADES')} FROM (
  SELECT RUT_SOCIEDAD, sum(cap) AS CAPITAL, sum(pro) AS UTILIDADES FROM (
    SELECT RUT_SOCIEDAD, RUT_SOCIO, avg(PORCENTAJE_CAPITAL) AS cap, avg(PORCENTAJE_UTILIDADES) AS pro
    FROM clean GROUP BY RUT_SOCIEDAD, RUT_SOCIO) GROUP BY RUT_SOCIEDAD)
WHERE CAPITAL > 105 OR CAPITAL < 90""",
        "entity_lookup_prefix": _with()
        + f"SELECT {EDGE_COLS} FROM clean WHERE starts_with(RUT_SOCIEDAD, '{R.LOOKUP_PREFIX}') "
        f"OR starts_with(RUT_SOCIO, '{R.LOOKUP_PREFIX}')",
        "entity_lookup_id": _with()
        + f"SELECT {EDGE_COLS} FROM clean WHERE RUT_SOCIEDAD = '{R.LOOKUP_ID}' OR RUT_SOCIO = '{R.LOOKUP_ID}'",
        "group_coverage": _with()
        + """, g AS (SELECT DISTINCT PARU_RUT_E, COM FROM known_groups),
m AS (SELECT g.PARU_RUT_E, c.RUT_SOCIEDAD FROM g LEFT JOIN clean c ON g.PARU_RUT_E = c.RUT_SOCIEDAD)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM g) AS groups,
       CAST(count(RUT_SOCIEDAD) AS BIGINT) AS matched_edges,
       CAST(count(DISTINCT CASE WHEN RUT_SOCIEDAD IS NOT NULL THEN PARU_RUT_E END) AS BIGINT) AS matched_groups
FROM m""",
        "opacity_index": opa + f"SELECT CONT_RUT, {_r6('Value', 'Value')}, iterations FROM res",
        "opacity_edges": opa
        + f"SELECT RUT_SOCIEDAD, RUT_SOCIO, {_r6('PORCENTAJE_CAPITAL', 'PORCENTAJE_CAPITAL')}, "
        f"{_r6('Valor', 'Valor')} FROM scored_edges",
        "incomplete_companies": opa
        + """SELECT RUT_SOCIEDAD, CAST(count(*) AS BIGINT) AS N_SOCIOS,
       CAST(count(*) FILTER (WHERE Valor IS NULL) AS BIGINT) AS N_FALTANTES
FROM scored_edges GROUP BY RUT_SOCIEDAD HAVING count(*) FILTER (WHERE Valor IS NULL) > 0""",
        "single_owner_check": opa
        + f""", r0 AS (SELECT CONT_RUT AS c, Value AS V FROM res WHERE iterations = 0),
single AS (
  SELECT RUT_SOCIEDAD FROM pm GROUP BY RUT_SOCIEDAD HAVING count(RUT_SOCIO) = 1
)
SELECT cl.RUT_SOCIEDAD, cl.RUT_SOCIO, cl.PORCENTAJE_CAPITAL, {_r6('r0.V', 'Oscuridad_PJ')},
       s.Valor AS Oscuridad_PN, CASE WHEN abs(r0.V - s.Valor) <= 1e-9 THEN 1 ELSE 0 END AS Comp
FROM clean cl JOIN single ON cl.RUT_SOCIEDAD = single.RUT_SOCIEDAD
JOIN r0 ON cl.RUT_SOCIEDAD = r0.c JOIN seed s ON cl.RUT_SOCIO = s.CONT_RUT""",
        "ultimate_owners": owners + "SELECT RUT_SOCIEDAD, RUT_SOCIO, CONT_RUT, n_paths, above_cycle FROM uo",
        "companies_per_person": owners
        + "SELECT CONT_RUT, CAST(sum(n_paths) AS BIGINT) AS SOCIEDADES_RELACIONADAS FROM uo "
        "WHERE CONT_RUT IS NOT NULL AND NOT above_cycle GROUP BY CONT_RUT",
        "owner_pool_distinct": owners
        + """, d AS (
  SELECT RUT_SOCIEDAD, CAST(count(CASE WHEN NOT above_cycle OR RUT_SOCIO IS NOT NULL THEN 1 END) AS BIGINT) AS TOTAL,
         CAST(count(CONT_RUT) AS BIGINT) AS NONULOS FROM uo GROUP BY RUT_SOCIEDAD)
SELECT RUT_SOCIEDAD, TOTAL, NONULOS, TOTAL = NONULOS AND TOTAL > 0 AS eligible FROM d""",
        "owner_pool": owners + "SELECT RUT_SOCIEDAD, TOTAL, NONULOS, eligible FROM pool_flag",
        "co_owner_pairs": fam_all
        + "SELECT RUT_SOCIEDAD, RUT_SOCIO_1, RUT_SOCIO_2, CAST(n_pairs AS BIGINT) AS n_pairs FROM related",
        "ego_network": _with()
        + f""", ent AS (SELECT unnest([{', '.join(repr(e) for e in R.EGO_ENTITIES)}]) AS ENTIDAD),
x AS (
  SELECT ent.ENTIDAD, c.RUT_SOCIO, c.RUT_SOCIEDAD, c.PORCENTAJE_CAPITAL,
         CASE WHEN c.RUT_SOCIO = ent.ENTIDAD THEN 'self' ELSE 'in' END AS DIRECCION
  FROM clean c JOIN ent ON c.RUT_SOCIEDAD = ent.ENTIDAD
  UNION ALL
  SELECT ent.ENTIDAD, c.RUT_SOCIO, c.RUT_SOCIEDAD, c.PORCENTAJE_CAPITAL, 'out'
  FROM clean c JOIN ent ON c.RUT_SOCIO = ent.ENTIDAD WHERE c.RUT_SOCIO IS DISTINCT FROM c.RUT_SOCIEDAD
)
SELECT ENTIDAD, RUT_SOCIO, RUT_SOCIEDAD, PORCENTAJE_CAPITAL,
       CAST(floor(PORCENTAJE_CAPITAL / 10) * 10 AS INTEGER) AS BANDA,
       CAST(PORCENTAJE_CAPITAL AS VARCHAR) || '%' AS ETIQUETA, DIRECCION
FROM x""",
        "family_relations": _with(RELATIONS.split(",\nrelated AS")[0])
        + "SELECT CONT_RUT, RUT_FAM FROM rel",
        "family_closure": closure
        + """SELECT DISTINCT CONT_RUT, RUT_FAM FROM (
  SELECT a AS CONT_RUT, b AS RUT_FAM FROM lv UNION ALL SELECT b, a FROM lv)""",
        "family_reach_sizes": closure
        + "SELECT CAST(hop AS INTEGER) AS hop, CAST(count(*) AS BIGINT) AS n_pairs FROM lv GROUP BY hop",
        "load_edges_rejects": _with()
        + """, t AS (
  SELECT RUT_SOCIEDAD AS c, coalesce(RUT_SOCIO, '') AS o,
         CASE WHEN RUT_SOCIO LIKE '%3' THEN 'n/a' ELSE coalesce(CAST(PORCENTAJE_CAPITAL AS VARCHAR), '') END AS k,
         coalesce(CAST(PORCENTAJE_UTILIDADES AS VARCHAR), '') AS u FROM ownership)
SELECT CASE WHEN c LIKE '%7' AND o LIKE '%1' THEN concat_ws(';', c, o, k) ELSE concat_ws(';', c, o, k, u) END AS RECORD,
       CASE WHEN c LIKE '%7' AND o LIKE '%1' THEN 'fields' ELSE 'PORCENTAJE_CAPITAL' END AS REASON
FROM t WHERE (c LIKE '%7' AND o LIKE '%1') OR o LIKE '%3'""",
        "load_edges_accepted": _with()
        + f"""SELECT {EDGE_COLS} FROM ownership
WHERE NOT (RUT_SOCIEDAD LIKE '%7' AND RUT_SOCIO LIKE '%1') AND RUT_SOCIO NOT LIKE '%3'""",
        "sorted_lookup": _with() + f"SELECT {EDGE_COLS} FROM clean WHERE starts_with(RUT_SOCIEDAD, '{R.LOOKUP_PREFIX}')",
        "last_edges": _with()
        + """SELECT RUT_SOCIO, RUT_SOCIEDAD, PORCENTAJE_CAPITAL, PORCENTAJE_UTILIDADES FROM clean
QUALIFY row_number() OVER (PARTITION BY RUT_SOCIO, RUT_SOCIEDAD
                           ORDER BY PORCENTAJE_CAPITAL DESC, PORCENTAJE_UTILIDADES DESC) = 1""",
        "family_closure_sizes": closure
        + "SELECT CAST(hop AS INTEGER) AS hop, CAST(count(*) AS BIGINT) AS n_pairs FROM lv GROUP BY hop",
        "family_index": fam_all
        + f""", fc AS (
  SELECT RUT_SOCIEDAD, count(DISTINCT RUT_SOCIO_1) AS FAMILIARES FROM related GROUP BY RUT_SOCIEDAD
)
SELECT p.RUT_SOCIEDAD, CAST(coalesce(fc.FAMILIARES, 0) AS BIGINT) AS FAMILIARES, p.TOTAL,
       {_r6('CAST(coalesce(fc.FAMILIARES, 0) AS DOUBLE) / p.TOTAL * 100', 'TASA_FAMILIARIDAD')}
FROM pool_flag p LEFT JOIN fc ON p.RUT_SOCIEDAD = fc.RUT_SOCIEDAD""",
        "relation_types": _with()
        + "SELECT TIPO_RELACION, CAST(count(*) AS BIGINT) AS N FROM family GROUP BY TIPO_RELACION",
        "relative_degree": _with()
        + "SELECT CONT_RUT, CAST(count(*) AS BIGINT) AS N FROM family GROUP BY CONT_RUT",
        "describe_scores": opa + _describe_selects("res", ("Value", "iterations")),
        "describe_high_opacity": opa
        + f", high AS (SELECT * FROM res WHERE Value >= {R.HIGH_THRESHOLD})\n"
        + _describe_selects("high", ("Value", "iterations")),
        "describe_family": fam_all
        + _FAMILY_INDEX
        + _describe_selects("fi", ("FAMILIARES", "TOTAL", "TASA_FAMILIARIDAD")),
        "describe_anomalies": _with() + _ANOMALIES + _describe_selects("anomalies", ("CAPITAL", "UTILIDADES")),
        "profit_anomalies": _with()
        + f"""SELECT RUT_SOCIEDAD, {_r6('CAPITAL', 'CAPITAL')}, {_r6('UTILIDADES', 'UTILIDADES')} FROM (
  SELECT RUT_SOCIEDAD, sum(PORCENTAJE_CAPITAL) AS CAPITAL, sum(PORCENTAJE_UTILIDADES) AS UTILIDADES
  FROM dedup GROUP BY RUT_SOCIEDAD) WHERE UTILIDADES > 105 OR UTILIDADES < 95""",
        "load_seed": _with() + "SELECT CONT_RUT, Valor FROM seed",
        "load_family": _with() + "SELECT CONT_RUT, RUT_FAM, TIPO_RELACION FROM family",
        "load_groups": _with() + "SELECT PARU_RUT_E, COM FROM known_groups",
        "group_coverage_raw": _with()
        + """, g AS (SELECT DISTINCT PARU_RUT_E, COM FROM known_groups),
m AS (SELECT g.PARU_RUT_E, c.RUT_SOCIEDAD FROM g LEFT JOIN ownership c ON g.PARU_RUT_E = c.RUT_SOCIEDAD)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM g) AS groups,
       CAST(count(RUT_SOCIEDAD) AS BIGINT) AS matched_edges,
       CAST(count(DISTINCT CASE WHEN RUT_SOCIEDAD IS NOT NULL THEN PARU_RUT_E END) AS BIGINT) AS matched_groups
FROM m""",
        "result_lookup": opa
        + f"SELECT CONT_RUT, {_r6('Value', 'Value')}, iterations FROM res "
        f"WHERE starts_with(CONT_RUT, '{R.RESULT_PREFIX}')",
        "family_index_closure": _with(OWNERS, RELATIONS, _closure_ctes(4))
        + _SYMMETRIC_CLOSURE
        + f"""SELECT p.RUT_SOCIEDAD, CAST(fcc.FAMILIARES AS BIGINT) AS FAMILIARES, p.TOTAL,
       {_r6('CAST(fcc.FAMILIARES AS DOUBLE) / p.TOTAL * 100', 'TASA_FAMILIARIDAD')}
FROM pool_flag p JOIN fcc ON p.RUT_SOCIEDAD = fcc.RUT_SOCIEDAD""",
        "job_companies": opa + f"SELECT CONT_RUT, {_r6('Value', 'Value')}, iterations FROM res",
        "job_family_index": fam_all
        + _FAMILY_INDEX
        + f"SELECT RUT_SOCIEDAD, FAMILIARES, TOTAL, {_r6('TASA_FAMILIARIDAD', 'TASA_FAMILIARIDAD')} FROM fi",
        "completion_rate": opa
        + f"""SELECT CAST(count(DISTINCT RUT_SOCIEDAD) AS BIGINT) AS companies,
       (SELECT CAST(count(*) AS BIGINT) FROM res) AS completed,
       {_r6('CAST((SELECT count(*) FROM res) AS DOUBLE) / count(DISTINCT RUT_SOCIEDAD) * 100', 'pct')}
FROM scored_edges""",
        "high_opacity": opa
        + f"SELECT CONT_RUT, {_r6('Value', 'Value')}, iterations FROM res WHERE Value >= {R.HIGH_THRESHOLD}",
        "high_opacity_top": opa
        + f"SELECT CONT_RUT, {_r6('Value', 'Value')}, iterations FROM res WHERE Value >= 0.0 "
        f"ORDER BY Value DESC, CONT_RUT ASC LIMIT {R.TOP_K}",
        "opacity_exact_one": opa
        + f"SELECT CONT_RUT, {_r6('Value', 'Value')}, iterations FROM res WHERE abs(Value - 1.0) <= 1e-9",
        "score_histogram": _hist_sql("Value", 10),
        "iterations_histogram": _hist_sql("iterations", 10),
        "high_score_histogram": _hist_sql("Value", 10, f"Value >= {R.HIGH_THRESHOLD}"),
        "score_by_round": opa
        + f""", vals AS (SELECT Value AS v, iterations FROM res WHERE Value IS NOT NULL),
b AS (SELECT min(v) AS lo, max(v) AS hi FROM vals)
SELECT CAST(CASE WHEN b.hi = b.lo THEN 1 ELSE least(30, floor(round((v - b.lo) / (b.hi - b.lo), {POSITION_DIGITS}) * 30) + 1) END
            AS INTEGER) AS bin,
       iterations, CAST(count(*) AS BIGINT) AS count
FROM vals, b GROUP BY ALL""",
    }
    return sql
