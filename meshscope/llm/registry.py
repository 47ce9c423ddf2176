"""One query per operator, over the whole of its table, and the SQL that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshscope.llm import (
    decontaminate,
    hard_negatives,
    html_extract,
    language_id,
    line_crf,
    line_dedup,
    packing,
    periodic_runs,
    quality_rules,
    sharding,
    simhash,
    suffix_tree,
    url_filter,
)
from meshscope.llm.common import held_out

SHARDS = [f"shard-{k:03d}" for k in range(64)]
SHINGLE_WORDS = 4
MAX_BITS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", "n_chars")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.filter(~held_out(F.col("doc_id")))
    model = language_id.fit(train, key=F.xxhash64("doc_id", "text"))
    found = language_id.identify(docs, model, keep=["doc_id"])
    return found.select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(
        table(spark, sf_dir, "documents"), SHINGLE_WORDS, MAX_BITS, keep=["doc_id"]
    )
    return found.select(
        "row.doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    field = line_crf.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    found = line_crf.score(docs, field, keep=["doc_id"])
    return found.select(
        "row.doc_id",
        held_out(F.col("row.doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"), SHARDS, keep=["doc_id"])
    return placed.select("row.doc_id", "slot", "shard")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("quality_probability", 6).alias("quality_probability"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", "row.text")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge_urls(table(spark, sf_dir, "pages"), keep=["page_id"])
    return found.select("row.page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return found.select("row.doc_id", F.inline("hits"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in documents whose hash ends in 0 the words from one on repeat a period.

    With n words, h = crc32 of the id and g = floor(h / 10): if h % 10 = 0, word i >= a = g % n
    becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(F.col("doc_id").cast("string"))
    told = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    told = told.withColumn("n", F.size("words")).withColumn("g", F.floor(F.col("h") / 10))
    a = F.col("g") % F.col("n")
    told = told.select("*", a.alias("a"), (1 + F.floor((F.col("n") - a) / (3 + F.col("g") % 8))).alias("p"))
    repeated = F.transform(
        F.sequence(F.lit(0), F.col("n") - 1),
        lambda i: F.element_at(
            "words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int") + 1
        ),
    )
    text = F.when(F.col("words").isNotNull() & (F.col("n") > 0), F.array_join(repeated, " ")).otherwise(F.col("text"))
    return told.select("doc_id", text.alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs, keep=["doc_id"])
    longer = F.col("runs")
    best = F.aggregate(
        longer,
        F.try_element_at(longer, F.lit(1)),
        lambda top, r: F.when(r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top),
    )
    lines = F.transform(
        longer,
        lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")),
    )
    return found.withColumn("top", best).select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    tree = suffix_tree.fit(docs.filter(~out))
    found = suffix_tree.score(docs.withColumn("held_out", out), tree, keep=["doc_id", "held_out"])
    return found.select(
        "row.doc_id",
        "row.held_out",
        "n_tokens",
        "n_known",
        F.lit(tree.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform(
        F.col("embedding").cast("array<double>"),
        lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.floor(256 * x)),
    )
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), whole.alias("embedding"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_language_id": op2_language_id,
    "op3_simhash": op3_simhash,
    "op4_line_crf": op4_line_crf,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_url_filter": op9_url_filter,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_suffix_tree": op12_suffix_tree,
    "op13_hard_negatives": op13_hard_negatives,
}

def _sharding_sql() -> str:
    """Placement by the same table; tests hold the table against a plain restatement."""
    listed = ", ".join(map(str, sharding.fill_table(SHARDS)))
    return f"""
    WITH slots AS (
        SELECT doc_id, CAST(
            ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {sharding.HASH_DIGITS}))::BIGINT
            % {sharding.SLOTS} AS INTEGER) AS slot
        FROM documents),
    filled AS (SELECT unnest([{listed}]) AS k, unnest(range({sharding.SLOTS})) AS slot)
    SELECT doc_id, slots.slot AS slot, 'shard-' || lpad(CAST(k AS VARCHAR), 3, '0') AS shard
    FROM slots JOIN filled USING (slot)
    """


_HARD_NEGATIVES_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, c.vec_id AS row_id, a.label = c.label AS same,
           CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
    FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.e) = len(c.e)),
p AS (
    SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, row_id) AS INTEGER) AS rank,
       row_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op5_sharding": _sharding_sql(),
    "op13_hard_negatives": _HARD_NEGATIVES_SQL,
}
