"""Readers (O-01): catalog tables, parquet and CSV into declared schemas.

Every reader returns exactly the declared columns with the declared types.
Schemas are never inferred: an unencrypted numeric id would otherwise lose
its leading zeros, and inference costs an extra pass over the data.  CSV is
read as text (header names, no inference) and cast column by column, with an
optional decimal-comma normalisation for ``;``-separated exports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshscope.functions.columns import decimal_point, decimal_text
from meshscope.plans.iterate import Workspace
from meshscope.sources import schemas as S


def conform(df: DataFrame, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Select and cast ``df`` to ``schema``.

    String columns are kept as they are; numeric columns coming from text
    are trimmed and accept a decimal comma.  With ``strict`` an unparsable
    number raises (ANSI cast); otherwise it becomes NULL.
    """
    renamed = df
    for old, new in S.COLUMN_ALIASES.items():
        if old in df.columns and new not in df.columns:
            renamed = renamed.withColumnRenamed(old, new)
    missing = [f.name for f in schema.fields if f.name not in renamed.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}; has {renamed.columns}")
    cols = []
    for field in schema.fields:
        src = renamed.schema[field.name].dataType
        c = F.col(field.name)
        if src == field.dataType:
            cols.append(c)
            continue
        if isinstance(src, T.StringType) and isinstance(field.dataType, T.NumericType):
            c = decimal_text(c)
        cast = c.cast(field.dataType) if strict else c.try_cast(field.dataType)
        cols.append(cast.alias(field.name))
    return renamed.select(*cols)


def read_table(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    fmt: str = "parquet",
    sep: str = ",",
    header: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Read ``source`` (a path, or a catalog name when ``fmt='table'``)."""
    if fmt == "table":
        raw = spark.table(source)
    elif fmt == "parquet":
        raw = spark.read.parquet(source)
    elif fmt == "csv":
        raw = spark.read.option("header", header).option("sep", sep).csv(source)
        if not header:
            raw = raw.toDF(*[f.name for f in schema.fields][: len(raw.columns)])
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return conform(raw, schema, strict=strict)


REASON = "REASON"
RECORD = "RECORD"


def read_with_rejects(
    spark: SparkSession, source: str, schema: T.StructType, workspace: Workspace, sep: str = ",", header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The typed rows of a CSV, and its rejects ``(RECORD, REASON)``, from one pass over the file.

    A line is rejected if it has too few or too many fields (``fields``), or if a
    field that is not empty is no number where one is declared (its column's name);
    the first reason in the order of the columns is given.  The scan is written once.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = (
        spark.read.schema(texts.add(RECORD, T.StringType()))
        .option("header", header)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", RECORD)
        .csv(source)
    )
    names = [f.name for f in schema.fields]
    checked = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    # One step each, so a text is made a number, and a number cast, once a row.
    trimmed = {f"_t_{f.name}": F.trim(F.col(f.name)) if isinstance(f.dataType, T.NumericType) else F.col(f.name) for f in checked}
    numbers = {
        f"_t_{f.name}": decimal_point(F.col(f"_t_{f.name}")) for f in checked if isinstance(f.dataType, T.NumericType)
    }
    values = {f"_v_{f.name}": F.col(f"_t_{f.name}").try_cast(f.dataType) for f in checked}
    reason = F.when(F.col(RECORD).isNotNull(), F.lit("fields"))
    for field in checked:
        wrong = F.col(f"_t_{field.name}").isNotNull() & F.col(f"_v_{field.name}").isNull()
        reason = reason.when(wrong, F.lit(field.name))
    steps = raw.withColumns(trimmed).withColumns(numbers).withColumns(values).withColumn(REASON, reason)
    line = F.coalesce(RECORD, F.concat_ws(sep, *[F.coalesce(n, F.lit("")) for n in names]))
    typed = [F.col(f"_v_{f.name}" if f in checked else f.name).alias(f.name) for f in schema.fields]
    parsed = workspace.materialize(
        steps.select(*typed, F.when(F.col(REASON).isNotNull(), line).alias(RECORD), REASON), "parsed"
    )
    good = parsed.filter(F.col(REASON).isNull()).select(*[f.name for f in schema.fields])
    return good, parsed.filter(F.col(REASON).isNotNull()).select(RECORD, REASON)


POSITION = "POSITION"


def read_positioned(spark: SparkSession, source: str, schema: T.StructType) -> DataFrame:
    """The rows of a parquet folder with their place in it, ``POSITION`` (file, row of the file).

    Files count in the order of their names, as a reader of the whole folder takes them.
    """
    raw = spark.read.parquet(source)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return raw.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], place.alias(POSITION))


def load_edges(spark: SparkSession, source: str, **kw) -> DataFrame:
    return read_table(spark, source, S.OWNERSHIP, **kw)


def load_seed(spark: SparkSession, source: str, **kw) -> DataFrame:
    return read_table(spark, source, S.SEED, **kw)


def load_family(spark: SparkSession, source: str, **kw) -> DataFrame:
    return read_table(spark, source, S.FAMILY, **kw)


def load_groups(spark: SparkSession, source: str, **kw) -> DataFrame:
    return read_table(spark, source, S.KNOWN_GROUPS, **kw)
