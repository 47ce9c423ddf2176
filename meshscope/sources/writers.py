"""Writers (O-02): distributed parquet / CSV sinks.

Results are written by the executors; nothing is collected to the driver.
One persisted frame can feed several targets (the family index is stored
in two places upstream): pass several paths to write it once per target
without recomputing the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "overwrite",
    sep: str = ",",
    header: bool = True,
    partition_by: Sequence[str] | None = None,
) -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "table":
        # ``path`` is a catalog table name here.
        writer.format("parquet").saveAsTable(path)
    elif fmt == "csv":
        writer.option("header", header).option("sep", sep).csv(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_sorted(df: DataFrame, path: str, by: Sequence[str], files: int | None = None, mode: str = "overwrite") -> None:
    """Write parquet whose files, in the order of their names, are sorted by ``by`` as a whole.

    Rows are range-partitioned on ``by`` (sampled bounds, no single task) and sorted
    within each file, so the minima and maxima of files and row groups hardly overlap:
    equality, prefix and threshold filters on the first column read few of them.  A
    value that holds more than a file's share of the rows stays in one file unless
    ``by`` names further columns to split it.
    """
    dealt = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.mode(mode).parquet(path)


def write_many(df: DataFrame, paths: Sequence[str], **kw) -> None:
    """Write one result to several targets, computing it once."""
    if len(paths) == 1:
        write_table(df, paths[0], **kw)
        return
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for path in paths:
            write_table(df, path, **kw)
    finally:
        df.unpersist()
