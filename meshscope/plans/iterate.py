"""Shared machinery for the iterative operators.

Iterative operators (opacity rounds, owner-tree hops, family closure hops)
run a bounded driver loop of DataFrame steps.  Each step's output is written
as a parquet table under the cluster's checkpoint folder and read back:
that cuts the lineage (the plan of round k does not contain rounds 0..k-1),
survives the loss of executors (files live on shared storage, unlike
``localCheckpoint``), and gives AQE exact input sizes for its join choices.
Only scalar tests (is the frontier empty?) reach the driver.
"""

from __future__ import annotations

import json
import re
import uuid

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


CODEC = "zstd"  # intermediate tables
ROWS_PER_BUCKET = 100_000  # rows of a bucketed round table per bucket
# Shuffle files of a write go as soon as the table is written.
WRITE_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
# For tables whose keys are mostly different.  AQE joins shuffled sides by hash, without sorting
# them, where no partition of the one held is larger than the threshold (which must not be less
# than the advisory size); others are sorted and merged.  Aggregates try one map, not two.
MANY_KEYS_CONF = {
    "spark.sql.codegen.aggregate.map.twolevel.enabled": "false",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "32m",
}


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` names it; a session without that setting gets a
    folder under its warehouse directory, unless that is a machine's own folder
    and the session has executors elsewhere.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        if re.match("file:|/", warehouse) and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_meshscope"
    return root.rstrip("/")


class Workspace:
    """A run folder under the checkpoint root holding one operator's tables.

    With a ``run_id`` the folder's name is fixed and the run can be resumed: a
    manifest records each table once it is whole, with the metrics observed while
    it was written, and a later run of the same steps with the same id (on the same
    inputs) reads the recorded tables instead of writing them again.  A job that
    lost its driver so goes on after its last whole round.

    With ``many_keys`` its tables are written under ``MANY_KEYS_CONF``.

    Folders without a ``run_id`` are deleted when the session's JVM ends, unless
    ``cleanup`` was called before; those with one stay until ``cleanup``.
    """

    def __init__(self, spark: SparkSession, name: str, run_id: str | None = None, many_keys: bool = False):
        self.spark = spark
        self.many_keys = many_keys
        self.root = f"{checkpoint_root(spark)}/meshscope/{name}-{run_id or uuid.uuid4().hex[:12]}"
        self.resumable = run_id is not None
        self._tables: list[str] = []
        if not self.resumable:
            path, fs = self._path(self.root)
            fs.mkdirs(path)
            fs.deleteOnExit(path)

    def _path(self, name: str):
        """A Hadoop path and its file system."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _entry(self, parts: tuple[str, ...]) -> str:
        return self.path("_manifest", "__".join("/".join(parts).split("/")) + ".json")

    def _recorded(self, parts: tuple[str, ...]) -> dict | None:
        """The metrics of a table that a run with this id has already written, else None."""
        if not self.resumable:
            return None
        path, fs = self._path(self._entry(parts))
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _record(self, parts: tuple[str, ...], metrics: dict) -> None:
        if self.resumable:
            path, fs = self._path(self._entry(parts))
            stream = fs.create(path, True)
            stream.write(json.dumps(metrics).encode())
            stream.close()

    def path(self, *parts: str) -> str:
        return "/".join((self.root,) + parts)

    def folder(self, name: str) -> "Workspace":
        """A workspace in a subfolder of this one."""
        inner = Workspace.__new__(Workspace)
        inner.spark, inner.root, inner._tables = self.spark, self.path(name), self._tables
        inner.resumable, inner.many_keys = self.resumable, self.many_keys
        return inner

    @contextmanager
    def _write_settings(self):
        """The session's settings while a table is written."""
        conf = self.spark.conf
        wanted = WRITE_CONF | (MANY_KEYS_CONF if self.many_keys else {})
        before = {name: conf.get(name, None) for name in wanted}
        for name, value in wanted.items():
            conf.set(name, value)
        try:
            yield
        finally:
            for name, value in before.items():
                if value is None:
                    conf.unset(name)
                else:
                    conf.set(name, value)

    def materialize(self, df: DataFrame, *parts: str) -> DataFrame:
        """Write ``df`` as parquet at ``parts`` and return the re-read table."""
        target = self.path(*parts)
        if self._recorded(parts) is None:
            with self._write_settings():
                df.write.mode("overwrite").parquet(target, compression=CODEC)
            self._record(parts, {})
        # The schema is known: skip footer inference on the read-back.
        return self.spark.read.schema(df.schema).parquet(target)

    def materialize_observed(
        self, df: DataFrame, parts: tuple[str, ...], **metrics: Column
    ) -> tuple[DataFrame, dict]:
        """``materialize`` plus aggregate metrics computed in the same job.

        The loops use it for their frontier test (how many rows stay
        active), so no round needs a separate action to decide whether to
        continue.
        """
        target = self.path(*parts)
        known = self._recorded(parts)
        if known is not None:
            return self.spark.read.schema(df.schema).parquet(target), known
        obs = Observation(f"meshscope_{uuid.uuid4().hex[:8]}")
        observed = df.observe(obs, *[m.alias(k) for k, m in metrics.items()])
        with self._write_settings():
            observed.write.mode("overwrite").parquet(target, compression=CODEC)
        self._record(parts, obs.get)
        return self.spark.read.schema(df.schema).parquet(target), obs.get

    def materialize_by(self, df: DataFrame, column: str, *parts: str) -> str:
        """Write ``df`` as parquet with a folder for each value of ``column``; return the path."""
        target = self.path(*parts)
        if self._recorded(parts) is None:
            with self._write_settings():
                df.write.mode("overwrite").partitionBy(column).parquet(target, compression=CODEC)
            self._record(parts, {})
        return target

    def exists(self, path: str) -> bool:
        found, fs = self._path(path)
        return fs.exists(found)

    def materialize_bucketed(
        self, df: DataFrame, name: str, key: str, spread: str, _hot_rows: int | None = None
    ) -> "SaltedTable":
        """Write ``df`` bucketed on ``(key, _salt)`` for a join repeated every round.

        The bucketed scan already has the join's partitioning, so each
        round shuffles only the other side (or broadcasts it when small)
        instead of re-shuffling this table.  A bucketed scan cannot be split
        by AQE's skew handling, so hot keys are salted up front: a key
        holding more than a fair share of rows (``rows / buckets``) gets ``ceil(count / share)`` salts (at most
        ``spark.sql.shuffle.partitions``) chosen by a hash of ``spread``; all
        other keys get salt 0.  Fewer than ``buckets`` keys can exceed a fair
        share, so the hot-key table is small by construction.  There is one bucket per ``ROWS_PER_BUCKET`` rows, at most
        ``spark.sql.shuffle.partitions``; the other side of a join is
        shuffled into the same number of partitions.  The table lives in the
        run folder and is registered in the session catalog.
        """
        df = self.materialize(df, f"{name}_rows")
        counts = self.materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), f"{name}_counts")
        total = counts.agg(F.sum("_n")).first()[0] or 0
        # Buckets follow the table's size, at most one per shuffle partition.
        limit = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(1, min(limit, -(-total // ROWS_PER_BUCKET)))
        share = _hot_rows or max(1, -(-total // buckets))
        hot = self.materialize(
            counts.filter(F.col("_n") > share).select(
                F.col(key).alias("_hot"),
                F.least(F.lit(limit), F.ceil(F.col("_n") / F.lit(share))).cast("int").alias("_f"),
            ),
            f"{name}_hot",
        )
        salted = df.join(hot, df[key] == hot["_hot"], "left").select(
            *df.columns,
            F.when(F.col("_f").isNull(), F.lit(0))
            .otherwise(F.pmod(F.hash(F.col(spread)), F.col("_f")))
            .alias("_salt"),
        )
        table = "meshscope_" + re.sub(r"\W", "_", f"{self.root.rsplit('-', 1)[-1]}_{name}")
        self._tables.append(table)
        (
            salted.repartition(buckets, key, "_salt")
            .write.mode("overwrite")
            .bucketBy(buckets, key, "_salt")
            .sortBy(key, "_salt")
            .option("path", self.path(name))
            .saveAsTable(table)
        )
        return SaltedTable(self.spark.table(table), hot, key)

    def read_rounds(self, name: str, column: str, rounds: int, first: int = 0) -> DataFrame:
        """The tables ``name/column=first .. name/column=rounds``, and no others of the folder."""
        base = self.path(name)
        paths = [f"{base}/{column}={k}" for k in range(first, rounds + 1)]
        return self.spark.read.option("basePath", base).parquet(*paths)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *exc) -> None:
        self.cleanup()

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        for name in names:
            path, fs = self._path(self.path(name) if name else self.root)
            fs.delete(path, True)

    def drop_tables(self) -> None:
        """Remove the bucketed tables of this run from the catalog."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")

    def cleanup(self) -> None:
        """Delete the run folder (call once the results have been consumed)."""
        self.drop_tables()
        self.drop("")


@dataclass
class SaltedTable:
    """A bucketed table with salted hot keys, and how to join it."""

    table: DataFrame
    hot: DataFrame  # (_hot, _f): hot keys and their salt counts
    key: str

    def join(self, other: DataFrame, other_key: str) -> DataFrame:
        """Inner join with ``other`` on ``table[key] == other[other_key]``.

        ``other`` rows whose key is hot are repeated once per salt, so each
        salt slice of a hot key meets every matching row exactly once.
        """
        salts = F.sequence(F.lit(0), F.coalesce(F.col("_f"), F.lit(1)) - 1)
        spread = other.join(self.hot, other[other_key] == self.hot["_hot"], "left")
        spread = spread.select(*other.columns, F.explode(salts).alias("_osalt"))
        t = self.table
        return t.join(
            spread, (t[self.key] == spread[other_key]) & (t["_salt"] == spread["_osalt"])
        ).drop("_salt", "_osalt")
