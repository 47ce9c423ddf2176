"""SparkSession construction for tests, benchmarks and local runs.

Library functions never build a session themselves; they take DataFrames
and use ``df.sparkSession``.  This helper only collects the settings the
library relies on (AQE with skew-join splitting, ANSI mode, no UI).
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Settings the operators are designed around.  AQE re-plans joins from
# runtime sizes (broadcast only under the byte threshold) and splits
# skewed shuffle partitions, which is how hub owners are handled.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.parquet.compression.codec": "zstd",
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "meshscope",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = os.environ.get("MESHSCOPE_DRIVER_MEMORY", "16g")
    if extra_conf:
        conf.update(extra_conf)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
