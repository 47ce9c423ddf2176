"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected) and timed from DataFrame construction on,
so driver-side loop work (iterative operators write their rounds while the
DataFrame is built) is included.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from meshscope.plans import registry  # noqa: E402
from meshscope.session import build_session  # noqa: E402

HEADLINE = [
    "clean_edges",
    "composition_totals",
    "opacity_index",
    "opacity_edges",
    "ultimate_owners",
    "owner_pool",
    "co_owner_pairs",
    "family_index",
    "family_closure",
    "describe_scores",
    "score_histogram",
]


def run(spark, name: str, sf_dir: str) -> float:
    t = time.perf_counter()
    df = registry.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    # JVM / code-path warm-up on the smallest tables; not timed.
    run(spark, "opacity_index", "/root/testdata/sf0.001")
    timings = {name: round(run(spark, name, sf_dir), 3) for name in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
