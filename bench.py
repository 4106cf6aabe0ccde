"""Headline timings: one JSON line.

The snapshot query runs on the source tables; the views run on the snapshot
written as Parquet, as they do after a load.  Each query writes to the ``noop``
sink: one warm-up run, then the median of three.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import stocklens as sl  # noqa: E402
from stocklens.names import VIEW_ALL, VIEW_BRANCHES  # noqa: E402
from stocklens.session import scratch_path  # noqa: E402
from workload import registry as reg  # noqa: E402
from workload.fixtures import BRANCH_STORES, HOUSE_REGIONS, RULES, STATUSES, STORE_LABELS, fixture_tables  # noqa: E402

RUNS = 3


def timed(make) -> float:
    """Median seconds of planning and running a query."""
    seconds = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = sl.build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                             spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                             spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    tables = fixture_tables(spark, sf_dir)
    path = scratch_path(spark, "bench-snapshot")
    reg.rows(spark, sf_dir).write.parquet(path)
    snap = spark.read.parquet(path)
    catalog = reg.catalog(spark, sf_dir)
    moved = sl.movements(tables, STATUSES, lookups=False).select(*reg.MOVEMENT_COLUMNS)
    work = {
        "q1_stock_snapshot": lambda: sl.stock_snapshot(
            tables, RULES, statuses=STATUSES, unique_items=True),
        "q1_stock_snapshot_default": lambda: sl.stock_snapshot(tables, RULES, statuses=STATUSES),
        "n2_last_movement": lambda: sl.last_movement(moved),
        "v1_pivot_all_stores": lambda: sl.pivot_all_stores(snap, STORE_LABELS),
        "v2_pivot_branches": lambda: sl.pivot_branches(snap, BRANCH_STORES),
        "v3_pivot_main_house": lambda: sl.pivot_main_house(snap, HOUSE_REGIONS),
        "v4_pivot_main_house_share": lambda: sl.pivot_main_house_share(snap, columns=HOUSE_REGIONS),
        "v_parts_of_all_views": lambda: sl.stock_and_attributes(snap),
        "q2_stock_view": lambda: sl.stock_view(
            snap, VIEW_BRANCHES, catalog, BRANCH_STORES, exclude_brands=reg.EXCLUDED_BRANDS,
            exclude_sublines=reg.EXCLUDED_SUBLINES, exclude_year=2000, promo_only=True, flag_duplicates=True),
        "q2_stock_view_all_stores": lambda: sl.stock_view(
            snap, VIEW_ALL, catalog, STORE_LABELS, exclude_brands=reg.EXCLUDED_BRANDS,
            stock_range=(1, 100000), flag_duplicates=True),
        "q3_discount_audit": lambda: sl.discount_audit(snap, catalog, HOUSE_REGIONS),
    }
    seconds = {name: timed(make) for name, make in work.items()}
    print(json.dumps({"metric": "stock_analytics_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))
    spark.stop()


if __name__ == "__main__":
    main()
