"""Hot-key check: derive a skewed copy of the sales table in which one basket,
one product and one category hold a third of the lines, run the hot-path
operators on it, and report from Spark's event log how evenly each job's
work was spread: for every job, the largest share of a stage's records that
a single task processed (1/tasks when even, near 1 when one task does it all).

    python scripts/skew_check.py [sf_dir] > SKEW.md

The skewed table is derived by Spark from the driver's tables (no made-up
rows) and written to a fresh scratch folder under /tmp.
"""

from __future__ import annotations

import glob
import json
import os
import shutil
import sys
import tempfile
import time
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import functions as F  # noqa: E402

from tillroll.operators import basket, pricing  # noqa: E402
from tillroll.operators.ranking import rank_within  # noqa: E402
from tillroll.operators.summary import summarize  # noqa: E402
from tillroll.session import build_session  # noqa: E402
from tillroll.sources.sales import build_sales, sales  # noqa: E402
from tillroll.sources.tables import read_table, table_path  # noqa: E402


def skewed(df):
    hot = (F.col("transaction_id") % 3) == 0
    return df.withColumns({
        "transaction": F.when(hot, F.lit("hot basket")).otherwise(F.col("transaction")),
        "product_detail": F.when(hot, F.lit("hot product")).otherwise(F.col("product_detail")),
        "product_category": F.when(hot, F.lit("HOT")).otherwise(F.col("product_category")),
    })


MIN_STAGE_RECORDS = 10_000   # ignore tiny stages (final merges of a few rows)


def hot_part_tables(spark, sf_dir: str, scratch: str) -> str:
    """Copies of the driver's tables in which one part key holds a third of
    lineitem (rewritten by Spark); the other tables are copied as they are."""
    folder = f"{scratch}/hot-part"
    os.makedirs(folder)
    for name in ("region", "nation", "customer", "orders", "part"):
        shutil.copy(table_path(sf_dir, name), table_path(folder, name))
    lineitem = read_table(spark, sf_dir, "lineitem")
    hot = (F.col("l_orderkey") % 3) == 0
    (lineitem.withColumn("l_partkey", F.when(hot, F.lit(1)).otherwise(F.col("l_partkey")))
     .repartition(8).write.parquet(table_path(folder, "lineitem")))
    return folder


def task_stats(event_dir: str):
    stage_group, tasks = {}, defaultdict(list)
    for path in sorted(glob.glob(os.path.join(event_dir, "**", "*"), recursive=True)):
        if not os.path.isfile(path) or os.path.basename(path).startswith("appstatus"):
            continue
        with open(path, encoding="utf-8") as f:
            for raw in f:
                try:
                    ev = json.loads(raw)
                except ValueError:
                    continue
                if ev.get("Event") == "SparkListenerJobStart":
                    group = (ev.get("Properties") or {}).get("spark.jobGroup.id")
                    for sid in ev.get("Stage IDs", []):
                        stage_group[sid] = group
                elif ev.get("Event") == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    # shuffle stages only: that is where a hot key lands
                    recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    info = ev.get("Task Info") or {}
                    tasks[ev.get("Stage ID")].append((recs, info.get("Finish Time", 0) - info.get("Launch Time", 0)))
    out = defaultdict(lambda: {"stages": 0, "worst_share": 0.0, "worst_records": 0, "tasks": 0})
    for sid, ts in tasks.items():
        group = stage_group.get(sid)
        total = sum(r for r, _ in ts)
        if not group or total < MIN_STAGE_RECORDS or len(ts) < 2:
            continue
        share = max(r for r, _ in ts) / total
        o = out[group]
        o["stages"] += 1
        if share > o["worst_share"]:
            o.update(worst_share=share, worst_records=total, tasks=len(ts))
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    event_dir = tempfile.mkdtemp(prefix="tillroll-skew-events-")
    scratch = tempfile.mkdtemp(prefix="tillroll-skew-")
    spark = build_session(shuffle_partitions=16, app="tillroll-skew", extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir,
        "spark.eventLog.compress": "false",
        # keep all 16 shuffle partitions visible (AQE would merge small ones)
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        # AQE's skew-join thresholds scaled down to this data size (defaults:
        # 256 MB and 64 MB), so its splitting of a hot join key shows here
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1MB"})
    sc = spark.sparkContext
    sc.setJobGroup("build", "build")
    skewed(sales(spark, sf_dir)).write.parquet(f"{scratch}/sales")
    df = spark.read.parquet(f"{scratch}/sales")

    hot_dir = hot_part_tables(spark, sf_dir, scratch)

    per_line = df.groupBy("product_category", "transaction_id").agg(F.sum("revenue").alias("total_revenue"))
    order = [F.col("total_revenue").desc_nulls_first()]
    jobs = {
        "sales_build, one part with a third of lineitem": lambda: build_sales(spark, hot_dir),
        "store_summary": lambda: summarize(df, ["store_id"], {"r": "revenue", "b": "baskets", "atv": "atv"}),
        "combo_summary": lambda: basket.combo_summary(df),
        "rank_window (lines in category)": lambda: rank_within(per_line, ["product_category"], order,
                                                               method="window"),
        "rank_range (lines in category)": lambda: rank_within(per_line, ["product_category"], order,
                                                              method="range"),
        "top3_window_group_limit": lambda: rank_within(per_line, ["product_category"], order, top=3),
        "within_day_elasticity": lambda: pricing.within_day_elasticity(df, base_price="3.50",
                                                                       hike_price="4.38"),
        "price_hold_whatif": lambda: pricing.price_hold_whatif(
            df.withColumn("unit_price", F.col("tier_price")), base_price="3.50"),
    }
    # a third of the lines on one date, sold under many product names
    hot_date = df.withColumns({
        "transaction_date": F.when(F.col("transaction_id") % 3 == 0, F.lit("1995-06-01").cast("date"))
        .otherwise(F.col("transaction_date")),
        "product_detail": F.concat("product_detail", (F.col("transaction_id") % 50).cast("string"))})
    jobs["daily_price_units, one date with a third"] = lambda: pricing.daily_price_units(hot_date)
    seconds = {}
    for name, build in jobs.items():
        sc.setJobGroup(name, name)
        t0 = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = time.perf_counter() - t0
    rows = df.count()
    spark.stop()

    stats = task_stats(event_dir)
    print(f"# Hot-key check ({sf_dir}, {rows:,} lines, one third in one basket, product and category)\n")
    print("Largest share of a stage's records read by one task, per job (16 shuffle partitions, AQE")
    print("partition coalescing off and its skew-join thresholds scaled down to 1 MB so the spread is")
    print("visible at this size; an even spread over 16 tasks is about")
    print("0.06). Records = shuffle records read (the stages where a hot key lands); only stages")
    print(f"reading at least {MIN_STAGE_RECORDS:,} shuffle records count.\n")
    print("| job | seconds | shuffle stages | worst stage: largest task share | records in that stage | tasks |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name in jobs:
        s = stats.get(name, {"stages": 0, "worst_share": 0, "worst_records": 0, "tasks": 0})
        print(f"| {name} | {seconds[name]:.2f} | {s['stages']} | {s['worst_share']:.2f} | "
              f"{s['worst_records']:,} | {s['tasks']} |")


if __name__ == "__main__":
    main()
