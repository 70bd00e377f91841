"""Per report: number of shuffles (Exchange), broadcasts, scans, Python
nodes and the filters pushed into the parquet scan, from the physical plan
(``explain("formatted")``). Writes a markdown table to stdout.

    python scripts/plan_audit.py [sf_dir] [bench.json] > PLANS.md

With a bench.py output (run with BENCH_EVENTLOG) the table also shows each
report's median seconds and shuffle bytes per run.
"""

from __future__ import annotations

import contextlib
import io
import json
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillroll.plans import REPORTS  # noqa: E402
from tillroll.session import build_session  # noqa: E402


def formatted_plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    bench = json.load(open(sys.argv[2])) if len(sys.argv) > 2 else {}
    seconds, shuffled = bench.get("queries", {}), bench.get("shuffle_bytes", {})
    spark = build_session(shuffle_partitions=16)
    print(f"# Physical plans of the registered reports ({sf_dir}, AQE initial plans)\n")
    print("Shuffles count every Exchange except broadcasts (final ORDER BY range exchanges and")
    print("single-partition exchanges of global aggregates included). Reports with a range-sliced")
    print("rank checkpoint their slices while the plan is built; the plan shown starts at the")
    print("checkpoint (`Scan ExistingRDD`).")
    if bench:
        print(f"Seconds and shuffle bytes: bench.py at sf{bench.get('sf')}, local[{bench.get('cpus')}],"
              f" median of {bench.get('runs')} runs; sales_build {seconds.get('sales_build', 0):.2f} s,"
              f" {shuffled.get('sales_build', 0):,} bytes shuffled.")
    print()
    print("| report | shuffles | broadcasts | scans | Python | filters pushed to parquet | median s | shuffle bytes |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, build in REPORTS.items():
        text = formatted_plan(build(spark, sf_dir))
        tree = text.split("\n\n")[0]
        bx = len(re.findall(r"BroadcastExchange \(", tree))
        ex = len(re.findall(r"Exchange \(", tree)) - bx
        scans = len(re.findall(r"Scan (?:parquet|ExistingRDD)", tree))
        py = "yes" if re.search(r"EvalPython|ArrowEval|MapInPandas|InPandas", tree) else "no"
        pushed = [p for p in re.findall(r"PushedFilters: \[(.*)\]", text)
                  if p and not all(x.startswith("IsNotNull") for x in p.split(", "))]
        sec = f"{seconds[name]:.3f}" if name in seconds else ""
        sb = f"{shuffled[name]:,}" if name in shuffled else ""
        print(f"| {name} | {ex} | {bx} | {scans} | {py} | {'; '.join(pushed) if pushed else ''} | {sec} | {sb} |")
    spark.stop()


if __name__ == "__main__":
    main()
