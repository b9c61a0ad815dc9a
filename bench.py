"""Timings of the shared tables and of every analysis; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
threads. The JVM is warmed on a smaller folder first, then each group of results is timed:
``setup`` builds all shared tables, ``t01`` .. ``t24`` and ``c01`` .. ``c03`` run all
results of an analysis, the rest are named as they are."""

import json
import os
import re
import sys
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tollbook import registered  # noqa: E402
from tollbook.plans import RESULTS  # noqa: E402
from tollbook.registered_text import TEXT_QUERIES  # noqa: E402


def groups() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in sorted(RESULTS):
        out.setdefault(name[:3] if re.match(r"[tc]\d\d_", name) else "studies", []).append(name)
    out["studies"] += ["unread_by_next_label", "cost_by_label", "pushback_cost", "bill_summary"]
    for name in TEXT_QUERIES:
        kind = name.split("_")[0]
        out.setdefault({"ingest": "ingest", "probe": "probes", "reconcile": "reconcile"}.get(kind, "labels_and_verdicts"), []).append(name)
    return out


def run(spark, folder, threads, timings=None):
    queries = registered.queries()
    start = time.time()
    registered.workspace(spark, folder).prepare()
    if timings is not None:
        timings["setup"] = time.time() - start
    for group, names in groups().items():
        start = time.time()
        with ThreadPoolExecutor(threads) as pool:
            list(pool.map(lambda n: queries[n](spark, folder).write.format("noop").mode("overwrite").save(), names))
        if timings is not None:
            timings[group] = time.time() - start


def main():
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("tollbook-bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.scheduler.mode", "FAIR").config("spark.sql.codegen.cache.maxEntries", "20000").config("spark.locality.wait", "0").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    warm = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    if os.path.isdir(warm) and os.path.realpath(warm) != os.path.realpath(folder):
        run(spark, warm, cpus)
    timings: dict[str, float] = {}
    run(spark, folder, cpus, timings)
    print(json.dumps({
        "metric": "all_analyses_total", "value": round(sum(timings.values()), 2), "unit": "sec",
        "queries": {k: round(v, 2) for k, v in timings.items()}, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
