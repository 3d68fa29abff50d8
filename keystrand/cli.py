"""Command line over record files.

    python -m keystrand gen  -s RECORDS -r MAX_PAYLOAD PATH
    python -m keystrand sort [-t T] [-o OUT] [--single FILE] PATH
    python -m keystrand runs [-m BYTES] PATH        load-sort runs against replacement selection
    python -m keystrand check PATH                  exit status 1 if out of order
    python -m keystrand diff A B                    exit status 1 if any position differs
    python -m keystrand logs FILE...                speedups from benchmark logs
    python -m keystrand merge [-k] [-m BYTES] [-o OUT] PATH   sorted runs, merged two at a time (with -k: all at once)
    python -m keystrand sweep [--threads 1,2,4] [-d ROUNDS] PATH            strong scaling: one file
    python -m keystrand sweep --weak -s RECORDS [--threads ...] [-d ROUNDS] PATH   weak scaling: a file that grows with the threads
"""

from __future__ import annotations

import argparse
import os
import subprocess
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import record_bytes
from .operators import benchlog, merging, runs, sorting, verify
from .settings import Settings
from .sources.generate import generate_records
from .sources.recordfile import export_single, register, remove, size_of


def session(threads: int, scratch: str) -> SparkSession:
    """A session as submitted, or a local one."""
    builder = SparkSession.builder.appName("keystrand").config("spark.ui.showConsoleProgress", "false")
    if "spark.master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "") and not os.environ.get("SPARK_REMOTE"):
        builder = builder.master(f"local[{threads}]").config("spark.local.dir", scratch).config("spark.ui.enabled", "false")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    register(spark)
    return spark


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("recordfile").load(path)


def in_file_order(df: DataFrame) -> DataFrame:
    """Positions as read: part files in order, each from its start."""
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    return sorting.with_position(numbered, "_at").drop("_at")


def sort(spark: SparkSession, path: str, out: str) -> None:
    """Ties fall to the smaller payload, so that the result does not depend on how the input is split."""
    rows = load(spark, path).select("key_ord", "payload")
    sorting.total_sort(rows, "key_ord", "payload").write.format("recordfile").mode("overwrite").save(out)


def run_counts(df: DataFrame, memory: int) -> DataFrame:
    """How many runs each strategy makes from the rows in file order."""
    rows = in_file_order(df).select(F.lit("in").alias("file"), "position", "key_ord", record_bytes(F.col("payload")).alias("bytes"))
    plain = runs.budget_runs(rows, int(memory * runs.RUN_SHARE), "bytes", "file", "position").select(F.lit("load_sort").alias("strategy"), "run_id")
    heap = runs.replacement_runs(rows, memory, "key_ord", "bytes", "position").select(F.lit("replacement_selection").alias("strategy"), "run_id")
    return plain.unionByName(heap).groupBy("strategy").agg(F.countDistinct("run_id").alias("runs"), F.count("*").alias("records"))


def merge(spark: SparkSession, path: str, out: str, memory: int, kway: bool) -> int:
    """Cut sorted runs within the budget and merge them, two at a time or all at once; returns the number of runs."""
    rows = in_file_order(load(spark, path)).withColumn("bytes", record_bytes(F.col("payload"))).withColumn("file", F.lit("in"))
    cut = runs.sorted_runs(rows, int(memory * runs.RUN_SHARE), "key_ord", "bytes", "file", "position").drop("position")
    count = (cut.agg(F.max("run_id")).first()[0] or 0) + 1
    if kway:
        merged = merging.kway_merge(cut, "key_ord", "run_id", "run_position")
    else:
        tree = merging.merge_tree(cut, count, "key_ord", "run_position")
        merged = tree.where(F.col("level") == max(0, count - 1).bit_length())
    merged.orderBy("position").select("key_ord", "payload").write.format("recordfile").mode("overwrite").save(out)
    return count


def sweep(settings: Settings, path: str, out: str, counts: list[int], rounds: int, weak: bool) -> None:
    """Sort with each number of threads, several times; the log is as ``logs`` reads it. A session cannot change its number of threads, so each run has a process of its own."""
    run = lambda *args: subprocess.run([sys.executable, "-m", "keystrand", *args], check=True, capture_output=True, text=True).stdout
    for n in counts:
        source = path
        if weak:
            source = f"{path}.{n}"
            run("gen", "-s", str(settings.records * n), "-r", str(settings.max_payload), source)
        header = f"(nnodes={n}, filesize={size_of(source)}, nthreads={n}, max_mem={settings.memory})" if weak else f"(nthreads={n}, max_mem={settings.memory})"
        print(header, flush=True)
        for _ in range(rounds):
            timed = run("sort", "-t", str(n), "-m", str(settings.memory), "-p", settings.scratch, "-o", out, source)
            print("\n".join(x for x in timed.splitlines() if x.startswith("# elapsed")), flush=True)
            remove(out)
        if weak:
            remove(source)


def main(argv: list[str] | None = None) -> int:
    base = Settings()
    parser = argparse.ArgumentParser(prog="keystrand", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["gen", "sort", "runs", "merge", "check", "diff", "logs", "sweep"])
    parser.add_argument("paths", nargs="+")
    parser.add_argument("-t", type=int, default=base.threads, dest="threads")
    parser.add_argument("-m", type=int, default=base.memory, dest="memory")
    parser.add_argument("-r", type=int, default=base.max_payload, dest="max_payload")
    parser.add_argument("-s", type=int, default=base.records, dest="records")
    parser.add_argument("-k", action="store_true", default=base.kway, dest="kway")
    parser.add_argument("-d", type=int, default=3, dest="rounds")
    parser.add_argument("--weak", action="store_true")
    parser.add_argument("-p", default=base.scratch, dest="scratch")
    parser.add_argument("-o", dest="out")
    parser.add_argument("--seed", type=int, default=42)
    parser.add_argument("--single")
    parser.add_argument("--threads", dest="counts", default="1,2,4,8")
    a = parser.parse_args(argv)
    settings = Settings(a.threads, a.max_payload, a.records, a.memory, a.kway, a.scratch)
    path = a.paths[0]
    out = a.out or f"{path}.sorted"
    if a.command == "sweep":
        sweep(settings, path, out, [int(n) for n in a.counts.split(",")], a.rounds, a.weak)
        return 0
    spark = session(settings.threads, settings.scratch)
    if a.command == "gen":
        generate_records(spark, settings.records, settings.max_payload, a.seed).select("key_ord", "payload").write.format("recordfile").mode("overwrite").save(path)
    elif a.command == "sort":
        began = time.perf_counter()
        sort(spark, path, out)
        print(f"(nthreads={settings.threads}, max_mem={settings.memory})\n# elapsed time (keystrand): {time.perf_counter() - began:.3f}s")
        if a.single:
            export_single(out, a.single, move=False)
    elif a.command == "runs":
        run_counts(load(spark, path), settings.memory).show(truncate=False)
    elif a.command == "merge":
        began = time.perf_counter()
        count = merge(spark, path, out, settings.memory, settings.kway)
        print(f"(sequential {'kway' if settings.kway else 'binary'} merge, max_mem={settings.memory})\n# elapsed time (keystrand_{count}_runs): {time.perf_counter() - began:.3f}s")
    elif a.command == "check":
        row = verify.is_sorted(in_file_order(load(spark, path)), "key_ord", "position").first()
        print(f"violations: {row.violations}")
        return int(not row.sorted)
    elif a.command == "diff":
        left, right = (in_file_order(load(spark, p)) for p in a.paths[:2])
        found = verify.positional_diff(left, right, ["key_ord", "len", "payload"])
        found.orderBy("position").show(20)
        return int(found.limit(1).count())
    else:
        rows = benchlog.parse(benchlog.read_logs(spark, *a.paths) if len(a.paths) > 1 or not path.endswith(".log") else benchlog.read_variants(spark, path))
        mean = benchlog.means(rows.where("nthreads IS NOT NULL"), "variant", "series", F.coalesce("nnodes", "nthreads").alias("workers"))
        benchlog.speedup(mean, benchlog.baseline(rows)).orderBy("variant", "series", "workers").show(500, truncate=False)
    return 0
