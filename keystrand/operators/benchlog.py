"""Analytics over logs of timed sort runs.

A log has sections: a header in parentheses with its dimensions, then lines
``# elapsed time (ALGO): SECONDSs``. The tables that come out have a row for
each timing, and means, speedups and efficiencies by algorithm and workers.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The format of the logs.
SECTION = r"(?s)\(([^()\n]*(?:max_mem|filesize|nthreads|nnodes)=[^()\n]*)\)\n((?:# elapsed time[^\n]*\n?)*)"
TIMING = r"# elapsed time \(([^)]*)\): ([0-9.eE+-]+)s"
VARIANTS = {"base": "", "strong": "_mpi_strong", "weak": "_mpi_weak"}
BINARY, KWAY = "binary", "kway"
BLOCKING = "(_no_mapping)?_blocking$"  # blocking runs, pinned or not, are one series


def read_logs(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole log files as (file, text)."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def read_variants(spark: SparkSession, base: str) -> DataFrame:
    """The logs of one run, ``base`` with or without .log: the base file and its scaling variants. A missing one is warned of and left out."""
    stem, found = base.removesuffix(".log"), []
    for suffix in VARIANTS.values():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stem}{suffix}.log")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found.append(f"{stem}{suffix}.log")
        else:
            warnings.warn(f"no log {stem}{suffix}.log", stacklevel=2)
    return read_logs(spark, *found) if found else spark.createDataFrame([], "file string, text string")


def parse(logs: DataFrame) -> DataFrame:
    """(file, text) to one row per timing: file, variant, section, header, algo, series, nthreads, nnodes, filesize, max_mem, seconds.

    A dimension that a header lacks is null. Blocking runs are a series of
    their own, whether pinned or not; sequential runs are told apart by their header.
    """
    sections = logs.select("file", F.posexplode(F.regexp_extract_all("text", F.lit(SECTION), F.lit(0))).alias("section", "body"))
    header = F.regexp_extract("body", r"^\(([^()\n]*)\)", 1)
    rows = sections.withColumn("header", header).withColumn("line", F.explode(F.regexp_extract_all("body", F.lit(TIMING), F.lit(0))))

    def dim(name: str):
        found = F.regexp_extract("header", rf"\b{name}=(\d+)", 1)
        return F.when(found != "", found).cast("long").alias(name)

    algo = F.regexp_extract("line", TIMING, 1)
    series = F.when(F.col("header").contains("binary"), BINARY).when(F.col("header").contains("kway"), KWAY).otherwise(F.regexp_replace(algo, BLOCKING, "_blocking"))
    variant = F.when(F.col("file").contains(VARIANTS["weak"]), "weak").when(F.col("file").contains(VARIANTS["strong"]), "strong").otherwise("base")
    return rows.select("file", variant.alias("variant"), "section", "header", algo.alias("algo"), series.alias("series"), dim("nthreads"), dim("nnodes"), dim("filesize"), dim("max_mem"), F.regexp_extract("line", TIMING, 2).cast("double").alias("seconds"))


def means(timings: DataFrame, *dims: str, seconds: str = "seconds", name: str = "mean_s") -> DataFrame:
    return timings.groupBy(*dims).agg(F.avg(seconds).alias(name))


def worker_counts(timings: DataFrame, workers: str) -> DataFrame:
    """The distinct worker counts of all series, in order."""
    return timings.select(workers).where(F.col(workers).isNotNull()).distinct().orderBy(workers)


def baseline(timings: DataFrame) -> DataFrame:
    """One row: the better mean of the sequential series."""
    return means(timings.where(F.col("series").isin(BINARY, KWAY)), "series").agg(F.min("mean_s").alias("base_s"))


def speedup(mean: DataFrame, base: DataFrame, workers: str = "workers") -> DataFrame:
    """Adds speedup (base / mean) and efficiency (speedup / workers); ``base`` has one row."""
    return mean.join(F.broadcast(base.limit(1)), how="cross").withColumn("speedup", F.col("base_s") / F.col("mean_s")).withColumn("efficiency", F.col("speedup") / F.col(workers))


def weak_scaling(mean: DataFrame, series: str = "series", workers: str = "workers") -> DataFrame:
    """The first worker count's mean over each mean (1 is ideal): ``weak``; ``weak_per_worker`` divides it by the workers once more, as scaling reports of this kind do."""
    order = Window.partitionBy(series).orderBy(workers)
    weak = F.first("mean_s").over(order) / F.col("mean_s")
    return mean.withColumn("weak", weak).withColumn("weak_per_worker", F.col("weak") / F.col(workers))


def best(mean: DataFrame, series: str = "series", workers: str = "workers") -> DataFrame:
    """The fastest worker count of each series (ties: fewer workers)."""
    order = Window.partitionBy(series).orderBy("mean_s", workers)
    return mean.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")


def export(table: DataFrame, value: str, name: str, series: str = "series", workers: str = "workers") -> DataFrame:
    """One row of text for each series: a ``#let`` binding of (workers, value rounded to 2 places) pairs."""
    pair = F.format_string("(%s, %.2f)", F.col(workers).cast("string"), F.round(value, 2))
    pairs = F.array_sort(F.collect_list(F.struct(F.col(workers).alias("w"), pair.alias("p"))))
    listed = F.array_join(F.transform(pairs, lambda x: x["p"]), ", ")
    return table.groupBy(series).agg(listed.alias("pairs")).select(series, F.format_string(f"#let {name}_%s = (%s)", F.col(series), F.col("pairs")).alias("text"))


def export_blocks(speedups: DataFrame, name: str, series: str = "series", workers: str = "workers") -> DataFrame:
    """Two rows (block, text): ``#let NAME_speed`` and ``#let NAME_eff``, each with the worker counts and a line of values (2 places) for each series.

    There are as many values as worker counts and series, so one task writes a block.
    """
    counts = speedups.agg(F.array_sort(F.collect_set(workers)).alias("counts"))
    blocks = None
    for block, value in (("speed", "speedup"), ("eff", "efficiency")):
        pair = F.struct(F.col(workers).alias("w"), F.format_string("%.2f", F.round(value, 2)).alias("v"))
        values = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["v"]), ", ")
        lines = speedups.groupBy(series).agg(F.format_string("  %s: (%s),", F.col(series), values).alias("line"))
        lines = lines.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
        text = F.concat(F.lit(f"#let {name}_{block} = (\n  threads: ("), F.array_join(F.transform("counts", lambda c: c.cast("string")), ", "), F.lit("),\n"), "lines", F.lit("\n)"))
        one = lines.join(F.broadcast(counts)).select(F.lit(block).alias("block"), text.alias("text"))
        blocks = one if blocks is None else blocks.unionByName(one)
    return blocks
