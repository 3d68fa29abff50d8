"""What the operators of this subpackage share: the shared folder, and small checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of bytes outside this class (ASCII white space).
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]+"

#: With this setting Spark deletes a query's shuffle files when the query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Only a local master may leave that setting out (as tests do); then a
    temporary folder serves, since driver and executors are one process.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="keystrand-")
    folder = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _folders.append((spark, folder))
    return folder


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a written table that no later read needs."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that were written for this session; results that read them must be saved before."""
    for owner, folder in list(_folders):
        if owner is spark:
            remove_folder(spark, folder)
            _folders.remove((owner, folder))


@atexit.register
def _clear_all() -> None:
    for spark in {id(x): x for x, _ in _folders}.values():
        try:
            clear(spark)
        except Exception:  # the session may have ended before; the folder's owner clears it then
            return


def written(df: DataFrame, folder: str | None = None, block_mb: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into a shared folder and read it again.

    A lost executor costs only the tasks it ran: all that later jobs read is in
    the shared folder. The shuffle files of the plan go at once. ``block_mb`` makes row groups small, for wide rows; ``by``
    makes a folder for each value of these columns.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if block_mb:
        writer = writer.option("parquet.block.size", block_mb << 20)
    if by:
        writer = writer.partitionBy(*by)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(df.schema).parquet(folder)


def frequent(total: int) -> int:
    """A key with more than so many of ``total`` rows is dealt out among tasks."""
    return max(1000, total // 1000)


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], times: str, total: int, *spread: str) -> DataFrame:
    """Left join with a table that is unique by ``keys``, without a task that gets all rows of a frequent key.

    ``times`` is the table's column that tells how many of the ``total`` rows
    have its key. Keys with over a thousandth of them, a thousand keys at most,
    are broadcast, and their rows are dealt out by ``spread`` instead.
    """
    heavy = F.col(times) > frequent(total)
    values = [c for c in table.columns if c not in keys and c != times]
    hot = table.where(heavy).select(*keys, *[F.col(c).alias(f"hot_{c}") for c in values], F.lit(True).alias("hot_key"))
    rows = rows.join(F.broadcast(hot), keys, "left")
    rows = rows.withColumn("hot_salt", F.when(F.col("hot_key"), F.xxhash64(*spread).bitwiseOR(F.lit(1))).otherwise(F.lit(0)).cast("long"))
    # zero, but no literal: else the planner drops it from the keys that rows are dealt out by
    rest = table.where(~heavy).drop(times).withColumn("hot_salt", F.pmod(F.xxhash64(*keys), F.lit(1).cast("long")))
    rows = rows.join(rest, [*keys, "hot_salt"], "left")
    return rows.withColumns({c: F.coalesce(f"hot_{c}", c) for c in values}).drop("hot_key", "hot_salt", *[f"hot_{c}" for c in values])


def fresh(df: DataFrame, name: str) -> str:
    """``name`` with underscores in front until ``df`` has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def utf8_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")


def word_count(text: str = "text") -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``; null ids fold as the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
