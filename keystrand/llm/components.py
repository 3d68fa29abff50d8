"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import frequent, looked_up, remove_folder, shared_folder, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _stars(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star; edges (a, b) with a > b. Each node's edges meet in one task: two shuffles, and nothing is broadcast."""
    node = Window.partitionBy("a")
    large = _both(edges).withColumn("m", F.least("a", F.min("b").over(node))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    small = large.repartition("a").distinct().withColumn("m", F.min("b").over(node))
    return small.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def _dealt_stars(edges: DataFrame, number: int) -> DataFrame:
    """The same; a node with very many edges is joined apart from the others."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), F.count("*").alias("times"))
    large = looked_up(both.where("b > a"), least, ["a"], "times", 2 * number, "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("times"))
    small = looked_up(large, least, ["a"], "times", 2 * number, "b")
    return small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (a, b) as longs. Returns (node, root) for each node of an edge, root being its component's smallest node.

    Each round is written to the shared folder; the rounds grow with the
    logarithm of a component's diameter, and edges that are stars already take
    none. Only three numbers a round come to the driver.
    """
    spark = edges.sparkSession
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    folder = None
    while True:
        new_folder = shared_folder(spark)
        new = written(edges, new_folder)
        if folder:
            remove_folder(spark, folder)
        # stars: a node has one edge to a smaller one, or has edges to larger ones only
        ends = new.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("end")).select("end.*")
        nodes = ends.groupBy("node").agg(F.count("*").alias("times"), F.sum("up").alias("up"))
        number, most, open_nodes = nodes.agg(F.sum("up"), F.max("times"), F.count_if(F.expr("up > 0 AND times > 1"))).first()
        if not open_nodes:
            break
        edges = _dealt_stars(new, number) if most > frequent(2 * number) else _stars(new)
        folder = new_folder
    roots = new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
