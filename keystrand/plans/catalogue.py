"""Queries over the test tables, one for each operator, with equivalent SQL.

Orders stand for record files (id, key, size, position), events for logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import HEADER_BYTES, TOP_BIT, formatted, key_of, ord_of_bits, record_bytes
from ..operators import benchlog, merging, partitioning, runs, sorting, verify
from ..sources.generate import generate_records
from ..shipping import shared_folder
from ..sources.recordfile import located, export_single, register, size_of, walk

CHUNK = 30_000
RUN_ROWS = 1_000
WORKERS = 7
HEAP_BYTES = 8 << 10


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records: id, k, sz."""
    size = F.octet_length("o_orderpriority").cast("long") + HEADER_BYTES
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), size.alias("sz"))


def _file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the position in their file."""
    return sorting.with_position(_records(spark, sf_dir), "id", name="rn").withColumn("rn", F.col("rn").cast("long"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.fixed_runs(_file(spark, sf_dir), RUN_ROWS, "rn")


def _timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("series"), (F.pmod("user_id", F.lit(8)) + 1).alias("workers"), F.col("value").alias("seconds"))


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.means(_timings(spark, sf_dir), "series", "workers")


def total_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sorting.with_position(_records(spark, sf_dir).select("id", "k"), "k", "id")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sorting.top_k(orders, 100, F.col("o_totalprice").desc(), "o_orderkey")


def tie_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return sorting.tie_rank(lines, "l_orderkey")


def unsigned_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned keys: every other order's key has its top bit set, and still sorts as a number."""
    bits = F.when(F.col("id") % 2 == 0, F.col("id").bitwiseXOR(F.lit(TOP_BIT))).otherwise(F.col("id"))
    rows = _records(spark, sf_dir).select("id", ord_of_bits(bits).alias("key_ord"))
    return sorting.with_position(rows, "key_ord").select("id", key_of(F.col("key_ord")).cast("string").alias("key"), "position")


def record_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.col("o_orderpriority").cast("binary")
    orders = _read(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("id"), formatted(ord_of_bits(F.col("o_custkey")), payload).alias("line"), record_bytes(payload).alias("bytes"))


def fixed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_stats(_runs(spark, sf_dir), "k", "sz")


def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _file(spark, sf_dir).withColumn("file", F.lit("orders"))
    cut = runs.greedy_chunks(rows, CHUNK, "sz", "file", "rn")
    return cut.groupBy("chunk_id").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), F.sum("sz").cast("long").alias("bytes"))


def budget_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _file(spark, sf_dir).withColumn("file", F.lit("orders"))
    cut = runs.budget_runs(rows, CHUNK, "sz", "file", "rn")
    return cut.groupBy("run_id").agg(F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"), F.sum("sz").cast("long").alias("bytes"))


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = partitioning.round_robin(_file(spark, sf_dir), WORKERS, "rn")
    return dealt.groupBy("worker").agg(F.count("*").alias("n"), F.sum("sz").cast("long").alias("bytes"), F.sum("k").cast("long").alias("key_sum"))


def pair_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _read(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("k"), F.col("s_suppkey").alias("id"))
    right = _read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_custkey").alias("id"))
    return merging.pair_merge(left, right, "k", "id").withColumn("src", F.col("src").cast("long"))


def kway_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.kway_merge(_runs(spark, sf_dir).select("id", "k", "run_id"), "k", "run_id", "id")


def merge_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = -(-_read(spark, sf_dir, "orders").count() // RUN_ROWS)
    return merging.merge_levels(spark, count)


def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = 300
    rows = runs.fixed_runs(_file(spark, sf_dir), per, "rn")
    count = -(-_read(spark, sf_dir, "orders").count() // per)
    grouped = merging.merge_groups(rows, count, 8)
    return grouped.groupBy("group_id", "run_id").agg(F.count("*").alias("n"), F.min("k").alias("kmin"))


def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", "value")
    return verify.violations(events, "value", "event_id")


def is_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("event_id", "ts")
    return verify.is_sorted(events, "ts", "event_id")


def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File order against key order."""
    left = _file(spark, sf_dir).select(F.col("rn").alias("position"), "k", "sz")
    right = sorting.with_position(_records(spark, sf_dir), "k", "id").select(F.col("position").cast("long").alias("position"), "k", "sz")
    return verify.positional_diff(left, right, ["k", "sz"])


def multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against customers, as (key, size): whole tables."""
    customers = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.octet_length("c_mktsegment").cast("long") + HEADER_BYTES).alias("sz"))
    return verify.multiset_diff(_records(spark, sf_dir).select("k", "sz"), customers)


def same_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge keeps the multiset of its runs: equal fingerprints."""
    rows = _runs(spark, sf_dir).select("id", "k", "run_id")
    merged = merging.kway_merge(rows, "k", "run_id", "id").select("id", "k", "run_id")
    a, b = verify.fingerprint(rows), verify.fingerprint(merged)
    return a.join(F.broadcast(b.withColumnsRenamed({"n": "m", "hash_sum": "other"}))).select("n", ((F.col("n") == F.col("m")) & (F.col("hash_sum") == F.col("other"))).alias("same"))


def speedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = _means(spark, sf_dir)
    base = mean.where("workers = 1").agg(F.min("mean_s").alias("base_s"))
    found = benchlog.speedup(mean, base)
    return found.select("series", "workers", *[F.round(c, 4).alias(c) for c in ("mean_s", "speedup", "efficiency")])


def weak_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchlog.weak_scaling(_means(spark, sf_dir))
    return found.select("series", "workers", F.round("weak", 4).alias("weak"), F.round("weak_per_worker", 4).alias("weak_per_worker"))


def best_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.best(_means(spark, sf_dir)).select("series", "workers", F.round("mean_s", 4).alias("mean_s"))


def worker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchlog.worker_counts(_timings(spark, sf_dir), "workers")


def log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _timings(spark, sf_dir).groupBy("series", "workers").agg(F.count("*").cast("double").alias("n"))
    return benchlog.export(counts, "n", "runs")


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs written from events and parsed again: one file for each event type, one section for each worker count."""
    rows = _timings(spark, sf_dir).groupBy("series", "workers").agg(F.count("*").alias("n"), F.min(F.round("seconds", 2)).alias("low"), F.max(F.round("seconds", 2)).alias("high"))
    line = lambda c: F.format_string("# elapsed time (sort_%s): %ss\n", F.col("series"), F.col(c).cast("string"))
    section = F.concat(F.format_string("(nthreads=%s, max_mem=%s)\n", F.col("workers").cast("string"), F.col("n").cast("string")), line("low"), line("high"))
    logs = rows.select("series", F.struct("workers", section.alias("text")).alias("s")).groupBy("series").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["text"]), "").alias("text"))
    found = benchlog.parse(logs.select(F.concat("series", F.lit(".log")).alias("file"), "text"))
    return found.groupBy("file", "algo", "nthreads", "max_mem").agg(F.min("seconds").alias("low"), F.max("seconds").alias("high"), F.count("*").alias("timings"))


def mem_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _records(spark, sf_dir).agg(F.sum("sz").alias("bytes"))
    budget = partitioning.memory_budget(F.col("bytes"))
    return total.select(F.col("bytes").cast("long").alias("bytes"), budget.alias("budget"), partitioning.memory_cap(F.lit(8 * partitioning.GIB), F.col("bytes")).alias("cap"), partitioning.chunk_bytes(F.col("bytes"), budget, 8).alias("chunk"))


def generator_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "orders").count()
    rows = generate_records(spark, n)
    return rows.agg(F.count("*").alias("n"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.sum((F.octet_length("payload") != F.col("len")).cast("long")).alias("wrong"))


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Orders as a record file in key order."""
    register(spark)
    orders = _read(spark, sf_dir, "orders")
    rows = orders.select(ord_of_bits(F.col("o_orderkey")).alias("key_ord"), F.col("o_orderpriority").cast("binary").alias("payload"))
    path = shared_folder(spark)
    rows.orderBy("key_ord").write.format("recordfile").mode("append").save(path)
    return path


def _back(df: DataFrame) -> DataFrame:
    return df.select(key_of(F.col("key_ord")).cast("long").alias("key"), "len", F.col("payload").cast("string").alias("payload"))


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as a record file in key order, and read again."""
    return _back(spark.read.format("recordfile").option("splitBytes", 1 << 20).load(_written(spark, sf_dir)))


def single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts gathered to one file, which has no index, and read again."""
    path = _written(spark, sf_dir)
    export_single(path, f"{path}.dat")
    return _back(spark.read.format("recordfile").option("splitBytes", 1 << 14).load(f"{path}.dat"))


def byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole records within 30,000 bytes from the hundred-and-first record on."""
    path = _written(spark, sf_dir)
    export_single(path, f"{path}.dat")
    offset = _records(spark, sf_dir).orderBy("id").limit(100).agg(F.sum("sz")).first()[0] or 0
    return _back(spark.read.format("recordfile").options(offset=offset, maxBytes=CHUNK).load(f"{path}.dat"))


def truncated_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that ends three bytes early, without its last record."""
    path = _written(spark, sf_dir)
    export_single(path, f"{path}.dat", most=size_of(path) - 3)
    return _back(spark.read.format("recordfile").option("truncatedTail", "drop").load(f"{path}.dat"))


def file_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a folder, of its gathered file, and of the file that a folder with one part is renamed to."""
    path = _written(spark, sf_dir)
    gathered = export_single(path, f"{path}.dat")
    spark.read.format("recordfile").load(path).select("key_ord", "payload").coalesce(1).write.format("recordfile").mode("overwrite").save(f"{path}-one")  # a rename needs one part
    renamed = export_single(f"{path}-one", f"{path}-one.dat", move=True)
    return spark.createDataFrame([(size_of(path), gathered, renamed, size_of(f"{path}-one"))], "folder long, gathered long, renamed long, gone long")


def boundary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record-aligned split points of a file without an index."""
    path = _written(spark, sf_dir)
    export_single(path, f"{path}.dat")
    system, file = located(f"{path}.dat")
    return spark.createDataFrame(list(enumerate(walk(system, file, CHUNK, "raise"))), "cut long, byte long")


def sorted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs within a budget, each in key order."""
    rows = _file(spark, sf_dir).withColumn("file", F.lit("orders"))
    return runs.sorted_runs(rows, CHUNK, "k", "sz", "file", "rn").select("id", "k", "run_id", "run_position")


def merge_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of a binary merge, row by row."""
    rows = _runs(spark, sf_dir).select("id", "k", "run_id")
    count = -(-_read(spark, sf_dir, "orders").count() // RUN_ROWS)
    return merging.merge_tree(rows, count, "k", "id").select("level", "merged_run", "position", "id", "k")


def grouped_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-level merge by eight workers, row by row."""
    rows = runs.fixed_runs(_file(spark, sf_dir), 300, "rn").select("id", "k", "run_id")
    count = -(-_read(spark, sf_dir, "orders").count() // 300)
    return merging.grouped_merge(rows, count, 8, "k", "id").select("id", "k", "group_id", "group_position", "position")


def descending_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a heap of the largest gives up: the order from the top."""
    return sorting.with_position(_records(spark, sf_dir).select("id", "k"), F.col("k").desc(), F.col("id").desc())


def deal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks dealt out in turn to all workers but the one that deals."""
    rows = runs.fixed_runs(_file(spark, sf_dir), RUN_ROWS, "rn", name="chunk_id")
    return partitioning.deal_chunks(rows, WORKERS).groupBy("worker", "chunk_id").agg(F.count("*").alias("n"))


def log_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pinned, unpinned and blocking runs by series: either kind of blocking is one series."""
    rows = _read(spark, sf_dir, "events").select(F.col("event_type").alias("algo"), F.pmod("user_id", F.lit(4)).alias("way"), (F.pmod("user_id", F.lit(8)) + 1).alias("workers"), F.round("value", 2).alias("seconds"))
    name = F.concat(F.lit("sort_"), F.col("algo"), F.element_at(F.array(*[F.lit(x) for x in ("", "_no_mapping", "_blocking", "_no_mapping_blocking")]), (F.col("way") + 1).cast("int")))
    rows = rows.groupBy(F.col("algo").alias("kind"), name.alias("algo"), "workers").agg(F.max("seconds").alias("seconds"))
    text = F.format_string("(nthreads=%s, max_mem=1)\n# elapsed time (%s): %ss\n", F.col("workers").cast("string"), F.col("algo"), F.col("seconds").cast("string"))
    logs = rows.select("kind", text.alias("text")).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("text")), "").alias("text"))
    found = benchlog.parse(logs.select(F.concat("kind", F.lit("_mpi_weak.log")).alias("file"), "text"))
    return found.groupBy("variant", "series").agg(F.count("*").alias("timings"), F.max("seconds").alias("high"))


def log_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speedups and efficiencies, by event counts, as two blocks of text."""
    counts = _timings(spark, sf_dir).groupBy("series", "workers").agg(F.count("*").cast("double").alias("speedup"))
    return benchlog.export_blocks(counts.withColumn("efficiency", F.col("speedup") / F.col("workers")), "events")


def replacement_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by replacement selection within 8 KB: all in order, and fewer than sorted chunks of that size would be."""
    return runs.replacement_runs(_file(spark, sf_dir), HEAP_BYTES, "k", "sz", "rn")


def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load-sort runs against replacement selection, both within 8 KB."""
    rows = _file(spark, sf_dir).withColumn("file", F.lit("orders"))
    plain = runs.budget_runs(rows, int(HEAP_BYTES * runs.RUN_SHARE), "sz", "file", "rn").agg(F.countDistinct("run_id").alias("load_sort"))
    heap = runs.replacement_runs(rows, HEAP_BYTES, "k", "sz", "rn").agg(F.countDistinct("run_id").alias("replacement"))
    return plain.join(F.broadcast(heap)).select("load_sort", "replacement", (F.col("replacement") < F.col("load_sort")).alias("fewer"))


QUERIES = {f.__name__: f for f in (
    total_sort, top_k, tie_rank, unsigned_order, record_format, fixed_runs, greedy_chunks, budget_runs, round_robin, pair_merge, kway_merge, merge_levels, merge_groups,
    violations, is_sorted, positional_diff, multiset_diff, same_multiset, speedup, weak_scaling, best_config, worker_counts, log_export, log_parse, mem_budget, generator_stats, roundtrip, replacement_runs, run_comparison,
    single_file, byte_range, truncated_tail, file_size, boundary_scan, sorted_runs, merge_tree, grouped_merge, descending_drain, deal_chunks, log_routing, log_blocks,
)}

_R = "r AS (SELECT o_orderkey AS id, o_custkey AS k, 12 + strlen(o_orderpriority) AS sz, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)"
_ROOM = int(HEAP_BYTES * runs.HEAP_SHARE)
# replacement selection: each step gives up a batch of the heap (gone) and takes in the next records (came) while they fit
_H = f"""{_R},
        a AS (SELECT list({{'run': 0::BIGINT, 'k': k::BIGINT, 'rn': rn::BIGINT, 'id': id::BIGINT, 'sz': sz::BIGINT, 'e': e::BIGINT}} ORDER BY rn) AS w, count(*) AS n FROM (SELECT *, sum(sz) OVER (ORDER BY rn) AS e FROM r)),
        h AS (
            SELECT list_sort(list_filter(w, lambda x: x.e <= {_ROOM})) AS heap, w[1:0] AS gone, len(list_filter(w, lambda x: x.e <= {_ROOM})) AS seen FROM a
            UNION ALL
            SELECT list_sort(list_concat(rest, list_transform(came, lambda x: {{'run': run + (x.k < low)::BIGINT, 'k': x.k, 'rn': x.rn, 'id': x.id, 'sz': x.sz, 'e': x.e}}))), gone, seen + len(came)
            FROM (
                SELECT *, list_filter(w[seen + 1 : seen + {_ROOM // HEADER_BYTES + 1}], lambda x: x.e - before + held <= {_ROOM}) AS came
                FROM (
                    SELECT w, seen, heap[: give] AS gone, heap[give + 1 :] AS rest, heap[give].run AS run, heap[give].k AS low, coalesce(w[seen].e, 0) AS before,
                           coalesce(list_sum(list_transform(heap[give + 1 :], lambda x: x.sz)), 0)::BIGINT AS held
                    FROM (SELECT h.*, a.w, CASE WHEN seen = n THEN len(heap) ELSE greatest(1, len(heap) // {runs.BATCH_PART}) END AS give FROM h, a WHERE len(heap) > 0)))),
        x AS (SELECT unnest(gone) AS x FROM h)"""
_M = "m AS (SELECT event_type AS series, user_id % 8 + 1 AS workers, avg(value) AS mean_s FROM events GROUP BY 1, 2)"

ORACLE = {
    "total_sort": "SELECT o_orderkey AS id, o_custkey AS k, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS position FROM orders",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "tie_rank": "SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_orderkey) AS rank FROM lineitem",
    "unsigned_order": """
        WITH u AS (SELECT o_orderkey AS id, o_orderkey::HUGEINT + CASE WHEN o_orderkey % 2 = 0 THEN 9223372036854775808::HUGEINT ELSE 0 END AS key FROM orders)
        SELECT id, key::VARCHAR AS key, row_number() OVER (ORDER BY key) AS position FROM u""",
    "record_format": """
        SELECT o_orderkey AS id, o_custkey || ' ' || strlen(o_orderpriority) || ' ' || hex(o_orderpriority) AS line, (12 + strlen(o_orderpriority))::BIGINT AS bytes FROM orders""",
    "fixed_runs": f"""
        WITH {_R}
        SELECT ((rn - 1) // {RUN_ROWS})::BIGINT AS run_id, count(*) AS n, min(k) AS kmin, max(k) AS kmax, sum(sz)::BIGINT AS bytes FROM r GROUP BY 1""",
    "greedy_chunks": f"""
        WITH RECURSIVE {_R},
        c AS (SELECT rn, sum(sz) OVER (ORDER BY rn) AS e FROM r),
        t AS (
            SELECT 0::BIGINT AS chunk_id, 0::HUGEINT AS s, (SELECT coalesce(min(e) FILTER (e >= {CHUNK}), max(e)) FROM c) AS e
            UNION ALL
            SELECT chunk_id + 1, t.e, (SELECT coalesce(min(c.e) FILTER (c.e >= t.e + {CHUNK}), max(c.e)) FROM c) FROM t WHERE t.e < (SELECT max(e) FROM c))
        SELECT t.chunk_id, min(c.rn) AS first_rn, max(c.rn) AS last_rn, (t.e - t.s)::BIGINT AS bytes
        FROM t JOIN c ON c.e > t.s AND c.e <= t.e GROUP BY t.chunk_id, t.s, t.e""",
    "budget_runs": f"""
        WITH RECURSIVE {_R},
        c AS (SELECT rn, sum(sz) OVER (ORDER BY rn) AS e FROM r),
        t AS (
            SELECT 0::BIGINT AS run_id, 0::HUGEINT AS s, (SELECT max(e) FROM c WHERE e <= {CHUNK}) AS e
            UNION ALL
            SELECT run_id + 1, t.e, (SELECT max(c.e) FROM c WHERE c.e <= t.e + {CHUNK}) FROM t WHERE t.e < (SELECT max(e) FROM c))
        SELECT t.run_id, min(c.rn) AS first_rn, max(c.rn) AS last_rn, (t.e - t.s)::BIGINT AS bytes
        FROM t JOIN c ON c.e > t.s AND c.e <= t.e GROUP BY t.run_id, t.s, t.e""",
    "round_robin": f"""
        WITH {_R}
        SELECT (rn - 1) % {WORKERS} AS worker, count(*) AS n, sum(sz)::BIGINT AS bytes, sum(k)::BIGINT AS key_sum FROM r GROUP BY 1""",
    "pair_merge": """
        WITH u AS (
            SELECT s_nationkey::BIGINT AS k, s_suppkey AS id, 0::BIGINT AS src FROM supplier
            UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer)
        SELECT k, id, src, row_number() OVER (ORDER BY k, src, id) AS position FROM u""",
    "kway_merge": f"""
        WITH {_R}, u AS (SELECT id, k, ((rn - 1) // {RUN_ROWS})::BIGINT AS run_id FROM r)
        SELECT id, k, run_id, row_number() OVER (ORDER BY k, run_id, id) AS position FROM u""",
    "merge_levels": f"""
        WITH RECURSIVE t AS (
            SELECT 0 AS level, ceil((SELECT count(*) FROM orders) / {RUN_ROWS}.0)::BIGINT AS files
            UNION ALL SELECT level + 1, files // 2 + files % 2 FROM t WHERE files > 1)
        SELECT level::INTEGER AS level, files FROM t""",
    "merge_groups": f"""
        WITH {_R}, u AS (SELECT ((rn - 1) // 300)::BIGINT AS run_id, k FROM r), n AS (SELECT max(run_id) + 1 AS n FROM u)
        SELECT (CASE WHEN n >= 16 THEN run_id // ceil(n / 8.0)::BIGINT ELSE 0 END)::BIGINT AS group_id, run_id, count(*) AS n, min(k) AS kmin
        FROM u, n GROUP BY 1, 2""",
    "violations": """
        WITH w AS (SELECT event_id, value, lag(value) OVER (ORDER BY event_id) AS previous FROM events)
        SELECT * FROM w WHERE value < previous""",
    "is_sorted": """
        WITH w AS (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS previous FROM events)
        SELECT count(*) FILTER (ts < previous) AS violations, count(*) FILTER (ts < previous) = 0 AS sorted FROM w""",
    "positional_diff": f"""
        WITH {_R}, a AS (SELECT rn AS position, k, sz FROM r), b AS (SELECT row_number() OVER (ORDER BY k, id) AS position, k, sz FROM r)
        SELECT position, a.k AS left_k, a.sz::BIGINT AS left_sz, b.k AS right_k, b.sz::BIGINT AS right_sz
        FROM a FULL JOIN b USING (position) WHERE a.k IS DISTINCT FROM b.k OR a.sz IS DISTINCT FROM b.sz""",
    "multiset_diff": f"""
        WITH {_R}, a AS (SELECT k, sz::BIGINT AS sz FROM r), b AS (SELECT c_custkey AS k, (12 + strlen(c_mktsegment))::BIGINT AS sz FROM customer)
        SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
        UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
    "same_multiset": f"""
        WITH {_R}, u AS (SELECT id, k, ((rn - 1) // {RUN_ROWS})::BIGINT AS run_id FROM r), m AS (SELECT * FROM u ORDER BY k, run_id, id)
        SELECT (SELECT count(*) FROM u) AS n, (SELECT count(*) FROM (SELECT * FROM u EXCEPT ALL SELECT * FROM m)) + (SELECT count(*) FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM u)) = 0 AS same""",
    "speedup": f"""
        WITH {_M}, b AS (SELECT min(mean_s) AS base_s FROM m WHERE workers = 1)
        SELECT series, workers, round(mean_s, 4) AS mean_s, round(base_s / mean_s, 4) AS speedup, round(base_s / mean_s / workers, 4) AS efficiency FROM m, b""",
    "weak_scaling": f"""
        WITH {_M}, w AS (SELECT series, workers, first_value(mean_s) OVER (PARTITION BY series ORDER BY workers) / mean_s AS weak FROM m)
        SELECT series, workers, round(weak, 4) AS weak, round(weak / workers, 4) AS weak_per_worker FROM w""",
    "best_config": f"""
        WITH {_M}, x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY mean_s, workers) AS i FROM m)
        SELECT series, workers, round(mean_s, 4) AS mean_s FROM x WHERE i = 1""",
    "worker_counts": "SELECT DISTINCT user_id % 8 + 1 AS workers FROM events",
    "log_export": """
        WITH c AS (SELECT event_type AS series, user_id % 8 + 1 AS workers, count(*) AS n FROM events GROUP BY 1, 2)
        SELECT series, '#let runs_' || series || ' = (' || string_agg('(' || workers || ', ' || n || '.00)', ', ' ORDER BY workers) || ')' AS text FROM c GROUP BY series""",
    "log_parse": """
        SELECT event_type || '.log' AS file, 'sort_' || event_type AS algo, user_id % 8 + 1 AS nthreads, count(*) AS max_mem,
               min(round(value, 2)) AS low, max(round(value, 2)) AS high, 2::BIGINT AS timings
        FROM events GROUP BY event_type, user_id % 8 + 1""",
    "mem_budget": f"""
        WITH {_R}, s AS (SELECT sum(sz)::BIGINT AS bytes FROM r)
        SELECT bytes, least(bytes // 10, 8589934592, 34359738368)::BIGINT AS budget, least(8589934592, floor(bytes * 1.1))::BIGINT AS cap,
               least(bytes // 100, floor(least(bytes // 10, 8589934592) * 3 / 8))::BIGINT AS chunk FROM s""",
    "generator_stats": "SELECT count(*) AS n, 8::BIGINT AS shortest, 63::BIGINT AS longest, 0::BIGINT AS wrong FROM orders",
    "roundtrip": "SELECT o_orderkey AS key, strlen(o_orderpriority)::BIGINT AS len, o_orderpriority AS payload FROM orders",
    "single_file": "SELECT o_orderkey AS key, strlen(o_orderpriority)::BIGINT AS len, o_orderpriority AS payload FROM orders",
    "truncated_tail": "SELECT o_orderkey AS key, strlen(o_orderpriority)::BIGINT AS len, o_orderpriority AS payload FROM orders WHERE o_orderkey < (SELECT max(o_orderkey) FROM orders)",
    "byte_range": f"""
        WITH {_R}, p AS (SELECT id, rn, sum(sz) OVER (ORDER BY rn) AS e FROM r), o AS (SELECT max(e) AS e FROM p WHERE rn <= 100)
        SELECT o_orderkey AS key, strlen(o_orderpriority)::BIGINT AS len, o_orderpriority AS payload
        FROM orders JOIN p ON p.id = o_orderkey, o WHERE p.rn > 100 AND p.e <= o.e + {CHUNK}""",
    "file_size": "SELECT sum(12 + strlen(o_orderpriority))::BIGINT AS folder, sum(12 + strlen(o_orderpriority))::BIGINT AS gathered, sum(12 + strlen(o_orderpriority))::BIGINT AS renamed, 0::BIGINT AS gone FROM orders",
    "boundary_scan": f"""
        WITH RECURSIVE {_R},
        c AS (SELECT sum(sz) OVER (ORDER BY rn) AS e FROM r),
        t AS (
            SELECT 0::BIGINT AS cut, 0::HUGEINT AS b
            UNION ALL
            SELECT cut + 1, (SELECT coalesce(min(c.e) FILTER (c.e >= t.b + {CHUNK}), max(c.e)) FROM c) FROM t WHERE t.b < (SELECT max(e) FROM c))
        SELECT cut, b::BIGINT AS byte FROM t""",
    "replacement_runs": f"""
        WITH RECURSIVE {_H}
        SELECT x.id AS id, x.k AS k, x.sz AS sz, x.rn AS rn, 0 AS lane, x.run AS run_id, row_number() OVER (PARTITION BY x.run ORDER BY x.k, x.rn) AS run_position FROM x""",
    "run_comparison": f"""
        WITH RECURSIVE {_H},
        c AS (SELECT sum(sz) OVER (ORDER BY rn) AS e FROM r),
        t AS (
            SELECT 1::BIGINT AS run, (SELECT max(e) FROM c WHERE e <= {int(HEAP_BYTES * runs.RUN_SHARE)}) AS e
            UNION ALL
            SELECT run + 1, (SELECT max(c.e) FROM c WHERE c.e <= t.e + {int(HEAP_BYTES * runs.RUN_SHARE)}) FROM t WHERE t.e < (SELECT max(e) FROM c))
        SELECT load_sort, replacement, replacement < load_sort AS fewer FROM (SELECT (SELECT max(run) FROM t) AS load_sort, (SELECT count(DISTINCT x.run) FROM x) AS replacement)""",
    "sorted_runs": f"""
        WITH RECURSIVE {_R},
        c AS (SELECT id, k, rn, sum(sz) OVER (ORDER BY rn) AS e FROM r),
        t AS (
            SELECT 0::BIGINT AS run_id, 0::HUGEINT AS s, (SELECT max(e) FROM c WHERE e <= {CHUNK}) AS e
            UNION ALL
            SELECT run_id + 1, t.e, (SELECT max(c.e) FROM c WHERE c.e <= t.e + {CHUNK}) FROM t WHERE t.e < (SELECT max(e) FROM c))
        SELECT c.id, c.k, t.run_id, row_number() OVER (PARTITION BY t.run_id ORDER BY c.k, c.rn) AS run_position
        FROM t JOIN c ON c.e > t.s AND c.e <= t.e""",
    "merge_tree": f"""
        WITH {_R}, u AS (SELECT id, k, ((rn - 1) // {RUN_ROWS})::BIGINT AS run_id FROM r),
        l AS (SELECT unnest(generate_series(0, ceil(log2(greatest(1, max(run_id) + 1)))::BIGINT)) AS level FROM u)
        SELECT level::INTEGER AS level, run_id >> level AS merged_run, row_number() OVER (PARTITION BY level, run_id >> level ORDER BY k, run_id, id) AS position, id, k FROM u, l""",
    "grouped_merge": f"""
        WITH {_R}, u AS (SELECT id, k, ((rn - 1) // 300)::BIGINT AS run_id FROM r), n AS (SELECT max(run_id) + 1 AS n FROM u),
        g AS (SELECT *, (CASE WHEN n >= 16 THEN run_id // ceil(n / 8.0)::BIGINT ELSE 0 END)::BIGINT AS group_id FROM u, n)
        SELECT id, k, group_id, row_number() OVER (PARTITION BY group_id ORDER BY k, run_id, id) AS group_position, row_number() OVER (ORDER BY k, run_id, id) AS position FROM g""",
    "descending_drain": "SELECT o_orderkey AS id, o_custkey AS k, row_number() OVER (ORDER BY o_custkey DESC, o_orderkey DESC) AS position FROM orders",
    "deal_chunks": f"""
        WITH {_R}, u AS (SELECT ((rn - 1) // {RUN_ROWS})::BIGINT AS chunk_id FROM r)
        SELECT chunk_id % {WORKERS - 1} AS worker, chunk_id, count(*) AS n FROM u GROUP BY chunk_id""",
    "log_routing": """
        WITH t AS (SELECT event_type AS e, user_id % 4 AS way, user_id % 8 + 1 AS workers, max(round(value, 2)) AS s FROM events GROUP BY 1, 2, 3)
        SELECT 'weak' AS variant, 'sort_' || e || CASE WHEN way = 0 THEN '' WHEN way = 1 THEN '_no_mapping' ELSE '_blocking' END AS series, count(*) AS timings, max(s) AS high FROM t GROUP BY 2""",
    "log_blocks": """
        WITH c AS (SELECT event_type AS series, user_id % 8 + 1 AS w, count(*) AS n FROM events GROUP BY 1, 2),
        v AS (SELECT series, w, printf('%.2f', n::DOUBLE) AS speed, printf('%.2f', round(n / w, 2)) AS eff FROM c),
        l AS (SELECT series, '  ' || series || ': (' || string_agg(speed, ', ' ORDER BY w) || '),' AS speed, '  ' || series || ': (' || string_agg(eff, ', ' ORDER BY w) || '),' AS eff FROM v GROUP BY series),
        t AS (SELECT string_agg(w, ', ' ORDER BY w) AS threads FROM (SELECT DISTINCT w FROM c))
        SELECT 'speed' AS block, '#let events_speed = (' || chr(10) || '  threads: (' || threads || '),' || chr(10) || (SELECT string_agg(speed, chr(10) ORDER BY speed) FROM l) || chr(10) || ')' AS text FROM t
        UNION ALL
        SELECT 'eff', '#let events_eff = (' || chr(10) || '  threads: (' || threads || '),' || chr(10) || (SELECT string_agg(eff, chr(10) ORDER BY eff) FROM l) || chr(10) || ')' FROM t""",
}
