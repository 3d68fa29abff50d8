import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrand.functions.keys import formatted, key_of, ord_of_bits
from keystrand.operators import benchlog, merging, partitioning, runs, sorting, verify

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SIZES = st.lists(st.integers(1, 60), max_size=40)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_total_sort_keeps_rows_and_orders_unsigned_keys(spark):
    keys = [0, 5, 5, 7, 1 << 63, (1 << 64) - 1, (1 << 63) - 1]
    bits = [(k if k < 1 << 63 else k - (1 << 64), i) for i, k in enumerate(keys)]
    df = frame(spark, bits, "bits long, id int").withColumn("key_ord", ord_of_bits(F.col("bits")))
    got = [int(r.key) for r in sorting.total_sort(df, "key_ord", "id").select(key_of(F.col("key_ord")).alias("key")).collect()]
    assert got == sorted(keys)


def test_plan_of_total_sort_is_one_range_exchange(spark, capsys):
    sorting.total_sort(spark.range(1000).withColumn("k", F.xxhash64("id")), "k").explain()
    plan = capsys.readouterr().out
    assert plan.count("rangepartitioning") == 1 and "SinglePartition" not in plan


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_positions_count_from_one(spark, n):
    rows = [(random.Random(n).randrange(50), i) for i in range(n)]
    got = sorting.with_position(frame(spark, rows, "k int, id int"), "k", "id").collect()
    assert {r.position: (r.k, r.id) for r in got} == dict(enumerate(sorted(rows), 1))


def test_equal_keys_sort_by_tie_break(spark):
    rows = [(1, i) for i in range(200)]
    got = sorting.with_position(frame(spark, rows, "k int, id int"), "k", "id").collect()
    assert all(r.position == r.id + 1 for r in got)


def test_previous_crosses_ranges(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 3)
    got = {r.id: r.previous for r in sorting.with_previous(df, "v", "id").collect()}
    assert got == {i: (i - 1) * 3 if i else None for i in range(500)}


def test_top_k_takes_ordered(spark, capsys):
    df = sorting.top_k(spark.range(1000), 3, F.col("id").desc())
    assert [r.id for r in df.collect()] == [999, 998, 997]
    df.explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def greedy(sizes, chunk):
    out, used, k = [], 0, 0
    for s in sizes:
        out.append(k)
        used += s
        if used >= chunk:
            used, k = 0, k + 1
    return out


def budget(sizes, most):
    out, used, k = [], 0, 0
    for s in sizes:
        if used and used + s > most:
            used, k = 0, k + 1
        out.append(k)
        used += s
    return out


@FEW
@given(SIZES, st.integers(1, 100))
def test_greedy_and_budget_cuts(spark, sizes, limit):
    df = frame(spark, [("f", i, s) for i, s in enumerate(sizes)], "file string, rn int, sz int")
    got = {r.rn: r.chunk_id for r in runs.greedy_chunks(df, limit, "sz", "file", "rn").collect()}
    assert [got[i] for i in range(len(sizes))] == greedy(sizes, limit)
    got = {r.rn: r.run_id for r in runs.budget_runs(df, limit, "sz", "file", "rn").collect()}
    assert [got[i] for i in range(len(sizes))] == budget(sizes, limit)


def test_cuts_do_not_depend_on_batches(spark):
    sizes = [random.Random(1).randrange(1, 50) for _ in range(3000)]
    df = frame(spark, [("f", i, s) for i, s in enumerate(sizes)] + [("g", i, 7) for i in range(100)], "file string, rn int, sz int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        got = {(r.file, r.rn): r.run_id for r in runs.budget_runs(df, 500, "sz", "file", "rn").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [got["f", i] for i in range(3000)] == budget(sizes, 500)
    assert [got["g", i] for i in range(100)] == budget([7] * 100, 500)


def test_rows_without_a_file_name_are_one_file(spark):
    df = frame(spark, [(None, i, 10) for i in range(200)], "file string, rn int, sz int")
    for batch in (10_000, 16):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = {r.rn: r.run_id for r in runs.budget_runs(df, 50, "sz", "file", "rn").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {i: i // 5 for i in range(200)}


def test_sorted_runs(spark):
    rng = random.Random(5)
    rows = [("f", i, rng.randrange(1, 40), rng.randrange(20)) for i in range(300)]
    got = runs.sorted_runs(frame(spark, rows, "file string, rn int, sz int, k int"), 200, "k", "sz", "file", "rn").collect()
    cut = budget([r[2] for r in rows], 200)
    for run in set(cut):
        mine = sorted(((r[3], r[1]) for r, c in zip(rows, cut, strict=True) if c == run))
        assert [(r.k, r.rn) for r in sorted((x for x in got if x.run_id == run), key=lambda r: r.run_position)] == mine


@pytest.mark.parametrize("n", [1, 2, 5, 16])
def test_merge_tree_and_grouped_merge(spark, n):
    """Level by level against merging by hand; in the end both are the k-way merge."""
    rng = random.Random(n)
    rows = [(rng.randrange(9), i, i % n) for i in range(n * 6)]
    df = frame(spark, rows, "k int, id int, run_id long")
    level = [sorted((k, r, i) for k, i, r in rows if r == x) for x in range(n)]
    want, depth = {}, 0
    while True:
        want |= {(depth, x, p): i for x, run in enumerate(level) for p, (_, _, i) in enumerate(run, 1)}
        if len(level) == 1:
            break
        level = [sorted(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        depth += 1
    assert {(r.level, r.merged_run, r.position): r.id for r in merging.merge_tree(df, n, "k", "id").collect()} == want
    got = merging.grouped_merge(df, n, 4, "k", "id").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == [i for _, _, i in level[0]]
    for g in {r.group_id for r in got}:
        mine = sorted((r for r in got if r.group_id == g), key=lambda r: r.group_position)
        assert [(r.k, r.run_id, r.id) for r in mine] == sorted((r.k, r.run_id, r.id) for r in mine) and [r.group_position for r in mine] == list(range(1, len(mine) + 1))


@pytest.mark.parametrize("keys", [[], [5], list(range(300)), list(range(300, 0, -1)), [random.Random(3).randrange(1000) for _ in range(2000)], [4] * 100])
def test_replacement_runs(spark, keys):
    df = frame(spark, [(k, 10, i) for i, k in enumerate(keys)], "k int, sz int, rn int")
    got = runs.replacement_runs(df, 1000, "k", "sz", "rn").collect()
    assert sorted(r.rn for r in got) == list(range(len(keys)))
    by_run: dict = {}
    for r in sorted(got, key=lambda r: (r.run_id, r.run_position)):
        by_run.setdefault(r.run_id, []).append(r.k)
    assert all(x == sorted(x) for x in by_run.values())
    if keys == sorted(keys) and keys:
        assert len(by_run) == 1
    if len(keys) == 2000:
        assert len(by_run) < len(keys) * 10 / 800


@pytest.mark.parametrize("n,memory", [(0, 500), (1, 5), (300, 500), (1200, 700)])
def test_replacement_runs_equal_selection_by_hand(spark, n, memory):
    """Against a list that is searched for its smallest row each time; sizes differ, some are above the memory."""
    rng = random.Random(n)
    rows = [(rng.randrange(-50, 50), rng.choice([5, 12, 40, 900 if i % 97 == 0 else 20]), i) for i in range(n)]
    got = runs.replacement_runs(frame(spark, rows, "k int, sz int, rn int"), memory, "k", "sz", "rn").collect()
    waiting: list = []
    want, run, last = [], 0, None

    def give(times):
        nonlocal run, last
        for _ in range(times):
            least = min(waiting)
            waiting.remove(least)
            last = None if least[0] != run else last
            run, last = least[0], least[1]
            want.append((least[2], run, 1 + sum(r == run for _, r, _ in want)))

    for k, size, i in rows:
        while waiting and sum(rows[j][1] for _, _, j in waiting) + size > int(memory * 0.8):
            give(max(1, len(waiting) // 20))
        waiting.append((run + (last is not None and k < last), k, i))
    give(len(waiting))
    assert sorted((r.rn, r.run_id, r.run_position) for r in got) == sorted(want)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 50])
def test_merge_shapes_agree(spark, n):
    rows = [(random.Random(i).randrange(9), i, i % max(1, n)) for i in range(n * 7)]
    df = frame(spark, rows, "k int, id int, run_id long")
    want = [(k, r, i) for k, r, i in sorted((k, r, i) for k, i, r in rows)]
    got = sorted(merging.kway_merge(df, "k", "run_id", "id").collect(), key=lambda r: r.position)
    assert [(r.k, r.run_id, r.id) for r in got] == want
    if n == 2:
        a, b = (df.where(F.col("run_id") == i).select("k", "id") for i in (0, 1))
        got = sorted(merging.pair_merge(a, b, "k", "id").collect(), key=lambda r: r.position)
        assert [(r.k, r.src, r.id) for r in got] == want


def test_merge_levels_and_groups(spark):
    assert [r.files for r in merging.merge_levels(spark, 5).orderBy("level").collect()] == [5, 3, 2, 1]
    assert [r.files for r in merging.merge_levels(spark, 1).collect()] == [1]
    df = spark.range(20).withColumnRenamed("id", "run_id")
    assert {r.run_id: r.group_id for r in merging.merge_groups(df, 20, 8).collect()} == {i: i // 3 for i in range(20)}
    assert {r.group_id for r in merging.merge_groups(df, 20, 11).collect()} == {0}


def test_round_robin_and_budgets(spark):
    chunks = spark.range(9).withColumnRenamed("id", "chunk_id")
    assert {r.chunk_id: r.worker for r in partitioning.deal_chunks(chunks, 4).collect()} == {i: i % 3 for i in range(9)}
    df = spark.range(1, 11).withColumnRenamed("id", "position")
    assert {r.position: r.worker for r in partitioning.round_robin(df, 4).collect()} == {i: (i - 1) % 4 for i in range(1, 11)}
    row = spark.range(1).select(partitioning.memory_budget(F.lit(100)).alias("b"), partitioning.memory_cap(F.lit(1000), F.lit(100)).alias("c"), partitioning.chunk_bytes(F.lit(1000), F.lit(16), 8).alias("k")).first()
    assert tuple(row) == (10, 110, 6)


def test_verification(spark):
    df = frame(spark, [(1, 1), (2, 3), (3, 2), (4, 5)], "i int, v int")
    assert [(r.i, r.previous) for r in verify.violations(df, "v", "i").collect()] == [(3, 3)]
    assert verify.is_sorted(df, "v", "i").first().sorted is False
    assert verify.is_sorted(df.limit(0), "v", "i").first().sorted is True
    a = frame(spark, [(1, 5, b"x"), (2, 6, b"y")], "position int, k int, p binary")
    b = frame(spark, [(1, 5, b"x"), (2, 6, b"z"), (3, 7, None)], "position int, k int, p binary")
    assert sorted(r.position for r in verify.positional_diff(a, b, ["k", "p"]).collect()) == [2, 3]
    x, y = a.select("k"), b.select("k")
    assert [(r.k, r.side) for r in verify.multiset_diff(x, y).collect()] == [(7, "right")]
    assert verify.fingerprint(x).first() == verify.fingerprint(x.orderBy(F.col("k").desc())).first()
    assert verify.fingerprint(x).first() != verify.fingerprint(y).first()


def test_formatter(spark):
    row = spark.range(1).select(formatted(ord_of_bits(F.lit(-1).cast("long")), F.unhex(F.lit("0AFF"))).alias("x")).first()
    assert row.x == f"{(1 << 64) - 1} 2 0AFF"


LOG = """###
(sequential binary merge, max_mem=10)
# elapsed time (sort_seq): 4.0s
# elapsed time (sort_seq): 6.0s
(sequential kway merge, max_mem=10)
# elapsed time (sort_seq): 4.0s
###
(nthreads=2, max_mem=10)
# elapsed time (sort_tasks): 2.0s
# elapsed time (sort_farm_blocking): 1e0s
# elapsed time (sort_farm_no_mapping_blocking): 3.0s
"""


def test_log_analytics(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "a_mpi_weak.log").write_text("(nnodes=3, filesize=99, nthreads=4, max_mem=10)\n# elapsed time (sort_ranks): 8s\n")
    rows = benchlog.parse(benchlog.read_logs(spark, str(tmp_path)))
    got = {(r.variant, r.series, r.nthreads, r.nnodes, r.filesize, r.seconds) for r in rows.collect()}
    assert got == {
        ("base", "binary", None, None, None, 4.0), ("base", "binary", None, None, None, 6.0), ("base", "kway", None, None, None, 4.0),
        ("base", "sort_tasks", 2, None, None, 2.0), ("base", "sort_farm_blocking", 2, None, None, 1.0), ("base", "sort_farm_blocking", 2, None, None, 3.0), ("weak", "sort_ranks", 4, 3, 99, 8.0),
    }
    base = benchlog.baseline(rows)
    assert base.first().base_s == 4.0
    mean = benchlog.means(rows.where("nthreads = 2"), "series", F.col("nthreads").alias("workers"))
    assert {(r.series, r.speedup, r.efficiency) for r in benchlog.speedup(mean, base).collect()} == {("sort_tasks", 2.0, 1.0), ("sort_farm_blocking", 2.0, 1.0)}
    text = {r.text for r in benchlog.export(benchlog.speedup(mean, base), "speedup", "speedup").collect()}
    assert "#let speedup_sort_tasks = ((2, 2.00))" in text
    blocks = {r.block: r.text for r in benchlog.export_blocks(benchlog.speedup(mean, base), "run").collect()}
    assert blocks["speed"] == "#let run_speed = (\n  threads: (2),\n  sort_farm_blocking: (2.00),\n  sort_tasks: (2.00),\n)" and "run_eff" in blocks["eff"]
    with pytest.warns(UserWarning, match="a_mpi_strong.log"):
        variants = benchlog.parse(benchlog.read_variants(spark, str(tmp_path / "a.log")))
    assert {r.variant for r in variants.collect()} == {"base", "weak"}
