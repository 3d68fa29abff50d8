import struct

import pytest
from pyspark.sql import functions as F

from keystrand.sources.generate import generate_records
from keystrand.sources.recordfile import export_single, register, remove, size_of, walk
from keystrand.streaming import intake


def pack(records):
    return b"".join(struct.pack("<QI", k, len(p)) + p for k, p in records)


@pytest.fixture
def records(spark):
    register(spark)
    return lambda path, **options: spark.read.format("recordfile").options(**options).load(str(path))


def content(df):
    return sorted((r.key_ord + (1 << 63), r.len, bytes(r.payload)) for r in df.collect())


CASES = {
    "empty": [], "one": [(1, b"x")], "bounds": [(0, b""), ((1 << 63) - 1, b"a"), (1 << 63, b"b"), ((1 << 64) - 1, b"c")],
    "ties": [(5, bytes([i])) for i in range(50)], "large": [(3, b"z" * 300_000), (2, b""), (1, b"q" * 10)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("split", [1, 100, 1 << 26])
def test_read(records, tmp_path, name, split):
    (tmp_path / "in.dat").write_bytes(pack(CASES[name]))
    assert content(records(tmp_path / "in.dat", splitBytes=split)) == sorted((k, len(p), p) for k, p in CASES[name])


@pytest.mark.parametrize("cut", [1, 5, 13])
def test_truncated_tail(records, tmp_path, cut):
    raw = pack([(1, b"abcdefgh"), (2, b"ijklmnop")])
    (tmp_path / "in.dat").write_bytes(raw[:-cut])
    with pytest.raises(Exception, match="cut off"):
        records(tmp_path / "in.dat").collect()
    assert content(records(tmp_path / "in.dat", truncatedTail="drop")) == [(1, 8, b"abcdefgh")]


def test_missing_input(records, tmp_path):
    with pytest.raises(Exception, match="nothing"):
        records(tmp_path / "nothing").collect()


def test_sorted_roundtrip_to_one_file(spark, records, tmp_path):
    rows = generate_records(spark, 2000, wide_keys=True)
    rows.orderBy("key_ord").select("key_ord", "payload").write.format("recordfile").mode("append").save(str(tmp_path / "out"))
    back = records(tmp_path / "out", splitBytes=5000)
    assert content(back) == content(rows)
    size = export_single(str(tmp_path / "out"), str(tmp_path / "all.dat"))
    assert size == rows.agg(F.sum(F.col("len") + 12)).first()[0]
    single = records(tmp_path / "all.dat")
    assert content(single) == content(rows)
    raw, at, keys = (tmp_path / "all.dat").read_bytes(), 0, []
    while at < len(raw):
        k, n = struct.unpack_from("<QI", raw, at)
        keys.append(k)
        at += 12 + n
    assert keys == sorted(keys)


def test_append_and_overwrite(spark, records, tmp_path):
    rows = generate_records(spark, 10).select("key_ord", "payload")
    path = str(tmp_path / "out")
    for mode, n in (("append", 10), ("append", 20), ("overwrite", 10)):
        rows.write.format("recordfile").mode(mode).save(path)
        assert records(path).count() == n


def test_walk_cuts_are_record_aligned(tmp_path):
    from pyarrow import fs

    data = [(i, bytes(i % 40)) for i in range(500)]
    (tmp_path / "in.dat").write_bytes(pack(data))
    bounds = {0}
    for _, p in data:
        bounds.add(max(bounds) + 12 + len(p))
    cuts = walk(fs.LocalFileSystem(), str(tmp_path / "in.dat"), 1000, "raise")
    assert set(cuts) <= bounds and cuts[-1] == max(bounds)
    assert all(z - a >= 1000 for a, z in zip(cuts, cuts[1:-1], strict=False))


def test_generator(spark):
    a, b = generate_records(spark, 300, 20, seed=1), generate_records(spark, 300, 20, seed=1)
    assert content(a) == content(b) != content(generate_records(spark, 300, 20, seed=2))
    assert all(8 <= n <= 19 and n == len(p) and 0 <= k < 1 << 32 for k, n, p in content(a))
    assert generate_records(spark, 0).count() == 0
    with pytest.raises(ValueError):
        generate_records(spark, 5, 8)


def test_stream_of_runs(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "runs")
    rows = generate_records(spark, 100)
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    for _ in range(2):
        query = intake.write_runs(stream, out, str(tmp_path / "state"), "key_ord", "id")
        query.awaitTermination()
        rows.withColumn("id", F.col("id") + 100).write.mode("append").parquet(source)
    assert intake.read_runs(spark, out).select("run_id").distinct().count() == 2
    merged = sorted(intake.merged(spark, out, "key_ord", "id").collect(), key=lambda r: r.position)
    assert len(merged) == 200 and [r.key_ord for r in merged] == sorted(r.key_ord for r in merged)


def test_byte_range(records, tmp_path):
    data = [(i, bytes([i]) * 8) for i in range(10)]  # 20 bytes each
    path = tmp_path / "in.dat"
    path.write_bytes(pack(data))
    assert [k for k, _, _ in content(records(path, offset=60))] == list(range(3, 10))
    assert [k for k, _, _ in content(records(path, offset=60, maxBytes=59))] == [3, 4]
    assert [k for k, _, _ in content(records(path, maxBytes=0))] == []
    assert size_of(str(path)) == 200 and size_of(str(tmp_path / "none")) == 0
    remove(str(path))
    remove(str(path))
    assert not path.exists()


def test_many_files_are_walked_as_they_are_read(records, tmp_path):
    data = [(i, bytes(i % 40)) for i in range(400)]
    for k in range(20):
        (tmp_path / f"part-{k}.rec").write_bytes(pack(data[k * 20 : k * 20 + 20]))
    assert content(records(tmp_path)) == sorted((k, len(p), p) for k, p in data)
    assert [r.key_ord for r in records(tmp_path).collect()] == [k - (1 << 63) for k, _ in data]  # parts in the order of their numbers
    (tmp_path / "part-20.rec").write_bytes(pack([(1, b"abcd")])[:-1])
    with pytest.raises(Exception, match="cut off"):
        records(tmp_path).collect()
    assert len(content(records(tmp_path, truncatedTail="drop"))) == 400


def test_manifest_tells_what_counts(spark, records, tmp_path):
    """Parts that no commit has named, and files that a lost task left, are not read; an overwrite leaves the new parts only."""
    rows = generate_records(spark, 30).select("key_ord", "payload")
    path = tmp_path / "out"
    rows.write.format("recordfile").mode("append").save(str(path))
    (path / "part-0000000099-lost.rec").write_bytes(pack([(1, b"lost")]))
    assert records(path).count() == 30
    rows.limit(7).write.format("recordfile").mode("overwrite").save(str(path))
    assert records(path).count() == 7
    assert not [x for x in path.iterdir() if x.name.startswith("_temporary")]
    assert size_of(str(path)) == sum(r.len + 12 for r in records(path).collect())


def test_single_part_is_renamed(spark, records, tmp_path):
    rows = generate_records(spark, 9).select("key_ord", "payload").coalesce(1)
    rows.write.format("recordfile").mode("append").save(str(tmp_path / "out"))
    size = export_single(str(tmp_path / "out"), str(tmp_path / "out.dat"), move=True)
    assert not (tmp_path / "out").exists() and (tmp_path / "out.dat").stat().st_size == size
    assert records(tmp_path / "out.dat").count() == 9
