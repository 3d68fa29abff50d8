"""Nulls, empty and long texts, repeats, ties, clashing columns and empty tables, against brute force."""

import hashlib
import heapq
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import empty, odd, odd_rows

import corpus_pipeline
from keystrand.llm import blocks, bpe, exact_dedup, jaccard, language, mixing, pitman_yor, quality, sharding, substring_dedup, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
BIG = 1 << 62


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1], r[3]) for r in odd_rows()]


def count(text):
    return len(WORD.findall(text or ""))


def test_mixing(spark, rows):
    got = mixing.mix(odd(spark)).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), count(t)) for i, t, _ in rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(x[0].target for x in by.values()) - total) < 1
    for x in by.values():
        assert x[0].source_size == sum(r.size for r in x)
        assert abs(sum(r.taken for r in x) - x[0].target) <= 1
        assert all(r.taken <= 3 * r.size for r in x)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(odd(spark)).collect()))


def test_mix_is_carried_out(spark, rows):
    """Words out are words planned, row by row, whichever rows repeat."""
    docs = odd(spark)
    plan = mixing.mix(docs)
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    planned, out = {}, {}
    for r in plan.collect():
        planned[r.doc_id, r.source] = planned.get((r.doc_id, r.source), 0) + r.taken
    for r in got.collect():
        out[r.doc_id, r.source] = out.get((r.doc_id, r.source), 0) + count(r.text)
    assert {k: v for k, v in planned.items() if v} == {k: v for k, v in out.items() if v}
    assert mixing.water_fill([10, 10, 100], [1, 2, 3], 120, 3) == [22.5, 30.0, 67.5]


def test_mix_of_rows_that_repeat(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", "s", k) for k in (0, 0, 0, 1)] + [(None, "x y z", "s", 0)] * 5 + [(2, "q " * 9, "t", 0), (2, "w " * 11, "t", 0)], "doc_id long, text string, source string, extra int")
    plan, got = mixing.mix(docs).collect(), mixing.mixed(docs).collect()
    assert len(plan) == 11 and sum(r.size for r in plan) == sum(r.taken for r in plan) == sum(count(r.text) for r in got) == 63


@pytest.mark.parametrize("heavy,cells", [(1000, 1 << 16), (2, 8)])
def test_sharding(spark, rows, heavy, cells):
    got = sharding.shard(odd(spark), shards=6, heavy=heavy, cells=cells).collect()
    want = [(str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows]
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(want)
    by: dict = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and set(by) <= set(range(6))
    at: dict = {}
    for r in got:
        at.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(x) == 1 for x in at.values())


def test_lpt_is_near_even():
    sizes = [(i, (i * 7919) % 1000 + 1) for i in range(500)]
    placed = sharding.schedule(sizes, 7)
    loads = [sum(s for i, s in sizes if placed[i] == k) for k in range(7)]
    assert max(loads) - min(loads) <= min(s for _, s in sizes) + 10


def test_sharding_equals_serial_lpt(spark):
    """Groups above the limit, of unlike sizes, against a heap over all of them."""
    rows = [(10 * g + j, f"{g} " + "x" * (3 * g)) for g in range(40) for j in range(1 + g % 3)] + [(1000, None), (1001, "")]
    groups: dict = {}
    for _, t in rows:
        groups[t or ""] = groups.get(t or "", 0) + len(t or "") + 8
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=5, heavy=10_000).collect()
    loads: dict = {}
    for r in got:
        loads[r.shard] = loads.get(r.shard, 0) + r.size
    heap, serial = [(0, k) for k in range(5)], [0] * 5
    for n in sorted(groups.values(), reverse=True):
        load, k = heapq.heappop(heap)
        serial[k] += n
        heapq.heappush(heap, (load + n, k))
    assert sorted(loads.values()) == sorted(serial)


def test_sharding_of_cells_is_even(spark):
    """With small groups in cells, no two shards differ by more than the largest item; one hot text is not spread over shards."""
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = sharding.shard(docs, shards=4, heavy=50, cells=256).collect()
    loads = [sum(r.size for r in rows if r.shard == k) for k in range(4)]
    hot = {r.shard for r in rows if r.doc_id % 3 == 0}
    assert len(rows) == 6000 and len(hot) == 1
    rest = [n for k, n in enumerate(loads) if k not in hot]
    item = max(r[0] for r in docs.where("doc_id % 3 != 0").groupBy(F.pmod(F.xxhash64("text"), F.lit(256)).alias("c")).agg(F.sum(F.length("text") + 8)).select("sum((length(text) + 8))").collect())
    assert max(rest) - min(rest) <= item


def dedup_by_hand(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return want, groups, norm


@pytest.mark.parametrize("capacity,bits", [(1, 64), (2000, 64), (1 << 30, 64), (2000, 3), (100, 1)])
def test_exact_dedup(spark, rows, capacity, bits):
    """All rows come back, repeated ones too, at any depth of the directory, and where many texts share a key."""
    want, groups, norm = dedup_by_hand(rows)
    got = [tuple(r) for r in exact_dedup.dedup(odd(spark), capacity, key_bits=bits).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    if (capacity, bits) == (2000, 64):
        stay = exact_dedup.survivors(odd(spark))
        assert stay.columns == odd(spark).columns
        assert sorted(norm(r.text) for r in stay.collect()) == sorted(groups)


def test_exact_dedup_of_shared_texts(spark):
    """Texts with very many rows are inserted once; repeated rows and null ids among them count."""
    rows = [(k % 1500 if k % 3 else None, "one text" if k % 2 else f"text {k % 7}") for k in range(9000)] + [(5, "alone"), (5, "alone")]
    got = [tuple(r) for r in exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 500).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, dedup_by_hand(rows)[0]))


def test_directory_doubles(spark):
    at = lambda x: x << 56 if x < 128 else (x << 56) - (1 << 64)
    keys = spark.createDataFrame([(at(0), 10), (at(0) + 1, 10), (at(200), 5), (at(201), 30)], "key long, bytes long")
    buckets = exact_dedup.directory(keys, 15)
    assert buckets[63, 0] == 20 and buckets[8, 201] == 30 and buckets[8, 200] == 5  # keys 0 and 1 differ in the last bit, which no directory looks at
    assert all(x <= 15 for b, x in buckets.items() if b not in ((63, 0), (8, 201)))
    assert sum(2.0 ** -d for d, _ in buckets) == 1
    assert exact_dedup.directory(keys, 100) == {(0, 0): 55}
    table = exact_dedup.Directory(keys, buckets)
    assert {(r.key, r.depth, r.prefix) for r in table.routed(keys).collect()} == {(at(0), 63, 0), (at(0) + 1, 63, 0), (at(200), 8, 200), (at(201), 8, 201)}


def components(rows, percent=75):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOW))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low: dict = {}
    for k, (i, _, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), BIG), BIG if i is None else i)
    return [(i, len(sets[k]), None if low[find(k)] == BIG else low[find(k)]) for k, (i, _, _) in enumerate(rows)]


@pytest.fixture(params=["one owner", "many owners"])
def block_bytes(request, monkeypatch):
    """Blocks as usual, and blocks smaller than some texts, several in a task, with owners that see many blocks."""
    if request.param == "one owner":
        return blocks.BLOCK_BYTES
    usual = blocks.sizes
    monkeypatch.setattr(blocks, "sizes", lambda total, least: (2000, max(8, usual(total, 2000)[1])))
    return 2000


def test_sizes_grow_with_the_root():
    for total in (0, 10**6, 10**9, 53 * 10**9, 10**12, 10**14):
        block, parts = blocks.sizes(total)
        assert total / block * parts <= max(64, total / 200) and block >= blocks.BLOCK_BYTES


@pytest.mark.parametrize("tile", [1 << 23, 20_000])
def test_jaccard_join(spark, rows, tile, monkeypatch, block_bytes):
    monkeypatch.setattr(jaccard, "TILE_BYTES", tile)
    got = [tuple(r) for r in jaccard.jaccard_join(odd(spark), block_bytes=block_bytes).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, components(rows)))


def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch):
    import random

    monkeypatch.setattr(jaccard, "TILE_BYTES", 10_000)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(60)] = f"e{rng.randrange(30)}"
        texts.append(" ".join(w))
    rows = [(i, t, None) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.jaccard_join(df).collect()) == sorted(components(rows))
    stay = jaccard.survivors(df)
    assert sorted(r.doc_id for r in stay.collect()) == sorted({c for _, _, c in components(rows)})


def test_substring_dedup(spark, rows, block_bytes):
    starts: dict = {}
    split = [(BIG if i is None else i, WORD.findall(t or "")) for i, t, _ in rows]
    for i, w in split:
        for j in range(len(w) - 49):
            x = tuple(w[j : j + 50])
            starts[x] = min(starts.get(x, BIG + 1), i)
    want = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - 49):
            if starts[tuple(w[j : j + 50])] < i:
                gone |= set(range(j, j + 50))
        want.append((None if i == BIG else i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    found = substring_dedup.substring_dedup(odd(spark), block_bytes=block_bytes).collect()
    assert sorted(repr((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in found) == sorted(map(repr, want))
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(odd(spark), window=50, anchor=26)


def test_bpe(spark, rows, block_bytes):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = bpe.decode(bpe.encode(odd(spark), path, public_tokenizers.PATTERN, block_bytes=block_bytes), path).collect()
    want = [(i, coder.encode_ordinary(t or ""), (t or "").encode()) for i, t, _ in rows]
    assert sorted(repr((r.doc_id, list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)), bytes(r.decoded))) for r in found) == sorted(map(repr, want))
    assert all(r.n_tokens == len(r.ids) // 4 for r in found)
    again = bpe.encode(odd(spark), path, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))
    import random

    rng = random.Random(2)
    for n in (1, 2, 7, 63, 64, 65, 66, 300, 5000):
        for alphabet in ("ab", "a", "the andion ", "aé漢z0"):
            word = "".join(rng.choice(alphabet) for _ in range(n)).encode()
            assert bpe.merged(word, ranks) == coder._encode_single_piece(word), word


def test_steady_plans(spark, small):
    files = spark.read.parquet(f"{small}/documents.parquet")
    assert bpe.steady(files.where("doc_id > 3").select("doc_id", F.upper("text")))
    assert not bpe.steady(files.repartition(3)) and not bpe.steady(files.where(F.rand() > 0.5)) and not bpe.steady(files.orderBy("text"))


def test_pitman_yor_counts(spark, rows, block_bytes):
    import math

    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    words = [(i, [*WORD.findall((t or "").translate(LOW)), None]) for i, t, _ in rows]
    c: dict = {}
    for i, w in words:
        if not held(i):
            for x in w:
                c[x] = c.get(x, 0) + 1
    n, v = sum(c.values()), len(c)
    got = pitman_yor.score(odd(spark), block_bytes=block_bytes).collect()
    want = sorted((str(i), held(i), len(w), sum(x in c for x in w), n, round(sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w), 6)) for i, w in words)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(-1e6 < r.score < 0 for r in got)


def test_classifiers_on_odd_rows(spark, rows):
    found = language.identify(odd(spark))
    assert found.columns[: len(odd(spark).columns)] == odd(spark).columns and found.columns[-3:] == ["_held_out", "lang_pred", "_score"]
    for r in found.collect():
        assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in r.text or ""))
        assert r.lang_pred in ("und", "en", "de") and 0 <= r[-1] <= 1
        assert r._held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)
    kept = language.accepted(odd(spark))
    want = sorted((str(r.doc_id), r.lang_pred) for r in found.collect() if r.lang_pred != "und" and r[-1] >= language.FLOOR)
    assert kept.columns == odd(spark).columns and sorted((str(r.doc_id), r.lang) for r in kept.collect()) == want
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(20)] + [(None, 1, 0), (3, None, 0), (4, 0, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    scored = quality.classify(odd(spark), labels).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    assert {r.score for r in quality.classify(odd(spark), labels.limit(0)).collect()} == {0.5}


def test_language_stage_without_labels_and_with_other_scripts(spark):
    """Without labels only texts without a letter go; with them, so do texts in a script that was not learned."""
    letters = lambda t: any(ch.isalpha() for ch in t or "")
    docs = odd(spark).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(str(r.doc_id) for r in language.accepted(docs).collect()) == sorted(str(r[0]) for r in odd_rows() if letters(r[1]))
    text = {"en": "the quick brown fox jumps over the lazy dog near the river bank", "de": "der schnelle braune fuchs springt über den faulen hund am ufer"}
    rows = [(i, f"{text[lang]} {i}", lang) for i, lang in enumerate(["en", "de"] * 40)] + [(100, "Быстрая лиса прыгает через ленивую собаку", None), (101, "the fox jumps over the dog", None), (102, "123 456", "en")]
    kept = {r.doc_id: r.lang for r in language.accepted(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert set(kept) == {*range(80), 101} and kept[101] == "en" and all(kept[i] == x for i, _, x in rows[:80])


def brute_topk(vectors, queries, k):
    out = []
    fine = [(i, [int(np.floor(256 * float(v))) for v in x]) for i, x in vectors if x and all(v is not None and np.isfinite(v) for v in x)]
    for q in sorted({(i, tuple(x)) for i, x in fine if i is not None and i in queries}):
        scores = sorted((-sum(a * b for a, b in zip(q[1], x, strict=True)), i is None, i or 0) for i, x in fine if i != q[0] and len(x) == len(q[1]))
        out += [(q[0], r, None if null else i, -s) for r, (s, null, i) in enumerate(scores[:k], 1)]
    return out


@pytest.mark.parametrize("block", [2048, 2])
def test_topk(spark, block):
    rng = np.random.default_rng(3)
    hot = [float(x) for x in np.float32(rng.normal(size=6))]
    vectors = [(i, hot if i % 3 == 0 else [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(120)]
    vectors += [(200, None), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, []), (205, [1.0, 2.0]), (210, [3.0, -1.0]), (None, hot), (3, hot), (50, hot), (211, [1e4] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    wanted = df.where("vec_id % 10 = 0 OR vec_id = 205 OR vec_id > 205")
    got = [tuple(r) for r in topk.search(df, wanted, k=5, query_block=block).collect()]
    single = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x]) for i, x in vectors]
    ids = {i for i in range(0, 220) if i % 10 == 0 or i == 205 or i > 205}
    assert sorted(map(repr, got)) == sorted(map(repr, brute_topk(single, ids, 5)))


@pytest.mark.parametrize("large", [[1e7] * 4, [3e12, -3e12, 1.0, 0.5], [1e30, 1e30, 0.0, 0.0]])
def test_topk_of_large_components(spark, large):
    """Finite vectors take part however large they are; only a result beyond 64 bits is an error."""
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(100, large), (101, [0.0, 0.0, 1.0, 1.0]), (102, [-x for x in large])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    want = brute_topk(vectors, {i for i in range(0, 60, 10)} | {101}, 5)
    asked = "vec_id % 10 = 0 AND vec_id < 60 OR vec_id = 101"
    if any(abs(r[3]) >= 1 << 63 for r in want):
        with pytest.raises(Exception, match="64 bits"):
            topk.search(df, df.where("vec_id = 0"), k=5).collect()
        asked, want = "vec_id = 101", [r for r in want if r[0] == 101]
    else:
        assert {100, 102} & {r[2] for r in want}
    assert sorted(map(repr, (tuple(r) for r in topk.search(df, df.where(asked), k=5).collect()))) == sorted(map(repr, want))


def test_empty_tables(spark):
    docs = empty(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for df in (
        mixing.mix(docs), mixing.mixed(docs), sharding.shard(docs), exact_dedup.dedup(docs), exact_dedup.survivors(docs), jaccard.jaccard_join(docs), jaccard.survivors(docs), substring_dedup.substring_dedup(docs),
        bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path), pitman_yor.score(docs), language.identify(docs), quality.classify(docs, labels), topk.search(vectors, vectors),
    ):
        assert df.count() == 0


def test_stages_on_odd_and_empty_rows(spark):
    for make in (odd, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, "")
            assert got.columns == docs.columns, name
            got.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()


def test_jaccard_links_of_a_chain_and_a_triangle(spark):
    """One component each, told apart by links; a copy of a text counts as a document."""
    w = [f"w{i}" for i in range(80)]
    chain = [w[0:60], w[6:66], w[12:72]]
    triangle = [[f"t{x}" for x in w[a : a + 60]] for a in (0, 1, 2)]
    texts = [" ".join(x) for x in (*chain, chain[0], *triangle)] + ["alone in the world of these texts", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.jaccard_join(df, count_links=True).collect()}
    assert got == {0: (0, 2), 1: (0, 3), 2: (0, 1), 3: (0, 2), 4: (4, 2), 5: (4, 2), 6: (4, 2), 7: (7, 0), 8: (8, 0)}


def test_boilerplate_cluster_makes_no_tiles_of_strangers(spark, monkeypatch):
    """Many small groups chained into one cluster by common passages: sides that share no posting do not meet."""
    import random

    monkeypatch.setattr(jaccard, "TILE_BYTES", 6_000)
    rng = random.Random(8)
    texts = []
    for g in range(40):  # each text shares two thirds of the passage of its group and of the next one's: no links, but postings
        a, b = ([f"p{h}x{i}" for i in range(60)] for h in (g, g + 1))
        texts += [" ".join(a[:50] + b[:50]), " ".join(a[:50] + [f"u{rng.random()}" for _ in range(40)]), " ".join(a), " ".join([*a[:58], "y", "z"])]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    want = [sum(i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_links for r in jaccard.jaccard_join(df, count_links=True).orderBy("doc_id").collect()] == want
    held = spark.createDataFrame([(k, s) for k in range(99) for s in (k, k + 1)], "key long, side long")  # a chain of 100 sides
    tiles = jaccard.tiles_of(held).collect()
    assert len({r.tile for r in tiles if r.apart}) == 99 and len({r.tile for r in tiles if not r.apart}) == 100 == len(tiles) - 2 * 99


@pytest.mark.parametrize("tile", [1 << 23, 4_000])
def test_jaccard_links_equal_brute_force(spark, monkeypatch, tile):
    import random

    monkeypatch.setattr(jaccard, "TILE_BYTES", tile)
    rng = random.Random(6)
    texts = []
    for _ in range(90):
        w = [f"w{i}" for i in range(60)]
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"e{rng.randrange(9)}"
        texts.append(" ".join(w))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(56)} for t in texts]
    want = [sum(i != j and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_links for r in jaccard.jaccard_join(df, count_links=True).orderBy("doc_id").collect()] == want


@pytest.mark.parametrize("leaves", [0, 2500])
def test_rounds_of_components(spark, monkeypatch, leaves):
    """A chain, random edges and a node with very many: only for the last does the driver gather a table to broadcast."""
    import random

    from keystrand.llm import components as C

    rng = random.Random(11)
    names = rng.sample(range(-10_000, 10_000), 400 + leaves)  # the hub's is neither the smallest nor the largest
    edges = [(names[i], names[i + 1]) for i in range(60)] + [(names[rng.randrange(100, 400)], names[rng.randrange(100, 400)]) for _ in range(180)]
    edges += [(b, a) for a, b in edges[:20]] + [(names[70], names[400 + i]) for i in range(leaves)] + [(names[71], names[72])]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    plans, usual = [], C.written
    monkeypatch.setattr(C, "written", lambda df, *a: (plans.append(df._jdf.queryExecution().analyzed().toString()), usual(df, *a))[1])
    found = C.components(spark.createDataFrame(edges, "a long, b long"))
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root)
    assert len(plans) > 2 and any("broadcast" in p for p in plans) == (leaves > 0)

    plans.clear()
    stars = [tuple(r) for r in C.components(found.toDF("a", "b")).collect()]  # what is settled is written once, and takes no round
    assert sorted(stars) == sorted(got) and len(plans) == 1


@pytest.mark.parametrize("tile", [1 << 23, 4_000])
def test_clusters_in_one_tile_need_no_rounds(spark, monkeypatch, tile):
    """A tile has its components; only those of a cluster in several tiles are put together by rounds."""
    calls, usual = [], jaccard.components
    monkeypatch.setattr(jaccard, "TILE_BYTES", tile)
    monkeypatch.setattr(jaccard, "components", lambda edges: (calls.append(1), usual(edges))[1])
    # each text links to the next ones only, in no order of ids
    rows = [(i * 37 % 50, " ".join(f"w{j}" for j in range(i * 6, i * 6 + 60)), None) for i in range(50)] + [(50 + i, f"alone {i} in the world of texts", None) for i in range(9)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    for count_links in (False, True):
        calls.clear()
        assert sorted(tuple(r)[:3] for r in jaccard.jaccard_join(df, count_links=count_links).collect()) == sorted(components(rows))
        assert len(calls) == (1 if tile > 4_000 else 2)
