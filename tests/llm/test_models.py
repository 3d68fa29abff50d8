"""Held-out quality of the trained operators."""

import tracemalloc
import zlib

import numpy as np
from pyspark.sql import functions as F

from keystrand.llm import language, pitman_yor, quality, queries

SMALL = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = queries.op5_quality(spark, SMALL).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([r.predicted for r in good]) > 0.97
    assert np.mean([r.predicted for r in bad]) < 0.1
    assert np.mean([[g.score > b.score for b in bad] for g in good]) > 0.97


def two_kinds(rng, n_p=3000, n_u=6000, share=0.6):
    positive = rng.normal(1.5, 1, (n_p, 4))
    mine = rng.random(n_u) < share
    return positive, np.where(mine[:, None], rng.normal(1.5, 1, (n_u, 4)), rng.normal(-1.5, 1, (n_u, 4))), mine


def test_risk_and_gradient_equal_sums_over_rows():
    """Risks from moments against the mean loss of each row, gradients against differences, and the fit against both."""
    rng = np.random.default_rng(0)
    positive, unlabelled, _ = two_kinds(rng, 200, 300)
    basis = quality.Basis(unlabelled.mean(axis=0), unlabelled.std(axis=0), ridges=5)
    phi_p, phi_u = basis(positive), basis(unlabelled)
    p, u = quality.moments(phi_p), quality.moments(phi_u)
    w = rng.normal(0, 1, phi_p.shape[1])
    for phi, m, y in ((phi_p, p, 1), (phi_p, p, -1), (phi_u, u, -1)):
        got, slope = quality.risk(w, m, y)
        assert abs(got - ((1 - y * phi @ w) ** 2 / 4).mean()) < 1e-9
        for i in range(len(w)):
            step = np.eye(len(w))[i] * 1e-5
            assert abs((quality.risk(w + step, m, y)[0] - quality.risk(w - step, m, y)[0]) / 2e-5 - slope[i]) < 1e-6
    whole = quality.together(quality.moments(phi_u[:100]), quality.moments(phi_u[100:]))
    assert np.allclose(whole.a, u.a) and np.allclose(whole.m, u.m) and whole.n == 300
    fit = quality.train(p, u, 0.6, steps=0)
    assert np.abs(0.6 * quality.risk(fit, p, 1)[1] - 0.6 * quality.risk(fit, p, -1)[1] + quality.risk(fit, u, -1)[1] + quality.penalty(p) @ fit / 2).max() < 1e-9


def test_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    positive, unlabelled, mine = two_kinds(rng)
    basis = quality.Basis(unlabelled.mean(axis=0), unlabelled.std(axis=0), ridges=20)
    p, u = quality.moments(basis(positive)), quality.moments(basis(unlabelled))
    f = basis(unlabelled) @ quality.train(p, u, 0.6)
    assert ((f > 0) == mine).mean() > 0.97
    few_p, few_u = quality.moments(basis(positive[:15])), quality.moments(basis(unlabelled[:40]))
    ridge = quality.SHRINK
    try:
        quality.SHRINK = 0.0
        negative = lambda w: quality.risk(w, few_u, -1)[0] - 0.9 * quality.risk(w, few_p, -1)[0]
        start, end = (negative(quality.train(few_p, few_u, 0.9, steps=n)) for n in (0, 2000))
        assert start < -0.01 and end > start / 10  # overfit at first, then brought back
    finally:
        quality.SHRINK = ridge


def test_prior_is_estimated_from_positives_and_unlabelled_text():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.85):
        positive, unlabelled, _ = two_kinds(rng, 4000, 8000, share)
        at = np.linspace(-6, 6, 400)
        above = lambda x: (x.sum(axis=1)[None, :] / 4 >= at[:, None]).mean(axis=1)
        assert abs(quality.prior_of(above(unlabelled), above(positive), 8000, 4000) - share) < 0.04


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.op9_language(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(rows) > 200 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


def test_kernel_scores_equal_the_product_with_landmarks():
    texts = ["the cat sat on the mat", "der hund liegt im garten", "a dog ran to the door", "die katze schläft hier", "on the road", "im wald und auf der heide"]
    model = language.fit(texts, ["en", "de"] * 3)
    grams = language.Grams()
    sets = [set(grams(t).tolist()) for t in texts]
    assert len(sets[0]) == len({t for n in range(1, 5) for t in [texts[0][i : i + n] for i in range(len(texts[0]) - n + 1)]})
    scored, known = model.scorer()(texts)
    assert np.allclose(known, 1)
    assert [model.languages[k] for k in scored.argmax(axis=1)] == ["en", "de"] * 3
    assert np.allclose(scored[0], model.scorer()(["THE CAT sat on the mat"])[0][0])


def test_regression_equals_kernel_ridge_by_hand():
    """Nyström features and their regression against the normal equations in the kernel matrices, over sets of n-grams."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["der", "die", "und", "haus"] if k % 2 else ["the", "and", "of", "house"], 6)) + f" {k}" for k in range(30)]
    labels = ["de" if k % 2 else "en" for k in range(30)]
    grams = lambda t: {t.encode()[i : i + n] for n in range(1, 5) for i in range(len(t.encode()) - n + 1)}
    kernel = lambda a, b: np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in map(grams, b)] for x in map(grams, a)])
    model = language.fit(texts, labels, landmarks=8)
    marks = [texts[i] for i in language.chosen(labels, 8)]
    k, own, x = kernel(texts, marks), kernel(marks, marks), kernel(["the house of haus", "und die"], marks)
    for j, lang in enumerate(model.languages):
        y = np.array([1.0 if z == lang else -1.0 for z in labels])
        both = np.concatenate((k, np.ones((30, 1))), axis=1)
        ridge = np.zeros((9, 9))
        ridge[:8, :8] = language.RIDGE * own
        a = np.linalg.solve(both.T @ both + ridge, both.T @ y)  # as many texts of either language: the weights are 1
        got = model.scorer()(["the house of haus", "und die"])[0][:, j]
        assert np.allclose(got, x @ a[:8] + a[8], atol=1e-4)


def test_grams_do_not_depend_on_pieces():
    grams = language.Grams()
    text = "the quick brown fox jumps over the lazy dog " * 7
    assert set(grams(text).tolist()) == set(grams(text, piece=10).tolist())


def test_model_beats_the_base_on_held_out_text(spark):
    row = queries.op6_pitman_yor(spark, SMALL).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert row.s > row.b


def test_table_counts_follow_their_law():
    """Draws against the exact law of a Chinese restaurant's tables, for one word with 6 customers."""
    d, x, n = 0.6, 0.4, 6
    law = np.exp(pitman_yor.stirling(d)[n, 1 : n + 1] + np.log(x) * np.arange(1, n + 1))
    rng = np.random.default_rng(1)
    drawn = pitman_yor.seat(np.full(40_000, n), np.full(40_000, x), d, pitman_yor.stirling(d), rng)
    assert np.abs(np.bincount(drawn, minlength=n + 1)[1:] / 40_000 - law / law.sum()).max() < 0.01
    for x, n in ((0.01, 300), (3.0, 300), (30.0, 300), (300.0, 900)):  # above the table, against the exact mean and deviation
        t = np.arange(1, n + 1)
        law = pitman_yor.stirling(d, n)[n, 1:] + np.log(x) * t
        law = np.exp(law - law.max()) / np.exp(law - law.max()).sum()
        mean, sd = (law * t).sum(), ((law * t * t).sum() - (law * t).sum() ** 2) ** 0.5
        drawn = pitman_yor.seat(np.full(4000, n), np.full(4000, x), d, pitman_yor.stirling(d), rng)
        assert abs(drawn.mean() - mean) < 0.02 * mean and abs(drawn.std() - sd) < 0.1 * sd + 0.02


def test_probabilities_add_up_to_one():
    """With fixed totals of one owner, predictive probabilities of all words and the unknown one."""
    rng = np.random.default_rng(2)
    words, contexts = 30, 3
    pairs = np.sort(rng.choice(words * contexts, 50, replace=False))
    own = pitman_yor.Owned(0, np.arange(words, dtype=np.uint64), pairs // contexts, pairs % contexts, rng.integers(1, 90, 50))
    customers = np.bincount(own.context, weights=own.count, minlength=contexts)
    start = pitman_yor.Totals(0.7, 0.5, words, customers, np.bincount(own.context, minlength=contexts).astype(float), 50, words)
    (tables, served, at_parent), = pitman_yor.sweeps(own, [start], 1)
    totals = np.bincount(own.context, weights=tables, minlength=contexts)
    new = (pitman_yor.STRENGTH + 0.5 * at_parent.sum()) / (words + 1)
    share = np.append(served - 0.5 * at_parent, 0) + new
    share /= pitman_yor.STRENGTH + served.sum()
    assert abs(share.sum() - 1) < 1e-9
    for c in range(contexts):
        p = (pitman_yor.STRENGTH + 0.7 * totals[c]) * share
        mine = own.context == c
        p[own.word[mine]] += own.count[mine] - 0.7 * tables[mine]
        assert abs(p.sum() / (pitman_yor.STRENGTH + customers[c]) - 1) < 1e-9


def test_an_owner_unpacks_its_requests_one_at_a_time():
    """Counts and probabilities of an owner against dictionaries, and the peak of its memory in bytes a pair that is asked for (to merge, 39; 68 when all requests were unpacked at once)."""
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, 1500).astype(np.uint64))
    keys, bounds, extras, asked_for, counted = [], [0], [], [], np.zeros(len(hashes) ** 2, np.int64)
    for _ in range(30):
        code = np.sort(rng.choice(len(hashes) ** 2, 30_000, replace=False))
        count = rng.integers(0, 3, len(code)).astype(np.uint32)
        words, of_word = np.unique(code // len(hashes), return_counts=True)
        pairs = pitman_yor.Pairs(hashes, np.bincount(code // len(hashes), minlength=len(hashes)), code % len(hashes), None, None)
        extras.append(pitman_yor._packed(pairs._replace(of_word=of_word), count, np.concatenate(([0], np.cumsum(of_word))), 0, len(words)))
        keys.append(hashes[words])
        bounds.append(bounds[-1] + len(words))
        asked_for.append(code)
        counted[code] += count
    keys, bounds, total = np.concatenate(keys), np.array(bounds), sum(map(len, asked_for))
    tracemalloc.start()
    asked = pitman_yor.unpacked(extras)
    own = pitman_yor.merged(0, keys, asked, bounds)
    merging = tracemalloc.get_traced_memory()[1] / total
    place = lambda x: np.searchsorted(hashes, x)
    assert np.array_equal(place(own.keys)[own.word] * len(hashes) + place(own.contexts)[own.context], np.flatnonzero(counted))
    assert np.array_equal(own.count, counted[counted > 0])
    for piece in (1 << 10, 1 << 30):
        assert all(np.array_equal(x, y) for x, y in zip(own, pitman_yor.merged(0, keys, asked, bounds, piece), strict=True))
    contexts = len(own.contexts)
    totals = pitman_yor.Totals(0.7, 0.5, len(own.keys), np.bincount(own.context, weights=own.count, minlength=contexts), np.bincount(own.context, minlength=contexts).astype(float), len(own.count), len(own.keys))
    kept = [pitman_yor.Sample(totals, *x) for x in pitman_yor.sweeps(own, [totals] * 2, 1)]
    tracemalloc.reset_peak()
    held = tracemalloc.get_traced_memory()[0]
    found = list(pitman_yor.answers_of(own, keys, asked, bounds, kept))
    answering = (tracemalloc.get_traced_memory()[1] - held) / total
    tracemalloc.stop()
    assert merging < 50 and answering < 20
    at = {(w, c): i for i, (w, c) in enumerate(zip(own.keys[own.word].tolist(), own.contexts[own.context].tolist(), strict=True))}
    word_of, context_of = ({x: i for i, x in enumerate(y.tolist())} for y in (own.keys, own.contexts))
    for blob, code in list(zip(found, asked_for, strict=True))[:2]:
        _, logs = pitman_yor._arrays(blob, np.uint32, np.float32)
        for pair, got in list(zip(code.tolist(), logs.tolist(), strict=True))[:300]:
            w, c = int(hashes[pair // len(hashes)]), int(hashes[pair % len(hashes)])
            mean = 0.0
            for t, tables, served, at_parent in kept:
                share = (1 + 0.5 * t.parent_tables) / (t.vocabulary + 1) + (served[word_of[w]] - 0.5 * at_parent[word_of[w]] if w in word_of else 0)
                p = (1 + 0.7 * t.tables[context_of[c]]) * share / (1 + t.parent_customers)
                p += own.count[at[w, c]] - 0.7 * tables[at[w, c]] if (w, c) in at else 0
                mean += p / (1 + t.customers[context_of[c]]) / len(kept)
            assert abs(got - np.log10(mean)) < 1e-5


def test_sweeps_go_on_from_seats():
    rng = np.random.default_rng(4)
    pairs = np.sort(rng.choice(600, 200, replace=False))
    known, word = np.unique(pairs // 20, return_inverse=True)
    own = pitman_yor.Owned(3, known.astype(np.uint64), word, pairs % 20, rng.integers(1, 90, 200))
    customers = np.bincount(own.context, weights=own.count, minlength=20)
    history = [pitman_yor.Totals(0.7, 0.5, len(known), customers, np.bincount(own.context, minlength=20) * float(k), 50 * k, len(known)) for k in range(1, 5)]
    start = None
    for k, whole in enumerate(pitman_yor.sweeps(own, history, 1)):
        (step,) = pitman_yor.sweeps(own, history[k : k + 1], 1, k, start)
        assert all(np.array_equal(x, y) for x, y in zip(whole, step, strict=True))
        start = step[0], step[2]


def test_every_context_word_has_a_restaurant(spark):
    """6,000 words, each followed by its own: held-out text with the right followers beats text with others', for all of them."""
    words = 6000
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    ids = [i for i in range(200_000) if not held(i)][: 4 * words]
    asked = [i for i in range(200_000) if held(i)][: 2 * words]
    rows = [(i, f"a{k % words} b{k % words}") for k, i in enumerate(ids)]
    rows += [(i, f"a{k % words} b{(k + k // words) % words}") for k, i in enumerate(asked)]
    found = {r.doc_id: r for r in pitman_yor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_bytes=20_000).collect()}
    assert all(found[i].held_out for i in asked) and {found[i].train_tokens for i in ids} == {12 * words}
    gain = np.array([found[a].score - found[b].score for a, b in zip(asked[:words], asked[words:], strict=True)])
    assert gain.min() > 1
