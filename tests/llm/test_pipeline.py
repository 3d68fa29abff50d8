"""The pipeline against a brute-force version, and each stage's effect."""

import base64
import hashlib
import re
import struct

import pandas as pd
import pytest
from test_odd_tables import WORD, components

import corpus_pipeline
from keystrand.llm.mixing import water_fill


def brute(frame: pd.DataFrame, coder) -> list[tuple]:
    rows = [(r.doc_id, r.text, r.source) for r in frame.itertuples() if r.text and any(ch.isalpha() for ch in r.text)]
    seen: dict = {}
    for i, t, s in sorted(rows):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t, s))
    rows = sorted(seen.values())
    rows = [r for r, c in zip(rows, components(rows), strict=True) if c[2] == r[0]]
    by: dict = {}
    for i, t, s in rows:
        by.setdefault(s, []).append((hashlib.md5(f"17:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, t))
    names = sorted(by)
    sizes = [sum(len(WORD.findall(t)) for _, _, t in by[s]) for s in names]
    taken = []
    for s, size, target in zip(names, sizes, water_fill(sizes, [1 + k % 3 for k in range(len(names))], sum(sizes), 3), strict=True):
        epochs, rest = divmod(min(round(target), 3 * size), size)
        for _, i, t in sorted(by[s]):
            n = len(WORD.findall(t))
            taken += [(i, t)] * (epochs + (n <= rest))
            if 0 < rest < n:
                end = list(WORD.finditer(t))[rest - 1].end()
                taken.append((i, t[:end]))
            rest = max(0, rest - n)
    return sorted((i, coder.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in taken)


@pytest.fixture(scope="module")
def coder():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_run_matches_brute_force(spark, small, coder):
    got = sorted((r.doc_id, list(struct.unpack(f"<{r.n_tokens}I", r.ids)), r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect())
    assert got == brute(pd.read_parquet(f"{small}/documents.parquet"), coder)


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "bpe"]
