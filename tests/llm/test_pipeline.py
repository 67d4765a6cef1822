"""The pipeline stage by stage against brute force over the smallest given tables."""

import collections
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from isoframe.llm import quality_model
from isoframe.llm.common import text_bytes, written
from isoframe.llm.textstats import Slice

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeats", "benchmark_text", "sequences"]
    step = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, DATA), f"test-{name}")
        step[name] = now
        if name != "sequences":
            assert now.columns == docs.columns

    before, good = texts(docs), texts(step["quality"])
    model = quality_model.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    ids = list(before)
    scores = model.scores(Slice(*text_bytes(pa.array([before[i] for i in ids]))).features())
    assert set(good) == {i for i, s in zip(ids, scores) if s >= 0.5}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(labels.get(i, 1) == 1 for i in good)

    sets = {i: shingles(t) for i, t in good.items()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    single = texts(step["near_duplicates"])
    assert single == {i: t for i, t in good.items() if root[i] == i}

    raw = {i: t.encode() for i, t in single.items()}
    seen = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    rest = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        rest[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    cut = texts(step["repeats"])
    assert cut == rest and {r.doc_id: r.n_chars for r in step["repeats"].collect()} == {i: len(t) for i, t in rest.items()}

    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        v = words(r.text)
        windows |= {tuple(v[s : s + 13]) for s in range(max(len(v) - 12, 1))} if v else set()
    clean = set()
    for i, t in rest.items():
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
        if not (hit and 20 * len(hit) >= len(w)):
            clean.add(i)
    assert set(texts(step["benchmark_text"])) == clean

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    filled = collections.Counter()
    for r in step["sequences"].collect():
        got[r.doc_id].append((r.start, list(r.ids)))
        filled[r.sequence_id] += r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i in clean:
        ids = [x for _, part in sorted(got[i]) for x in part]
        assert ids == plain.encode(rest[i], add_special_tokens=False).ids + [0]
    assert set(got) == clean and max(filled.values()) <= 1024
