"""Clusters, audits and token counts against plain loops; and the cases that hashes, repeated ids, long texts and long rows make hard."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoframe.llm import clustering, common, decontam, filter_audit, ngram_join, packing, quality_model, quality_rules, queries, sharding, suffix_dedup, token_counts, url_rules, warc

P = pytest.importorskip("public_tokenizers")


def mirrored(n):
    """Two words of n letters whose polynomial hashes modulo a power of two agree."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n], word[:n].translate(str.maketrans("ab", "ba"))


def test_hashes_are_those_of_a_polynomial_over_the_field():
    raw = np.frombuffer(b"hello wide hello world" * 3000, np.uint8)
    sums, prime = common.prefix_hash(raw), 2**61 - 1
    for s, e in ((0, 5), (11, 16), (20_000, 20_040), (5, 5)):
        want = sum(int(common._BYTE_CODE[v]) * pow(common._BASE, k, prime) for k, v in enumerate(raw[s:e])) % prime
        got = common._product(common._reduced(sums[[e]] + (common._PRIME - sums[[s]])), common._powers["down"][[s]])
        assert int(got[0]) == want
    order, by_gram, whole = common.gram_order(raw, 33), {}, bytes(raw)
    assert len(order) == len(raw) - 32 and all(by_gram.setdefault(whole[k : k + 33], v) == v for k, v in enumerate(order.tolist()))
    assert len(set(by_gram.values())) == len(by_gram) and (common.gram_order(raw[7:], 33) == order[7:]).all()
    assert len(common.gram_order(raw[:32], 33)) == 0 and len(common.gram_order(raw[:33], 33)) == 1
    one, two = (np.frombuffer(w.encode(), np.uint8) for w in mirrored(4096))
    both = np.concatenate([one, two, one])
    ends = np.array([4096, 8192, 12288])
    for h in (common.span_hash(common.prefix_hash(both), ends - 4096, ends), common.apart_hash(both, ends - 4096, ends)):
        assert h[0] == h[2] != h[1]
    spans = np.array([0, 3, 9]), np.array([3, 9, 9])
    assert common.same_bytes(raw, *spans, raw, *spans).all()
    assert common.same_bytes(both, ends - 4096, ends, both, np.zeros(3, int), np.full(3, 4096)).tolist() == [True, False, True]


def test_long_words_lines_and_chunks_are_told_apart(spark):
    from tokenizers import Tokenizer

    one, two = mirrored(2048)
    texts = [one, two, f"{one} x", f"q {one} z", f"q {two} z", f"{one}\n{two}\n{one}", f"{one}\n{two}", f"{two} {one} {two} {one} w"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in ngram_join.components(df).collect()}
    assert got == {k: k for k in range(len(texts))} | {6: 6}
    base = {r.doc_id: (r.n_dup_lines, r.n_repeat_words) for r in quality_rules.scored(df, np.zeros(1 << 12)).collect()}
    assert base[5] == (1, 0) and base[6] == (0, 0) and base[7] == (0, 0)
    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: r.ids for r in packing.token_pieces(df, P.path("byte_bpe_50k.json"), window=1 << 20).collect()}
    assert ids == {k: [*plain.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}


def test_chunks_of_one_hash_are_encoded_apart(monkeypatch):
    from tokenizers import Tokenizer

    real = packing.apart_hash
    monkeypatch.setattr(packing, "apart_hash", lambda *x: real(*x) % np.uint64(5))
    plain, encoder = Tokenizer.from_file(P.path("byte_bpe_50k.json")), packing.ChunkEncoder(P.path("byte_bpe_50k.json"), limit=3)
    for texts in (["one two three four five six", None, " lead", "one two"], ["seven two  eight", "é one"], ["six five four"] * 3):
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_one_record_of_a_payload_is_stored(spark, tmp_path):
    rows = [(1, "a", "p"), (None, "b", "p"), (7, "c", "p"), (7, "c", "p"), (None, "x", "q"), (None, "x", "q"), (None, None, "q"), (3, "z", "alone"), (4, None, None), (5, "é", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = f"file://{tmp_path}/warc"
    warc.write_archives(warc.with_revisits(pages.coalesce(2)), folder).write.parquet(f"file://{tmp_path}/index")
    got = warc.read_archives(spark.read.parquet(f"file://{tmp_path}/index"), folder).collect()
    of = lambda payload: sorted(((r.record_type, r.page_id, r.refers_to) for r in got if r.payload_digest == warc.digest32(payload)), key=str)
    assert of(b"p") == sorted([("response", 7, None), ("revisit", 1, 7), ("revisit", 7, 7), ("revisit", None, 7)], key=str)
    assert of(b"q") == [("response", None, None), ("revisit", None, None), ("revisit", None, None)]
    assert of(b"") == [("response", 5, None), ("revisit", 4, 5)] and of(b"alone") == [("response", 3, None)]


def test_segments_of_a_long_text_give_the_same_anchors():
    r = np.random.default_rng(5)
    base = r.integers(97, 100, 3000).astype(np.uint8)
    data = np.concatenate([base, base[500:1700], r.integers(97, 123, 900).astype(np.uint8), base[:40]])
    offsets = np.array([0, 0, 3000, 5100, 5140, len(data)])
    for length in (60, 200):
        whole = suffix_dedup.anchors(data, offsets, length)
        for segment in (17, 256, 1001):
            assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors(data, offsets, length, segment), strict=True))
    assert all(len(x) == 0 for x in suffix_dedup.anchors(data[:0], np.zeros(3, int), 200))


def test_a_text_of_many_segments_loses_its_repeats(spark):
    r = np.random.default_rng(6)
    body = "".join(chr(x) for x in r.integers(97, 123, 2_300_000))
    passage = "".join(chr(x) for x in r.integers(97, 123, 260))
    long = body[: (1 << 20) - 130] + passage + body[(1 << 20) - 130 :] + passage[:200]
    df = spark.createDataFrame([(1, long), (2, "x" + passage[60:] + "y"), (3, None), (4, "short")], "doc_id long, text string")
    got = {x["row"].doc_id: (x.n_bytes, [tuple(s) for s in x.spans], bytes(x.kept)) for x in suffix_dedup.remove_repeats(df).collect()}
    at = (1 << 20) - 130
    assert got[1] == (len(long), [(at, at + 260), (len(long) - 200, len(long))], body.encode())
    assert got[2] == (202, [(1, 201)], b"xy") and got[3] == (0, [], b"") and got[4] == (5, [], b"short")


def clusters_by_loop(rows, k=8, rounds=10):
    kept = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes())
    points = [v for _, v in sorted(kept, key=key)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, p), n) for n, p in enumerate(points))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        points = [tuple(sum(c) // len(own) for c in zip(*own)) if (own := [v for (_, v), o in zip(kept, of) if o == n]) else p for n, p in enumerate(points)]
    last = [(i, *near(v)[::-1]) for i, v in kept]
    total = {n: sum(d for _, m, d in last if m == n) for n in range(len(points))}
    return sorted(((i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, points[n])).encode()).hexdigest()) for i, n, d in last), key=str)


def test_clusters_equal_the_loop(spark):
    r = np.random.default_rng(8)
    centres = r.normal(0, 2, (5, 64))
    rows = [(k, (centres[k % 5] + r.normal(0, 1, 64)).astype(np.float32).tolist()) for k in range(150)]
    rows += [(k, rows[3][1]) for k in (3, 500, 501)] + [(600 + k, [float(k % 2)] * 64) for k in range(6)]
    rows += [(700, None), (701, [1.0] * 63), (702, [float("nan")] * 64), (703, [float("inf")] + [0.0] * 63), (704, [None] + [0.0] * 63), (705, []), (None, [0.5] * 64), (None, [-0.001] * 64)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<float>, cluster string").repartition(4)
    assert sorted(map(tuple, clustering.cluster(df).collect()), key=str) == clusters_by_loop(rows)
    few = df.where("vec_id IN (3, 600, 601)")
    assert sorted(map(tuple, clustering.cluster(few).collect()), key=str) == clusters_by_loop([x for x in rows if x[0] in (3, 600, 601)])
    assert clustering.cluster(df.where("vec_id = 700")).count() == clustering.cluster(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="must be below"):
        clustering.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")).count()


def test_the_search_leaves_out_distances_and_keeps_ties():
    r = np.random.default_rng(9)
    points = np.array(sorted({tuple(x) for x in r.integers(-3, 4, (40, 3)).tolist()}) * 2, np.int64)
    vectors = np.concatenate([r.integers(-5, 6, (400, 3)), points])
    best, distance, taken = clustering.Centroids(points).nearest(vectors)
    every = ((vectors[:, None] - points[None]) ** 2).sum(2)
    assert (distance == every.min(1)).all() and (best == every.argmin(1)).all()
    assert taken < len(vectors) * len(points) * 0.8
    assert clustering.Centroids(points[:1]).nearest(vectors)[0].max() == 0


def test_audit_equals_the_loop(spark):
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words[:250]), " ".join(words[:199]), "a b " * 120, "A" * 30 + " " + " ".join(words[:240]), " ".join(words) + " #", "x | y", "", None, "ÉA b", " one two", "w " * 99 + "v " * 101, " ".join(words[:250])]
    rows = [(k, t, lang) for k, (t, lang) in enumerate(zip(texts * 3, itertools.cycle(["en", "de", None, "", "en"])))] + [(None, texts[0], "en"), (0, texts[0], "en"), (0, texts[0], "de"), (99, texts[0], "xx")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(20)] + [(1, 0, 1), (None, 1, 1), (99, None, 1)]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, lang string, part string, fails int").repartition(3)
    got = sorted(map(tuple, filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()))

    def fails(i, text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [j for j, t, _ in rows if (t or "") == text and j is not None]
        return (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and min(same) < i)

    facts = [(lang or "", fails(i, t), any(j == i and i is not None and q == 1 for j, q, _ in labels), any(j == i and i is not None and x == 1 for j, _, x in labels)) for i, t, lang in rows]
    want = []
    for part in sorted({x[0] for x in facts}):
        own, told = [x[1:] for x in facts if x[0] == part], []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order):
                f = "ABCDE".index(letter)
                out = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                told.append(("".join(order), step + 1, len(left), len(out), sum(x[0][f] for x in own) - len(out), sum(x[0][f] and sum(x[0]) == 1 for x in own), sum(x[1] for x in out), sum(x[2] for x in out)))
        total = {c: sum(x[3] for x in told if x[0][x[1] - 1] == c) for c in "ABCDE"}
        want += [(part, *x, total[x[0][x[1] - 1]]) for x in told]
    assert got == sorted(want)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    long = (" ".join(words[:7]) + "\t") * 60_000
    assert filter_audit._word_counts(memoryview(long.encode()), piece=1000) == (420_000, 7) and filter_audit._word_counts(memoryview(b"z" * 5000), piece=1000) == (1, 1)


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = np.random.default_rng(10)
    bits = ["hello world ", "  two  spaces ", "\n\n", "日本語の文章です。", "<s> </s> <unk> <0x0A> ", "▁▁ x ", "é", "\t", "a" * 50, "🙂🙃", "1234567890 ", "naïve café ", "　", "\x00", " "]
    texts = [None, "", " ", "  ", "a", *("".join(bits[k] for k in r.integers(0, len(bits), n)) for n in (1, 2, 5, 20, 100, 400) for _ in range(6))]
    counter = token_counts.PieceCounter(path, part_bytes=7, batch_bytes=100)
    assert counter.cuts and counter.counts(t or "" for t in texts) == [len(model.encode(t or "")) for t in texts]
    assert any(len(list(counter.parts(t))) > 20 for t in texts if t) and all("".join(counter.parts(t)) == t for t in texts if t)
    long = "".join(bits[k] for k in r.integers(0, len(bits), 30_000))
    rows = [*enumerate(texts), (None, "x y"), (3, "  "), (5000, long), (5001, "z" * 3000), (5002, "word " * 4096)]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, n_tokens string").repartition(3)
    got = sorted(map(tuple, token_counts.token_counts(df, path).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 4096) for i, t in rows), key=str)
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def naive_boost(x, y, trees, depth, rate, bins, ridge):
    """Histogram boosting row by row: returns the margins that the trees give the rows they are fitted on."""
    n = len(x)
    positive = (sum(y) + 1) / (n + 2)
    margin = [math.log(positive / (1 - positive))] * n
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in np.array(x).T]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [b - a for a, b in zip(p, y)], [max(a * (1 - a), 1e-12) for a in p]

        def grow(rows, level):
            if level == depth:
                step = rate * sum(g[k] for k in rows) / (sum(h[k] for k in rows) + ridge)
                for k in rows:
                    margin[k] += step
                return
            all_g, all_h, best, chosen = sum(g[k] for k in rows), sum(h[k] for k in rows), 0.0, None
            for f, q in enumerate(cuts):
                gains = []
                for c in q:
                    a, b = sum(g[k] for k in rows if x[k][f] <= c), sum(h[k] for k in rows if x[k][f] <= c)
                    gains.append(a * a / (b + ridge) + (all_g - a) ** 2 / (all_h - b + ridge) - all_g**2 / (all_h + ridge))
                if gains and max(gains) > best + 1e-9:
                    best, chosen = max(gains), (f, q[int(np.argmax(np.round(gains, 12)))])
            left = [k for k in rows if chosen is None or x[k][chosen[0]] <= chosen[1]]
            right = [k for k in rows if chosen is not None and x[k][chosen[0]] > chosen[1]]
            grow(left, level + 1)
            if right:
                grow(right, level + 1)

        grow(list(range(n)), 0)
    return [1 / (1 + math.exp(-m)) for m in margin]


def test_boosted_trees_equal_a_plain_fit_and_walk():
    r = np.random.default_rng(12)
    x = np.round(r.normal(size=(90, 4)), 3)
    x[:, 3] = 1.0
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(0, 0.3, 90) > 0).astype(float)
    model = quality_model.boost(x, y, trees=6, depth=3, bins=8)
    assert np.allclose(model.scores(x), naive_boost(x.tolist(), y.tolist(), 6, 3, 0.2, 8, 1.0), atol=1e-9)

    def walk(row):
        out = model.base
        for feature, split, leaf in zip(model.feature, model.split, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > split[node])
            out += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-out))

    fresh = r.normal(size=(200, 4))
    assert np.allclose(model.scores(fresh), [walk(v) for v in fresh], atol=1e-12)
    assert quality_model.boost(x, np.ones(90)).scores(x).tolist() == pytest.approx([91 / 92] * 90)


def test_very_long_texts_are_scored_whole(spark):
    long = "word " * 300_000 + "\n" + "x" * 100_000
    df = spark.createDataFrame([(1, long), (2, "short text"), (None, None)], "doc_id long, text string")
    base = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.scored(df, np.zeros(1 << 12)).collect()}
    assert base == {1: (300_001, 300_000), 2: (2, 0), None: (0, 0)}
    model = quality_model.boost(np.zeros((0, 1)), np.zeros(0))
    assert quality_model.score(df, model).count() == 3
    pieces = packing.token_pieces(df, P.path("byte_bpe_50k.json")).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert all(r.n == r.t for r in pieces) and zlib.crc32(b"\0\0\0\0") in {r.ids_crc32 for r in packing.token_pieces(df, P.path("byte_bpe_50k.json")).where("doc_id IS NULL").collect()}


def test_long_urls_identical_rows_and_items_without_ids(spark):
    long = "http://a.example.org/es/" + "x/" * 100_000 + "?" + "q" * 100_000
    got = url_rules.match_rules(spark.createDataFrame([(1, long), (2, "http://" + "s." * 50_000 + "com/de/")], "page_id long, url string"), spark.createDataFrame(queries.URL_RULES, url_rules.RULES)).collect()
    assert {r.page_id: (r.rule, r.verdict, len(r.path)) for r in got} == {1: ("example.org/es/", "block", 200_004), 2: ("com/de/", "block", 4)}

    same = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    placed = sharding.assign_shards(same, shards=7).collect()
    assert sorted(r.position for r in placed) == list(range(3000)) and {r.slot for r in placed if r.shard == 3} == set(range(sum(r.shard == 3 for r in placed)))

    words = [f"w{k}" for k in range(30)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[5:18])), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(words[5:18])), (4, " ".join(words[:14])), (4, None)], "item_id long, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontam.contamination(decontam.window_hits(docs, items)).collect()}
    assert hits == {1: (30, 18, ["4"], True), 2: (13, 13, [], True), 3: (0, 0, [], False)}
