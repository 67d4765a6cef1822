"""Text operators against brute force on small tables with nulls, ties, long and empty texts and clashing columns."""

import base64
import collections
import glob
import gzip
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isoframe.llm import decontam, html_main, ngram_join, packing, quality_model, quality_rules, queries, sharding, suffix_dedup, url_rules, warc
from isoframe.llm.common import WHITE, slices, text_bytes, word_spans
from isoframe.llm.components import connected
from isoframe.llm.textstats import Slice

RNG = np.random.default_rng(3)
WORDS = ["Aé", "bb", "c", "dd,", "Éx", "ff", "ggg", "h", "ii", "jj", "kk", "ll"]


def sentence(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(r.integers(40)) for k in r.integers(0, len(WORDS), n))


def texts():
    base, other = sentence(120, 1), sentence(300, 2)
    edited = base.split(" ")
    edited[60] = "changed"
    edges = [None, "", "   ", "\n\t", "one", "two words", "a a a a a a a a", "A b C d E", "a b c d e", "a b c d e f"]
    near = [" ".join(edited), base + " tail", base.upper() if base.isascii() else base, other, other[:900], other[300:1500] + " x", base, base]
    passages = [sentence(40, 10 + k) + "\n" + other[100:500] + "\n" + sentence(30, 30 + k) for k in range(4)]
    return edges + near + passages + [sentence(3000, 99), "word " * 400]


def frame(spark):
    rows = [(k if k != 5 else None, t, "en", f"s{k % 3}", 0, "x", 1.5) for k, t in enumerate(texts())]
    rows.append((7, texts()[7], "en", "s1", 0, "y", None))  # a repeated id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string, score double")


def empty(df):
    return df.where("doc_id < -1")


def test_words_and_slices():
    column = pa.array([None, "", " a", "b c\td ", "é\u00a0x", "y"])
    data, offsets = text_bytes(column)
    starts, ends, firsts = word_spans(data, offsets, WHITE)
    raw = data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == ["a", "b", "c", "d", "é\u00a0x", "y"]
    assert np.diff(firsts).tolist() == [0, 0, 1, 3, 1, 1]
    batch = pa.RecordBatch.from_arrays([pa.array(["aaaa", "b" * 50, "", "cc", None])], ["text"])
    assert [b.num_rows for b in slices(iter([batch]), "text", 6)] == [1, 1, 3]


def test_url_rules(spark):
    urls = ["http://A.Example.org/es/x", "https://example.org/en/12?q", "http://org", "http://x.com/fr/#/de/", "no url", None, "x://notexample.org/es/", "h://com/de/", "h://a.com/de/\n1", "h://example.org./es/"]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls * 2)] + [(None, "http://q.org/", "h")], "page_id long, url string, host string")
    rules = spark.createDataFrame(queries.URL_RULES, url_rules.RULES)

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [r for r in queries.URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        return host, path, best and best[0] + best[1], best[2] if best else "allow"

    for parts in (4000, 3):
        got = url_rules.match_rules(pages, rules, parts=parts).collect()
        want = sorted([(k, *judge(u)) for k, u in enumerate(urls * 2)], key=str)
        assert sorted([tuple(r) for r in got if r.page_id is not None], key=str) == want
        assert len(got) == 21
    assert url_rules.match_rules(pages.where("page_id < 0"), rules).count() == 0


def test_sharding_is_a_permutation(spark):
    df = frame(spark)
    got = sharding.assign_shards(df, shards=5).collect()
    n = df.count()
    assert sorted(r.position for r in got) == list(range(n))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    want = sorted((t[0] if t[0] is not None else -1, len((t[1] or "").encode()) + 16, zlib.crc32((t[1] or "").encode())) for t in df.select("doc_id", "text").collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32) for r in got) == want
    again = sharding.assign_shards(df.repartition(7), shards=5).collect()
    key = lambda r: (str(r.doc_id), r.text_crc32, r.position)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.assign_shards(empty(df)).count() == 0


def test_written_shards_hold_every_row(spark, tmp_path):
    df = frame(spark)
    sharding.write_shards(df, f"file://{tmp_path}/shards", shards=3, file_rows=4)
    got = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, df.collect()))
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.shard].append(r.slot)
    assert len(by) == 3 and all(sorted(v) == list(range(len(v))) for v in by.values())
    with pytest.raises(ValueError, match="already has"):
        sharding.write_shards(df.withColumn("slot", F.lit(1)), f"file://{tmp_path}/other")


def test_join_equals_brute_force(spark):
    df = frame(spark)
    rows = df.select("doc_id", "text").collect()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(r.text) for r in rows]
    for percent in (80, 60, 45):
        group = list(range(len(rows)))
        for _ in rows:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets):
                    if a and b and 100 * len(a & b) >= percent * len(a | b):
                        group[i] = group[j] = min(group[i], group[j])
        name = {g: min((rows[k].doc_id for k in range(len(rows)) if group[k] == g and rows[k].doc_id is not None), default=None) for g in group}
        want = sorted(((r.doc_id, len(s), name[g] if s else r.doc_id) for r, s, g in zip(rows, sets, group)), key=str)
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.components(df, percent).collect()), key=str) == want
    assert ngram_join.boundary(1.0, 80) == 4 and ngram_join.boundary(2.0, 80) == 14 and ngram_join.boundary(9.0, 50) == 0
    assert ngram_join.components(empty(df)).count() == 0


@pytest.mark.parametrize(("copies", "light", "bits"), [(1, 14, 20), (1, 14, 6), (2, 24, 20)])
def test_join_keeps_links_across_the_single_shingle_boundary(spark, copies, light, bits):
    """Sets too small for single-shingle lists link with larger light sets, at exact and at noisy counts."""
    listed, rows = -(-80 * (light + 1) // 100), []
    for k in range(24):
        n = listed - 1 - k % 3
        words = [f"g{k}w{j}" for j in range(n + 4)]
        rows.append(" ".join(words))
        rows.append(" ".join(words + [f"g{k}e{j}" for j in range(n // 4)]))
        rows.append(" ".join(words[1:] + [f"g{k}f{j}" for j in range(80)]))  # leaves one shingle of the others rare
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows * copies)], "doc_id long, text string")

    def shingles(text):
        words = text.split()
        return frozenset(zip(*[words[j:] for j in range(5)]))

    sets = [shingles(t) for t in rows]
    parent = list(range(len(rows)))

    def root(k):
        return k if parent[k] == k else root(parent[k])

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {k: root(k % len(rows)) for k in range(len(rows) * copies)}
    assert {x.doc_id: x.component_id for x in ngram_join.components(df, sketch_bits=bits, light=light).collect()} == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (95, 100)] + [(200, k) for k in range(201, 240)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and {got[k] for k in (90, 95, 100)} == {90} and {got[k] for k in range(200, 240)} == {200}


def test_main_text(spark):
    page = (
        '<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class="cookie-notice">We</div><article><header><h1>Head &amp; line</h1></header>'
        "<p>One <b>two</b>\n three<br>four<p>five &lt;six&gt; &nbsp; 7</p><aside>side</aside><script>var a='</p>';</script><form>f</form>"
        '<section class="comments"><p>no</p></section></article><footer>&copy; x</footer></body></html>'
    )
    plain = "<body><div>Menu A</div><div>Menu B</div><p>{}</p><div>End</div></body>"
    rows = [(1, "http://a.org/x", page), (2, "http://a.org/y/1", plain.format("first")), (3, "http://a.org/y/2", plain.format("second")), (4, None, None), (5, "bad", ""), (None, "http://b.org", "<p>only <i>one"), (6, "http://c.org/", "text < 3 & more &am")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_main.main_text(pages).collect()}
    assert got == {1: "Head & line\nOne two three four\nfive <six> 7", 2: "first", 3: "second", 4: "", 5: "", None: "only one", 6: "text < 3 & more &am"}
    assert html_main.main_text(pages.where("page_id > 99")).count() == 0


def test_lines_of_broken_markup():
    cases = {
        '<article><p>Intro</p><p class="notice">Cookies<p>Body one</p><p>Body two</p></article>': ["Intro", "Body one", "Body two"],
        '<article><ul><li>x<li class="share">Share<li>fact</ul><p>Body after</p></article>': ["x", "fact", "Body after"],
        '<article><div id="widget-theory">A</div><div class="search-algorithms">B</div><p class="comment-policy">C</p><ol class="comment-list">no</ol></article>': ["A", "B", "C"],
        '<article>T</article><div class="comments"><article><p>Reader</p></article></div><section id=comments><p>no</section>': ["T"],
        '<body><div class="ad">Ad<article><p>T</article></body>': ["T"],
        '<article><div class="page-header"><h1>H</h1></div><table><tr><td>1<td class="ad">2<td>3<tr><td>4</table><footer>f</footer></div></article>': ["H", "1", "3", "4"],
        "": [], "<p": [], "<!-- open": [], "a <b>b": ["a b"],
    }
    for page, lines in cases.items():
        assert html_main.text_lines(page)[0] == lines, page
    deep = "<div>" * 5000 + "x" + "<p>y" * 5000
    assert len(html_main.text_lines(deep)[0]) == 5001


def test_text_equals_brute_force(spark):
    r = np.random.default_rng(5)
    rows, near, least = [], 3, 2
    for k in range(140):
        host, path = f"h{min(k % 7, 3)}.org", f"/{'abc'[r.integers(3)]}/{r.integers(30)}"
        lines = [f"menu {path[:2]}", "menu all", *[f"line {r.integers(60)}" for _ in range(r.integers(0, 5))], "end"]
        body = "".join(f"<p>{x}" for x in lines)
        rows.append((k, f"http://{host}{path}?q={k}", f"<article>{body}</article><div>out</div>" if k % 5 == 0 else f"<nav>n</nav>{body}"))
    rows += [(900, rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2]), (901, "http://h2.org/z", rows[3][2]), (902, "http://alone.org/", "<p>one<p>two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("gone", F.lit("clash")).withColumn("host", F.lit(1))

    def longest(a, b):
        return html_main.shared_lines(a, b)

    sites: dict = {}
    parsed = []
    for i, url, page in rows:
        found, inside = html_main.text_lines(page)
        kept = tuple(x for x, y in zip(found, inside) if y or not any(inside))
        host, path = re.match(r"http://([^/]*)([^?]*)", url).groups()
        parsed.append((i, host, kept, any(inside)))
        at = (path, -1 if i is None else i)
        seen = sites.setdefault((host, any(inside)), {})
        seen[kept] = min(seen.get(kept, at), at)
    want = {}
    for i, host, kept, protected in parsed:
        order = sorted(sites[host, protected].items(), key=lambda x: x[1])
        here = next(k for k, x in enumerate(order) if x[0] == kept)
        path = order[here][1][0]
        prefix = lambda p: next((k for k in range(min(len(p), len(path))) if p[k] != path[k]), min(len(p), len(path)))
        others = sorted((-prefix(order[k][1][0]), abs(k - here), k < here, order[k][0]) for k in range(len(order)) if k != here and abs(k - here) <= near)
        found = [list(x[3]) for x in others[:near]]
        needed = near if protected else min(least, len(found))
        times = collections.Counter(j for x in found for j in longest(list(kept), x))
        gone = {j for j, n in times.items() if n >= needed} if len(found) >= needed and found else set()
        want[i] = "\n".join(x for j, x in enumerate(kept) if j not in gone)
    for block_rows in (1000, 5):
        table = pages.repartition(5)
        parsed_rows = html_main.main_text(table, near=near, least=least, block_rows=block_rows, broadcast_rows=0 if block_rows == 5 else 100)
        assert {x.page_id: x.text for x in parsed_rows.collect()} == want
    assert sum(bool(want[i]) and "menu" not in want[i] for i in want) > 50 and want[902] == "one\ntwo"


def test_longest_common_lines():
    long = np.random.default_rng(1).integers(0, 2, (2, 6000)).tolist()
    assert len(html_main.shared_lines(*long)) > 4000
    for seed in range(60):
        r = np.random.default_rng(seed)
        a, b = r.integers(0, 5, r.integers(0, 12)).tolist(), r.integers(0, 5, r.integers(0, 12)).tolist()
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        found = sorted(html_main.shared_lines(a, b))
        rest = iter(b)
        assert len(found) == best[-1, -1] and all(any(a[k] == y for y in rest) for k in found)


def test_decontamination_equals_brute_force(spark):
    df = frame(spark)
    items = [("b", texts()[13][50:400]), ("a", "TWO Words"), ("c", None), ("d", "..."), ("e", "word word word"), ("b2", texts()[13][50:400]), ("10", "a b c d e")]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("words", F.lit(1))
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))

    def judge(text):
        w, hit, ids = words(text), set(), set()
        for i, t in items:
            v = words(t)
            for s in range(max(len(v) - 12, 1) if v else 0):
                x = v[s : s + 13]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit.update(range(p, p + len(x)))
                        ids.add(i)
        return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)

    want = sorted((str(r.doc_id), *judge(r.text)) for r in df.select("doc_id", "text").collect())
    for limit in (200_000, 0):
        got = decontam.contamination(decontam.window_hits(df, bench, broadcast_rows=limit)).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in got) == want
    assert decontam.window_hits(df, bench.where("false")).where("size(hits) > 0").count() == 0
    assert decontam.window_hits(empty(df), bench).count() == 0


def test_statistics_equal_brute_force():
    column = [t or "" for t in texts()] + ["x #*\nx #*\n y\n\n y ", "a b a b a b", "w w w w"]
    s = Slice(*text_bytes(pa.array(column)))
    for k, t in enumerate(column):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
        assert s.n_words[k] == len(w) and s.word_chars()[k] == sum(map(len, w)) and s.symbols()[k] == len(re.findall(r"[#*$%&|<>]", t))
        assert s.duplicate_lines()[1][k] == len(lines) - len(set(lines)) and s.repeated_words(3)[k] == len(inside)
    assert np.isfinite(s.features()).all()


def test_quality_rules(spark):
    df = frame(spark)
    trusted = df.where("doc_id > 8").select("doc_id")
    for limit in (1000, 0):
        ratio = quality_rules.fit(df, trusted, bits=10, broadcast_rows=limit)
        raw, target = np.ones(1024), np.ones(1024)
        grams = {}
        for k, (i, t) in enumerate(df.select("doc_id", "text").collect()):
            s = Slice(*text_bytes(pa.array([t or ""])))
            grams[k] = quality_rules._ngrams(s, 10)[1]
            np.add.at(raw, grams[k], 1)
            np.add.at(target, grams[k] if i is not None and i > 8 else [], 1)
        want = np.log(target / target.sum()) - np.log(raw / raw.sum())
        assert np.allclose(ratio, want)
    rows = quality_rules.scored(df, ratio)
    got = quality_rules.judged(rows, -1.0).collect()
    assert np.allclose([r.score for r in got], [want[g].mean() if len(g) else 0 for g in grams.values()], atol=1e-5)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed and r.score >= -1.0) for r in got)
    assert quality_rules.scored(empty(df), quality_rules.fit(empty(df), df.select("doc_id"))).count() == 0
    assert quality_rules.bucket_bits(empty(df)) == 12 < quality_rules.bucket_bits(df.crossJoin(spark.range(300)))


def test_quality_threshold(spark):
    r = np.random.default_rng(2)
    rows = [(k, float(x), False) for k, x in enumerate(np.concatenate([r.normal(0, 1, 200), r.normal(9, 1, 300)]))] + [(900, -50.0, True), (None, 3.0, False)]
    scored = spark.createDataFrame(rows, "doc_id long, score double, base_failed boolean")
    labels = spark.createDataFrame([(k, int(k >= 200)) for k in range(500)] + [(0, None), (None, 1), (900, 1)], "doc_id long, quality int")
    cut = quality_rules.threshold(scored, labels)
    low, high = max(x for k, x, _ in rows[:200]), min(x for k, x, _ in rows[200:500])
    assert abs(cut - (low + high) / 2) < 0.02
    mixed = labels.withColumn("quality", F.when(F.col("doc_id") % 50 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert low < quality_rules.threshold(scored, mixed) < high
    assert quality_rules.threshold(scored, labels.where("quality = 1")) == high and quality_rules.threshold(scored, labels.where("quality = 0")) == float("-inf")
    assert quality_rules.threshold(scored, labels.where("false")) == float("-inf")


def test_quality_base_columns_equal_sql(spark, tmp_path):
    import duckdb

    df = frame(spark).where("doc_id IS NOT NULL AND doc_id <> 7")
    df.select("doc_id", "text").toPandas().to_parquet(tmp_path / "d.parquet")
    sql = rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM '{tmp_path}/d.parquet'),
    l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
    g AS (SELECT doc_id, s, array_to_string(w[s : s + 2], ' ') AS x FROM d, unnest(range(1, len(w) - 1)) AS u(s)),
    r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, x) AS c FROM g), unnest(range(s, s + 3)) AS u(p) WHERE c > 1 GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(dup.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
    FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN r USING (doc_id)"""
    want = duckdb.sql(sql).fetchall()
    got = quality_rules.scored(df, quality_rules.fit(df, df.select("doc_id"))).drop("score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_quality_model(spark):
    n = 300
    rows = [(k, sentence(80, k) if k % 2 else " | ".join(sentence(60, k).split(" ")), "en") for k in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(n)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = quality_model.score(df, quality_model.fit(df, labels)).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    odd = quality_model.score(frame(spark), quality_model.fit(df, labels)).collect()
    assert len(odd) == frame(spark).count() and all(0 <= r.score <= 1 for r in odd)
    none = quality_model.fit(df, labels.where("false"))
    assert {r.score for r in quality_model.score(df, none).collect()} == {0.5}
    assert quality_model.scored_rows(df, none).select("row.*").columns == df.columns


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\n", "same"), (3, None, None), (4, "u", ""), (5, "é", "x\r\n\r\ny"), (None, "n", "other"), (9, "z", "é" * 70000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit("clash"))
    folder = f"file://{tmp_path}/warc"
    index = warc.write_archives(warc.with_revisits(pages), folder)
    index.write.parquet(f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    got = {r.page_id: r for r in warc.read_archives(index, folder, gap=0).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("response", None), 9: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert got[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode() and got[i].payload_bytes == len(raw)
        assert got[i].payload == (raw if got[i].record_type == "response" else None)
    assert warc.read_archives(index.where("page_id IN (5, 9)"), folder).count() == 2
    assert b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/warc/*.gz")).count(b"WARC/1.1\r\n") >= len(rows)
    assert warc.with_revisits(pages, min_bytes=5).where("refers_to IS NOT NULL").count() == 0


def test_packing(spark):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = ["a  b\n c ", " lead", "x\u00a0y z", "x \u3000 y\u2003 z", "it's 's don't  n't", "<|endoftext|> a b<|endoftext|>c d", "1 2 3 ½ é É\r\n\r\n  k ", "\x7f a \x01 b"]
    df = frame(spark).unionByName(spark.createDataFrame([(1000 + k, t) for k, t in enumerate(odd)], "doc_id long, text string"), allowMissingColumns=True)
    got = packing.packed(df, P.path("byte_bpe_50k.json"), window=64, block_rows=40).collect()
    want = collections.Counter()
    for r in df.select("doc_id", "text").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        for s in range(0, len(ids), 64):
            x = np.array(ids[s : s + 64], "<u4")
            want[r.doc_id, s, len(x), zlib.crc32(x.tobytes()), len(ids), tuple(x.tolist())] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, tuple(r.ids)) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.concatenate([[0], np.cumsum([n for _, n in pieces])[:-1]]).tolist() and sum(n for _, n in pieces) <= 64
    assert packing.packed(empty(df), P.path("byte_bpe_50k.json")).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = -np.sort(-RNG.integers(1, 101, 2000))
    sequence, offset = packing.best_fit(lengths, 100)
    left: list[int] = []
    for k, n in enumerate(lengths.tolist()):
        fits = [x for x in left if x >= n]
        s = sequence[k]
        if fits:
            assert left[s] == min(fits)
        else:
            assert s == len(left)
            left.append(100)
        assert offset[k] == 100 - left[s]
        left[s] -= n


def test_repeats_equal_brute_force(spark):
    df = frame(spark)
    rows = df.select("doc_id", "text").collect()
    raw = [(r.text or "").encode() for r in rows]
    for length in (60, 200):
        seen = collections.Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
        want = []
        for r, b in zip(rows, raw):
            gone = np.zeros(len(b), bool)
            for k in range(len(b) - length + 1):
                if seen[b[k : k + length]] > 1:
                    gone[k : k + length] = True
            runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
            want.append((str(r.doc_id), len(b), runs, bytes(x for x, g in zip(b, gone) if not g)))
        got = suffix_dedup.remove_repeats(df, length).collect()
        assert sorted((str(r["row"].doc_id), r.n_bytes, len(r.spans), bytes(r.kept)) for r in got) == sorted(want)
    assert suffix_dedup.remove_repeats(empty(df)).count() == 0
    text = suffix_dedup.remove_repeats(df, as_text=True).select("row.*", "kept")
    assert text.columns == [c for c in df.columns if c != "text"] + ["kept"]
