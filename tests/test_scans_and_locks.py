"""Scans in splits, running counts, state scans, selections, locks and checked documents against plain loops."""

import gzip
import hashlib
import itertools
import random
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoframe.operators import catalogue, censored, fingerprints, follow_up, ledger, linked, reports, running, selection
from isoframe.operators.components import connected
from isoframe.sources import documents, tables, variant_text, vcf
from isoframe.sources.scratch import shared_path, stored
from isoframe.streaming import intake


def blocks(text: bytes, size: int) -> bytes:
    """Text as gzip members that hold their sizes, with the empty one at the end."""
    out = []
    for at in [*range(0, len(text), size), None]:
        raw = b"" if at is None else text[at : at + size]
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(raw) + packer.flush()
        out.append(b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw)))
    return b"".join(out)


def variant_lines() -> list[str]:
    r = random.Random(1)
    place = lambda k: r.choice([f" {k}", "x", "", "9" * 25, "-3", "+4"]) if k % 9 == 0 else str(k)
    body = [f"c\t{place(k)}\t.\t{r.choice(['A', 'AC', 'ACGTACGT', '', 'A' * 20])}\tT,G\t.\tPASS\t{'z' * r.choice([1, 5, 80, 4000 if k % 50 == 0 else 3])}\tGT\t0/{k % 4}" for k in range(1, 1500)]
    return ["##meta", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta", *body, "short\t1", "c\t5\t.\tA", "c\t6\t.\tA\r"]


@pytest.mark.parametrize("end", ["\n", ""])
def test_every_line_is_in_one_split(tmp_path, end):
    lines = variant_lines()
    text = ("\n".join(lines) + end).encode()
    for kind, raw in {"plain": text, "gzip": gzip.compress(text[:5000]) + gzip.compress(text[5000:]) + b"\0" * 9, "blocks": blocks(text, 3000)}.items():
        path = tmp_path / kind
        path.write_bytes(raw)
        for step in (10**9, 9000, 1111, 301):
            reader = variant_text.VariantReader({"paths": f"file://{path}", "splitbytes": step})
            splits = reader.partitions()
            assert {s.kind for s in splits} == {kind} and (len(splits) > 1 or kind == "gzip" or step > len(raw))
            got = []
            for s in splits:
                with open(path, "rb") as handle:
                    got += [x for piece in variant_text._text(handle, s, len(raw)) for x in piece.decode().split("\n")[:-1]]
            assert got == (text.decode() + ("" if end else "\n")).split("\n")[:-1], (kind, step)


def test_scan_equals_the_lines_it_leaves_out_nothing(spark, tmp_path):
    text = ("\n".join(variant_lines()) + "\n").encode()
    (tmp_path / "a.vcf.gz").write_bytes(blocks(text, 2000))
    (tmp_path / "b.vcf").write_bytes(text)
    (tmp_path / "_skipped").write_bytes(b"c\t1\t.\tA\tT\n")
    (tmp_path / "empty.vcf").write_bytes(b"")
    path = f"file://{tmp_path}"
    old = vcf.sites(vcf.lines(spark, [f"{path}/a.vcf.gz", f"{path}/b.vcf"]))
    key = lambda df: sorted((r.file.rsplit("/", 1)[1], r.pos, r.ref, r.contig, r.value.rstrip("\r")) for r in df.collect())
    whole = variant_text.scan(spark, path, split_bytes=1000)
    assert whole.rdd.getNumPartitions() > 20
    assert key(whole) == key(old.where("ref <> 'A\r'").unionByName(old.where("ref = 'A\r'").withColumn("ref", F.lit("A"))))
    catalogue_ = spark.createDataFrame([(p, "A", "T", f"l{p}") for p in range(5, 1500, 37)] + [(None, "A", "T", "none")], "pos long, ref string, alt string, label string")
    found = lambda rows: sorted((r.file.rsplit("/", 1)[1], r.label, r.carried) for r in vcf.matched(vcf.alleles(rows), catalogue_).collect())
    near = variant_text.scan(spark, path, catalogue_, split_bytes=1000)
    assert near.count() < whole.count() / 3 and found(near) == found(vcf.candidates(vcf.lines(spark, [f"{path}/a.vcf.gz", f"{path}/b.vcf"]), catalogue_)) != []
    assert variant_text.scan(spark, path, catalogue_.where("pos < 0")).count() == 0
    assert sorted(r.file.rsplit("/", 1)[1] for r in variant_text.headers(spark, path).collect()) == ["a.vcf.gz", "b.vcf"]
    (tmp_path / "cut.gz").write_bytes(gzip.compress(text)[:-20])
    with pytest.raises(Exception, match="within a member"):
        variant_text.scan(spark, f"{path}/cut.gz").count()


def test_ordered_pairs_equal_all_pairs(spark):
    r = np.random.default_rng(4)
    rows = [(k, float(v), s, int(a), int(b)) for k in ("x", "y", None) for v in r.choice(40, 12, replace=False) / 4 for s, a, b in zip(("none", "left", "right"), r.integers(0, 4, 3), r.integers(0, 4, 3))]
    bins = spark.createDataFrame([*rows, ("one", 1.0, "none", 3, 0)], "k string, log2_bound double, censoring string, n_a long, n_b long")
    want = {}
    for k in ("x", "y", None):
        own = [x for x in rows if x[0] == k]
        total = decided = net = 0
        for (_, a, s, n, _), (_, b, t, _, m) in itertools.product(own, own):
            below = s == "left" and (t == "right" and a <= b or t == "none" and a < b) or s == "none" and t == "right" and a <= b
            above = t == "left" and (s == "right" and b <= a or s == "none" and b < a) or t == "none" and s == "right" and b <= a
            sign = (a > b) - (a < b) if s == t == "none" else above - below
            total, decided, net = total + n * m, decided + n * m * (s == t == "none" or below or above), net + n * m * sign
        want[k] = (total, decided, net)
    for ranges in (1, 3, 64):
        got = {x.k: (x.n_pairs, x.n_decisive, x.net) for x in censored.pair_sums(bins, ["k"], ranges).collect()}
        assert got == want | {"one": (0, 0, 0)}
    assert censored.pair_sums(bins.limit(0), ["k"]).count() == 0
    one = spark.range(200_000).selectExpr("'s' AS k", "id / 7.0D AS log2_bound", "'none' AS censoring", "id % 2 AS n_a", "(id + 1) % 2 AS n_b")
    assert tuple(censored.pair_sums(one, ["k"]).first()) == ("s", 10**10, 10**10, 10**5)


def test_replay_equals_the_loop(spark):
    allowed = {"start": ["a", "b"], "a": ["b", "c"], "b": ["c", "a", "b"], "c": ["start"]}
    r = random.Random(3)
    rows = [("hot", k, r.choice(["a", "b", "c", "start", "odd", None]), r.choice(["r", "r", " ", None])) for k in range(60_000)]
    rows += [(k, o // 2, r.choice("abc"), "r") for k in ("few", None, "one") for o in range({"one": 1}.get(k, 9))]
    df = spark.createDataFrame(rows, "k string, o long, act string, who string").repartition(5)
    want = []
    for key, own in itertools.groupby(sorted(rows, key=lambda x: (str(x[0]), x[1], x[2] is not None, x[2] or "", bool(x[3] and x[3].strip()))), lambda x: x[0]):
        state = "start"
        for _, o, act, who in own:
            fits = bool(who and who.strip()) and act in allowed.get(state, [])
            want.append((key, o, act, state, fits))
            state = act if fits else state
    for ranges in (1, 64):
        got = [tuple(x) for x in ledger.replay(df, allowed, "k", "o", "act", ("who",), ranges=ranges).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert ledger.replay(df.limit(0), allowed, "k", "o", "act").count() == 0
    spread = df.withColumn("_r", running.range_of(df, "o")).where("k = 'hot'").groupBy("_r").count().collect()
    assert len(spread) > 30 and max(x["count"] for x in spread) < 6000


def test_chains_tell_a_missing_payload_from_an_empty_one(spark):
    rows = [("a", k, None if k % 3 == 0 else "" if k % 3 == 1 else f"p{k}") for k in range(3000)] + [("b", 5, "x"), (None, 1, "y")]
    entries = ledger.append_entries(spark.createDataFrame(rows, "c string, o long, p string").repartition(3), "c", "o", "p")
    got = sorted(((x.c or "", x.seq, x.payload, x.prev_hash, x.entry_hash) for x in entries.collect()), key=lambda x: x[:2])
    want, before = [], None
    for chain, own in itertools.groupby(sorted(rows, key=lambda x: (x[0] or "", x[1])), lambda x: x[0] or ""):
        before = "0" * 64
        for seq, (_, _, p) in enumerate(own):
            now = hashlib.sha256((f"{seq}|{before}" if p is None else f"{seq}|{p}|{before}").encode()).hexdigest()
            want.append((chain, seq, p, before, now))
            before = now
    assert got == want
    told = stored(entries.where("c IS NOT NULL"), "entries")
    assert ledger.verify(told, ["c"]).count() == 0
    blanked = told.withColumn("payload", F.when(F.col("seq") == 6, "").otherwise(F.col("payload")))
    assert [tuple(x) for x in ledger.verify(blanked, ["c"]).where("c = 'a'").collect()] == [("a", 6, "altered entry")]


def test_long_chains_are_selected_like_the_loop(spark):
    r = random.Random(2)
    chain = [(k, f"c{(k + 1) // 2}", f"p{k // 2}") for k in range(10_000)]
    mixed = [(20_000 + k, r.choice([None, *map(str, range(40))]), r.choice([None, *(f"q{x}" for x in range(40))])) for k in range(400)]
    for caps, rows in (({"c": 1, "p": 1}, chain + mixed), ({"c": 2, "p": 3}, mixed), ({"c": 2}, mixed)):
        taken, want = {}, {}
        for k, *values in rows:
            full = next((n for (n, cap), v in zip(caps.items(), values) if taken.get((n, v), 0) >= cap), None)
            want[k] = full
            for n, v in zip(caps, values):
                taken[n, v] = taken.get((n, v), 0) + (full is None)
        df = spark.createDataFrame(rows, "k long, c string, p string").repartition(3)
        assert {x.k: x.reason for x in selection.greedy(df, [F.col("k").alias("o")], caps, stored, rounds=2).collect()} == want


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 400)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000), (None, 3), (7000, 6999)]
    got = {x.node: x.root for x in connected(spark.createDataFrame(edges, "a long, b long").repartition(3), stored).collect()}
    want = {k: 0 for k in range(401)} | {k: 1000 for k in range(1000, 1300)} | {5000: 5000, 7000: 6999, 6999: 6999}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long"), stored).count() == 0


def test_fractions_group_like_the_loop(spark):
    rows = spark.range(200_000).selectExpr("1L AS sample_id", "cast(id AS string) AS variant_key", "abs(xxhash64(id)) % 1000001 / 1000000.0D AS vaf")
    rows = rows.unionByName(spark.range(300).selectExpr("id % 7 + 2 AS sample_id", "cast(id % 50 AS string) AS variant_key", "CASE WHEN id % 11 > 0 THEN id * 37 % 130 / 100.0D END AS vaf"))
    got = sorted((x.sample_id, round(x.group, 6), x.size, round(x.median_vaf, 6)) for x in linked.frequency_groups(rows).collect())
    want = []
    table = {}
    for s, key, v in rows.collect():
        if v is not None and 0 <= v <= 1:
            table.setdefault(s, set()).add((round(v * 1_000_000), key))
    for s, found in table.items():
        start, group = None, []
        for v, _ in [*sorted(found), (10**9, None)]:
            if start is None or v - start > 50_000:
                if len(group) > 1:
                    want.append((s, start / 1e6, len(group), round(float(np.median(group)) / 1e6, 6)))
                start, group = v, []
            group.append(v)
    assert got == sorted(want)


def test_fingerprints_tell_rows_apart(spark):
    one = lambda rows: tuple(fingerprints.fingerprint(spark.createDataFrame(rows, "x string, y string"), ["x", "y"]).first())
    assert one([("a|b", "c")]) != one([("a", "b|c")]) and one([(None, "c")]) != one([("", "c")]) and one([("1:a", None)]) != one([("1", "a")])
    assert one([("a", "b"), ("c", "d")]) == one([("c", "d"), ("a", "b")]) != one([("a", "b")] * 2)


def test_locks_name_what_changed(spark):
    rows = [(k, f"v{k}") for k in range(2000)] + [(7, "v7"), (None, "n")]
    df = spark.createDataFrame(rows, "id long, v string")
    evidence = spark.createDataFrame([("1", None), ("2", " "), ("3", "bad run")], "item string, errors string")
    folder = shared_path(spark, "lock")
    fingerprints.write_lock(df, ["id"], ["id", "v"], evidence, folder, "2")
    said = lambda d, columns=("id", "v"), version="2": sorted(map(str, (tuple(x) for x in fingerprints.violations(d, ["id"], list(columns), folder, version, stored).collect())))
    recorded = str(("evidence", "3", "bad run"))
    assert said(df.repartition(5)) == [recorded]
    new = df.where("id IS NULL OR id <> 10").withColumn("v", F.when(F.col("id") == 11, "").when(F.col("id") == 12, None).otherwise(F.col("v"))).dropDuplicates(["id"]).unionByName(spark.createDataFrame([(9999, "x")], "id long, v string"))
    assert said(new) == sorted([recorded, *(str(("row", k, c)) for k, c in (("7", "changed"), ("10", "removed"), ("11", "changed"), ("12", "changed"), ("9999", "added")))])
    kinds = lambda *a: [x.split("'")[1] for x in said(*a)]
    assert kinds(df, ("id", "v"), "3") == ["evidence", "schema"] and kinds(df.withColumn("v", F.col("id"))) == ["columns", "evidence"]
    fingerprints.write_lock(df, ["id"], ["id", "v"], evidence.limit(0), folder, "2")
    assert kinds(df) == ["no evidence"]


def test_documents_name_every_fault(spark):
    texts = [("a", '[{"id": 1, "x": 1.5}, {"id": 2, "x": null}, {"id": 3}]'), ("b", '[{"id": "1", "y": 2}, 4, {"x": true, "id": 7}, {"id": 7, "x": 1}]'), ("c", None), ("d", "{}"), ("e", "[]"), ("f", "[{}, {\"id\": null}]")]
    rows, errors = documents.typed_rows(spark.createDataFrame(texts, "file string, value string"), {"id": "bigint", "x": "double"}, ("id",), "id")
    assert sorted((r.file, r.pos, r.id, r.x) for r in rows.collect()) == [("a", 0, 1, 1.5), ("a", 1, 2, None), ("a", 2, 3, None)]
    assert sorted(map(tuple, errors.collect())) == [
        ("b", "$[*].id=7", "repeated"), ("b", "$[0].id", "not bigint"), ("b", "$[0].y", "unknown field"), ("b", "$[1]", "not an object"), ("b", "$[2].x", "not double"),
        ("c", "$", "not JSON"), ("d", "$", "not a list"), ("f", "$[0].id", "missing"), ("f", "$[1].id", "missing"),
    ]
    good = documents.context_errors(spark.createDataFrame([("a", '{"schema": "s"}'), ("b", '{"schema": 5, "error_trend": "x"}')], "file string, value string"), "s")
    assert sorted(map(tuple, good.collect())) == [("b", "$.error_trend", "not a list"), ("b", "$.schema", "not the schema")]


def test_places_and_tiers_of_a_catalogue(spark):
    master = spark.createDataFrame(
        [(2, "g", "c1", "D", "w1", "1", "1) Assoc w R"), (1, "g", "c1", "e", "w2", " 2", "3) Uncertain significance"), (0, "g", "c1", "e", "w3", None, "odd"), (3, "h", "c2", "D ", "w9", "2", "other"), (4, "h", " ", "D", "w1", "1", "1) Assoc w R")],
        "line long, gene string, change string, drug string, variant string, tier string, grade string",
    )
    places = spark.createDataFrame([(5, "w2", None, "10", "A", "T"), (4, "w2", " X ", " 9 ", "A", "G"), (3, "w2", "X", "1a", "A", "G"), (2, "w2", "X", "7", "", "G"), (1, "", "X", "7", "A", "G")], "line long, variant string, chromosome string, position string, ref string, alt string")
    got = [(r.gene, r.change, r.call, r.variant, r.coordinate_key, r["keys"]) for r in catalogue.with_coordinates(master, places, "line").collect()]
    assert got == [("g", "c1", "resistant", "w2", "X:Chromosome:9:A>G", ["X:Chromosome:9:A>G", "NC_000962.3:Chromosome:10:A>T"])]
    assert sorted((r.drug, r.tier1, r.tier2) for r in catalogue.drug_tiers(master).collect()) == [("d", ["g"], ["h"]), ("e", [], ["g"])]


def test_wide_truths(spark):
    rows = spark.createDataFrame([(1, "R1", "r", "high", "S", "LOW"), (2, "R1", "S ", "HIGH", None, "HIGH"), (3, None, "R", "HIGH", "x", "HIGH")], "k long, ENA_RUN string, A_BINARY_PHENOTYPE string, A_PHENOTYPE_QUALITY string, B_BINARY_PHENOTYPE string, B_PHENOTYPE_QUALITY string")
    got = sorted(map(tuple, tables.wide_truths(rows, {"A": "a", "B": "b", "C": "c"}, "k").collect()))
    assert got == [("cr_", "a", "resistant"), ("cr_R1", "a", "susceptible")]
    with pytest.raises(ValueError, match="expected ENA_RUN"):
        tables.wide_truths(rows.drop("ENA_RUN"), {"A": "a"}, "k")


def test_ticket_state_survives_a_restart_and_expires(spark):
    kind = "ticket_id string, event_id long, action string, reviewer string, rationale string"
    allowed = {"new": ["open"], "open": ["investigating"], "investigating": ["resolved", "open"]}

    def streamed(batches, wait=0.0, **options):
        source, table, checkpoint = (shared_path(spark, n) for n in ("tickets", "told", "checkpoint"))
        for rows in batches:
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
            intake.append(intake.ticket_states(spark.readStream.schema(kind).parquet(source), allowed, **options), table, checkpoint, once="ttl_hours" in options).awaitTermination(120)
            time.sleep(wait)
        return sorted((r.event_id, r.previous, r.allowed) for r in spark.read.schema("ticket_id string, event_id long, action string, previous string, allowed boolean").parquet(table).collect())

    begun = spark.createDataFrame([("z", "investigating")], "ticket_id string, state string")
    first = [("a", 1, "open", "r", "w"), ("a", 2, "resolved", "r", "w"), ("z", 3, "resolved", "r", "w")]
    second = [("a", 5, "investigating", "r", "x"), ("a", 4, "investigating", "r", " "), ("z", 6, "open", "r", "x")]
    want = [(1, "new", True), (2, "open", False), (3, "investigating", True), (4, "open", False), (5, "open", True), (6, "resolved", False)]
    assert streamed([first, second], initial=begun) == want
    again = [[("a", 1, "open", "r", "w")], [("a", 2, "open", "r", "w")]]
    assert streamed(again, wait=2.5, ttl_hours=1 / 3600) == [(1, "new", True), (2, "new", True)]
    assert streamed(again, ttl_hours=24.0) == [(1, "new", True), (2, "open", False)]


def test_observations_of_another_site(spark):
    rows = [('[{"site_id": "a"}]', "a"), ('[{"site_id": "a"}, {"site_id": "b"}]', "a"), ('[{"x": 1}]', "a"), ("[]", "a"), ("no", "a"), (None, "a"), ('[{"site_id": "b"}]', None)]
    df = spark.createDataFrame(rows, "payload string, site string")
    assert [r.m for r in df.select(intake.of_other_site(F.col("payload"), F.col("site")).alias("m")).collect()] == [False, True, True, False, False, False, True]


def test_findings_follow_their_conditions(spark):
    results = [(1, "d", "no_call", "indeterminate", None, None, None, None), (2, "d", "no_call", "susceptible", None, True, "insufficient", "o"), (2, "e", "resistant", "susceptible", "resistant", True, "insufficient", "o"), (3, "clar", "indeterminate", "indeterminate", None, False, "ok", "o")]
    evidence = [(2, "d", "catalogued", "indeterminate", "isolate", None, None, "v1"), (2, "d", "catalogued", "resistant", None, None, None, "v2"), (2, "d", None, "indeterminate", "historical", None, None, "unknown"), (2, "e", "phenotypic", "susceptible", "isolate", "resistant", None, None), (9, "d", "phenotypic", "resistant", None, "susceptible", "resistant", None)]
    got = follow_up.investigated(
        spark.createDataFrame(results, "sample_id long, drug string, call string, genomic_call string, phenotypic_call string, discordant boolean, assay_status string, organism string"),
        spark.createDataFrame(evidence, "sample_id long, drug string, tier string, call string, scope string, comparison string, result string, version string"),
        spark.createDataFrame([(1, "depth", "fail"), (1, "a", "fail"), (1, "callable_mask", "fail"), (2, "a", "pass")], "sample_id long, qc_check string, status string"),
        spark.createDataFrame([(3, "x", True), (3, "x", True), (1, "x", None)], "sample_id long, drug string, conflict boolean"), ("o", "clar"),
    ).collect()
    assert sorted((r.sample_id, r.drug, r.category, r.priority, r.n_evidence) for r in got) == [
        (1, "*", "analytical_failure", 0, 0), (1, "d", "validation_gap", 2, 0),
        (2, "d", "catalogue_drift", 1, 3), (2, "d", "coverage_gap", 1, 3), (2, "d", "engine_discordance", 0, 3), (2, "d", "historical_association", 2, 3), (2, "d", "uncertain_interpretation", 2, 1),
        (2, "e", "mic_category_mismatch", 0, 1), (2, "e", "phenotype_discordance", 0, 1),
        (3, "clar", "ntm_induction_context", 1, 0), (3, "clar", "validation_gap", 2, 0), (3, "x", "mic_prediction_disagreement", 1, 0),
    ]
    assert {r.detail for r in got} == {None, "a; depth"} and len({r.finding for r in got}) == len(got) and all(len(r.finding) == 24 for r in got)


def test_readiness_of_a_scope(spark):
    benchmark = spark.createDataFrame([("a", 0.5, 0.1, "beats-baseline", 0.9, 0.2), ("b", None, None, "cannot-match-coverage", 0.4, None), ("c", 0.5, 0.1, "underpowered", 0.9, 0.2), ("d", 0.5, None, None, 0.9, 0.3)], "drug string, matched_coverage double, matched_risk double, verdict string, coverage double, error_rate double")
    rates = spark.createDataFrame([("a", 0.9, 0.8), ("b", 0.9, 0.8), ("c", None, 0.8)], "drug string, sensitivity double, specificity double")
    got = {r.drug: (r.call_rate, r.error_rate, r.exclusion, r.ready) for r in reports.registry_readiness(benchmark, rates).collect()}
    assert got == {
        "a": (0.5, 0.1, None, True), "b": (0.4, None, "no risk at the baseline's coverage: cannot-match-coverage", False), "c": (0.5, 0.1, "sensitivity not estimable", False), "d": (0.9, 0.3, "no risk at the baseline's coverage: no baseline", False),
    }
