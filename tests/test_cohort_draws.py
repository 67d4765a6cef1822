"""Resampled statistics against exact laws, selections against plain loops, mixtures, and streams over fixed sequences."""

import hashlib
import hmac
import itertools
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from isoframe.operators import effects, follow_up, resampling, selection, targets
from isoframe.plans import effect_scan
from isoframe.sources import annotated, tables, tools
from isoframe.sources.scratch import shared_path, stored
from isoframe.streaming import intake, monitoring


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(1)
    rows = [("a", float(x)) for x in r.normal(size=997)] + [("b", float(x)) for x in r.integers(0, 4, 500)] + [("c", 5.0), (None, 1.0), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.013, 0.5, 0.75, 0.999, 1.0):
        for accuracy in (100_000, 20):
            got = {x.k: (x.n, x.quantile) for x in resampling.quantiles(df, ["k"], "v", q, accuracy).collect()}
            for k in ("a", "b", "c", None):
                v = [x for g, x in rows if g == k and x is not None]
                assert got[k][0] == len(v) and math.isclose(got[k][1], np.quantile(v, q), abs_tol=1e-12), (k, q)


def test_draws_follow_their_laws(spark):
    rows = [("far", float(k % 8), k % 2 == 0) for k in range(80)] + [("far", 100.0 + k, True) for k in range(40)] + [("few", 1.0, True)] * 3
    df = spark.createDataFrame(rows, "k string, v double, a boolean")
    one, two = (resampling.bootstrap_interval(df.repartition(n), ["k"], "v", resampling.mean_of, 3000).orderBy("k").collect() for n in (1, 5))
    assert one == two and one[1].low is None
    values = np.array([x for k, x, _ in rows if k == "far"])
    spread = values.std() / math.sqrt(len(values))
    assert abs(one[0].low - (values.mean() - 1.96 * spread)) < 0.3 * spread and abs(one[0].high - (values.mean() + 1.96 * spread)) < 0.3 * spread
    small = spark.createDataFrame([("s", float(x), x > 5) for x in (1, 2, 4, 5, 3, 6, 7, 9, 8, 10)], "k string, v double, a boolean")
    p = resampling.permutation_pvalue(small, ["k"], "v", "a", resampling.mean_of, 20_000).first().p
    whole = list(range(1, 11))
    gaps = [abs(2 * sum(c) - 55) for c in itertools.combinations(whole, 5)]
    assert abs(p - np.mean([g >= 25 for g in gaps])) < 0.003
    ci = {x.k: (x.low, x.high) for x in resampling.difference_interval(df, ["k"], "v", "a", resampling.mean_of).collect()}
    assert ci["few"] == (None, None) and ci["far"][0] > 40
    assert math.isclose(resampling.median_of(np.array([1.0, 2.0, 9.0]), np.array([[1, 1, 2]]))[0], 5.5)
    for per_task in (1, 100):  # the same draws however blocks are dealt
        assert sorted(map(str, resampling.bootstrap_interval(df, ["k"], "v", resampling.mean_of, 3000, per_task=per_task).collect())) == sorted(map(str, one))
        assert resampling.permutation_pvalue(small, ["k"], "v", "a", resampling.mean_of, 20_000, per_task=per_task).first().p == p


def test_effects_are_found_within_strata(spark):
    bins = [("v", "d", "b", "L", k, float(x), "none", 9 if x > 3 else 0, 0 if x > 3 else 9) for k in (1, 2) for x in range(8)]
    bins += [("w", "d", "b", "L", 1, float(x), "none", 5, 5) for x in range(8)] + [("few", "d", "b", None, 1, 1.0, "none", 2, 50)]
    df = spark.createDataFrame(bins, "label string, drug string, background string, lineage string, site_id int, log2_bound double, censoring string, n_a long, n_b long")
    got = {r.label: r for r in effects.resampled(df).collect()}
    assert got["v"].low == got["v"].high == 1.0 and got["v"].p < 0.01
    assert sorted(map(str, effects.resampled(df.repartition(5), per_task=100).collect())) == sorted(map(str, got.values()))
    large = effects.resampled(df.withColumns({"n_a": F.col("n_a") * 1000, "n_b": F.col("n_b") * 1000}).where("label = 'v'")).first()
    assert large.p == 1 / 200 and large.low == 1.0
    assert got["w"].low < 0 < got["w"].high and got["w"].p > 0.5 and (got["few"].low, got["few"].p) == (None, None)
    shifts = {(r.label, r.site_id): r for r in effects.stratum_shifts(df).collect()}
    assert shifts["v", 1].delta == 1 and shifts["w", 1].delta == 0 and shifts["few", 1].refused == "too few observations"
    found = spark.createDataFrame([("v", "d", 20, "estimable", 2, 1.0, 10, 3.0, "x", 0.9), ("w", "d", 20, "estimable", 1, 0.0, 9, None, None, None), ("few", "d", 2, "underpowered", 0, None, None, None, None, None)],
        "label string, drug string, n_carriers long, state string, n_strata long, delta double, n_decisive long, lineage_diversity double, top_determinant string, top_fraction double")
    said = {r.label: (r.verdict, r.warnings) for r in effects.verdicts(found, effects.resampled(df)).collect()}
    assert said == {"v": ("evidence-of-effect", "co-occurs with x"), "w": ("no-evidence", "lineage unknown"), "few": ("underpowered", "")}


def test_draws_of_verdicts_do_not_follow_the_size(spark, monkeypatch):
    """However many pairs an effect has, its verdict rests on the same numbers of draws: 1,999 permutations here, of which none is as extreme."""
    bins = [("v", "d", "b", "L", 1, float(x), "none", 9000 if x > 3 else 0, 0 if x > 3 else 9000) for x in range(8)]
    df = spark.createDataFrame(bins, "label string, drug string, background string, lineage string, site_id int, log2_bound double, censoring string, n_a long, n_b long")
    found = spark.createDataFrame([("v", "d", 36000, "estimable", 1, 1.0, 10, 3.0, None, None)],
        "label string, drug string, n_carriers long, state string, n_strata long, delta double, n_decisive long, lineage_diversity double, top_determinant string, top_fraction double")
    monkeypatch.setattr(effect_scan, "_estimates", lambda *_: (found, df))
    assert effect_scan.effect_verdicts(spark, "").first().p == 1 / 2000


@pytest.mark.parametrize("seed", [1, 2])
def test_capped_selection_equals_a_loop(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(f"s{k:03}", f"p{r.integers(5)}" if k % 9 else None, f"o{r.integers(4)}", int(r.integers(6))) for k in range(120)]
    df = spark.createDataFrame(rows, "sample_id string, project string, organism string, bases long")
    want, used, total = {}, {}, 0
    for s, p, o, b in sorted(rows, key=lambda x: (-x[3], x[0])):
        full = next((name for name, value, cap in (("project", p, 7), ("organism", o, 9)) if used.get((name, value), 0) >= cap), None)
        if full is None:
            used["project", p], used["organism", o] = used.get(("project", p), 0) + 1, used.get(("organism", o), 0) + 1
        want[s] = full
    taken = [s for s, *_ in sorted(rows, key=lambda x: (-x[3], x[0])) if want[s] is None]
    want |= {s: "total" for s in taken[20:]}
    got = selection.shortlist(df, {"project": 7, "organism": 9}, 20, stored).collect()
    assert {x.sample_id: x.reason for x in got} == want and len(got) == len(rows)
    people = spark.createDataFrame([(k, int(r.integers(30)), int(r.integers(20)), k % 3) for k in range(90)], "isolate_id long, cluster_id int, patient_id int, site_id int")
    clusters, patients, kept = set(), set(), set()
    for x in people.orderBy("isolate_id").collect():
        if x.cluster_id not in clusters and (x.site_id, x.patient_id) not in patients:
            kept.add(x.isolate_id)
            clusters.add(x.cluster_id)
            patients.add((x.site_id, x.patient_id))
    assert {x.isolate_id for x in selection.independent(people, stored).where("reason IS NULL").collect()} == kept


def test_two_modes(spark):
    r = np.random.default_rng(4)
    values = np.round(np.concatenate([r.normal(-2, 0.5, 400), r.normal(3, 0.7, 200)]), 3)
    rows = [("two", float(x), "none") for x in values] + [("few", 1.0, "none")] * 5 + [("one", 1.0, "none")] * 50 + [("cut", float(k % 5), "none" if k % 2 else "left") for k in range(200)]
    got = {x.drug: x for x in targets.two_modes(spark.createDataFrame(rows, "drug string, log2_bound double, censoring string"), ["drug"]).collect()}
    two = got["two"]
    assert abs(two.mean_low + 2) < 0.15 and abs(two.mean_high - 3) < 0.2 and abs(two.weight_low - 2 / 3) < 0.05 and two.refused is None
    assert (got["few"].refused, got["one"].refused, got["cut"].refused) == ("few exact values", "one value", "censored")


def test_files_fail_as_a_whole(spark):
    texts = spark.createDataFrame([("a", '{"s1": {"susceptibility": {"D": {"predict": "S"}, "E": {"predict": "r", "called_by": {"g_x": "1"}}}}}'), ("b", '{"s": {"susceptibility": {"D": {"predict": "?"}}}}'), ("c", "{"), ("d", "{}"), ("e", '{"s": {}}')], "file string, value string")
    rows, failed = tools.load_probes(texts)
    assert {(r.sample_id, r.drug, r.call, r.asserts_coverage, r.called_by) for r in rows.collect()} == {("s1", "d", "susceptible", True, ""), ("s1", "e", "resistant", False, "g_x")}
    assert {r.file: r.reason for r in failed.collect()}.keys() == {"b", "c", "d", "e"}
    rows, failed = tables.json_rows(texts.select("file", F.lit('[{"x": 1}, {"x": null}]').alias("value")), "x: bigint")
    assert rows.count() == 10 and failed.count() == 0


def test_annotated_fraction_and_choice_of_sample(spark):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"
    body = "c\t10\t.\tCAT\tCAG,C\t5\tPASS\tGENE=g\tGT:AD\t0/1:5,3,2\t0/1:0,0,10"
    lines = spark.createDataFrame([("f", head), ("f", body), ("f", ""), ("g", body)], "file string, value string")
    _, rejects = annotated.load(lines)
    assert {(r.file, r.reason) for r in rejects.collect()} == {("f", "several samples"), ("g", "no header")}
    found, _ = annotated.load(lines, "B")
    assert sorted((r.pos, r.ref, r.alt, r.vaf, r.depth, r.alt_depth) for r in found.collect()) == [(10, "CAT", "C", 1.0, 10, 10), (12, "T", "G", 0.0, 10, 0)]


def test_cohort_over_two_batches_counts_once(spark):
    source, table = shared_path(spark, "cohorts"), shared_path(spark, "counts")
    kind = "cohort_id string, drug string, lineage string, predicted string, phenotype string"
    for k in range(3):
        spark.createDataFrame([("c1", "d", "L", "resistant", "R")] * (k + 1) + [(f"x{k}", "d", "L", "susceptible", "R")], kind).coalesce(1).write.mode("append").parquet(source)
    for delivery in ("one", "two"):
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
        monitoring.ingest(stream, table, shared_path(spark, "checkpoint"), delivery).awaitTermination()
    got = monitoring.totals(spark.read.parquet(table)).first()
    assert (got.tp, got.fn) == (6, 3)


def test_late_rows_are_kept_apart(spark):
    source = shared_path(spark, "late")
    for k, day in enumerate((10, 11, 2, 30, 28)):
        spark.createDataFrame([(k, f"2024-01-{day:02} 00:00:00")], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    good, late = shared_path(spark, "good"), shared_path(spark, "behind")
    intake.split_late(stream, good, late, shared_path(spark, "checkpoint"), "ts", 3 * 86_400).awaitTermination()
    read = lambda t: {r.id for r in spark.read.schema("id int, ts timestamp").parquet(t).collect()}
    assert read(late) == {2} and read(good) == {0, 1, 3, 4}


def test_signatures_and_replays(spark):
    mark = lambda key, body: hmac.new(key.encode(), body.encode(), hashlib.sha256).hexdigest()
    rows = [("a", "x", mark("k", "x"), "n1"), ("a", "x", mark("other", "x"), "n2"), ("b", "x", mark("k", "x"), "n3"), ("a", None, None, "n4"), ("a", "y", mark("k", "y"), "n1")]
    df = spark.createDataFrame(rows, "site_id string, payload string, signature string, nonce string").withColumns({"sent": F.current_timestamp(), "received": F.current_timestamp()})
    told = intake.checked(intake.signed(df, {"a": "k"}))
    assert [r.reject_reason for r in told.collect()] == [None, "signature", "signature", "signature", None]
    assert intake.accepted(told).count() == 1


def test_delimited_tables(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes("\ufeffa\tb\n# no\n\n1\t x \n2\t\n".encode())
    got = tables.read_table(spark, f"file://{tmp_path}/t.tsv", "\t", ("a",))
    assert got.columns == ["a", "b"] and [(r.a, r.b) for r in got.collect()] == [("1", "x"), ("2", None)]
    with pytest.raises(ValueError, match="missing columns"):
        tables.with_required(got, ("c",))
    folder = f"file://{tmp_path}/{uuid.uuid4().hex}"
    tables.write_results({"t": got}, folder, {"why": "test"})
    assert spark.read.schema("manifest map<string, string>").json(f"{folder}/manifest").first().manifest == {"why": "test", "n_t": "2"}


def test_plans_keep_to_the_budget(spark):
    rows = [(1, "f1", "d", 1, "a0"), (1, "f2", "d", 2, "a0"), (1, "f3", "e", 3, "a0"), (1, "f4", "e", 4, "a0"), (1, "f5", "d", 5, "a1"), (1, "f6", "d", 6, "a2"), (1, "f7", "d", 7, "zz"), (2, "f1", "d", 1, "a1")]
    menu = [("o1", "a0", True, 5.0), ("o2", "a0", True, 3.0), ("o3", "a1", True, None), ("o4", "a2", False, 1.0)]
    made = spark.createDataFrame(rows, "sample_id long, finding string, drug string, priority int, action string"), spark.createDataFrame(menu, "option string, action string, available boolean, cost double")
    got = {(r.sample_id, r.finding): (r.status, r.option, r.charged) for r in follow_up.plans(*made, 4.0).collect()}
    assert got == {
        (1, "f1"): ("recommended", "o2", 3.0), (1, "f2"): ("recommended", "o2", 0.0), (1, "f3"): ("deferred_budget", None, None), (1, "f4"): ("deferred_budget", None, None), (1, "f5"): ("cost_unknown", None, None),
        (1, "f6"): ("unavailable", None, None), (1, "f7"): ("availability_unknown", None, None), (2, "f1"): ("cost_unknown", None, None),
    }
    free = {(r.sample_id, r.finding): (r.option, r.charged) for r in follow_up.plans(*made).collect()}
    assert free[2, "f1"] == ("o3", None) and free[1, "f3"] == ("o2", 3.0)
