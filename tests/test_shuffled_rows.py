"""Rows that queries list in great number (drugs of a label, areas of a gene, rules of a pair) are listed last: what is shuffled stays near the input."""

import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from isoframe.functions.display import readable
from isoframe.operators import accuracy, coverage, effects, joins, lanes, linked, mechanisms, shown
from isoframe.plans import oracles, queries
from isoframe.plans.bindings import TABLES

SMALL = "/root/testdata/sf0.001"


def _shuffled(df):
    """(rows of the result, rows written to shuffles) of one run."""
    rows, found = df.collect(), {}

    def walk(plan):
        name = plan.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found[plan.id()] = plan.metrics().get("shuffleRecordsWritten").get().value()
        inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
        for k in range(0 if inner is not None else plan.children().size()):
            walk(plan.children().apply(k))
        if inner is not None:
            walk(inner)

    walk(df._jdf.queryExecution().executedPlan())
    return rows, sum(found.values())


@pytest.fixture(scope="module")
def variants(spark):
    """400 variants of 100 samples and one gene, half of them with one label; every row twice."""
    one = spark.range(400).selectExpr(
        "id DIV 4 AS sample_id", "concat('k', id) AS variant_key", "if(id % 2 = 0, 'g_a', concat('g_', id)) AS label", "'g' AS gene", "'promoter' AS region", "'missense' AS consequence", "'c' AS chrom", "id AS pos",
        "0.5D AS vaf", "50L AS depth", "20L AS alt_depth", "'p' AS platform",
    )
    return one.unionByName(one)


@pytest.fixture(scope="module")
def entries(spark):
    return spark.range(60).selectExpr("'g_a' AS label", "if(id = 7, 'k6', NULL) AS variant_key", "concat('d', id) AS drug", "'resistant' AS call")


def test_pairs_are_formed_once_for_all_rules(spark, variants):
    rules = spark.range(500).selectExpr("id AS rule", "if(id < 400, 'd', 'other') AS drug", "'g' AS primary", "if(id % 2 = 0, 'k1', 'g') AS partner")
    twice = rules.unionByName(spark.createDataFrame([(0, "d", "g", "g")], rules.schema))
    results = variants.selectExpr("sample_id", "'d' AS drug", "'resistant' AS call", "'catalogued' AS tier")
    for pairs in (linked.co_observed(twice, variants, results), shown.epistasis_classes(*linked.co_observed_classes(twice, variants, results))):
        rows, moved = _shuffled(pairs)
        # every ordered pair of a sample by the 200 rules of the gene and by rule 0; three pairs of sample 0 by the other 199 rules
        assert len(rows) == len(set(rows)) == 100 * 12 * 201 + 3 * 199
        assert moved < 10_000


def test_areas_are_listed_after_the_shuffle(spark, variants):
    areas = spark.range(900).selectExpr(
        "id AS area", "if(id % 3 = 0, 'g_a', NULL) AS label", "if(id % 3 = 1, 'c', NULL) AS chrom", "if(id % 3 = 1, id, NULL) AS start", "if(id % 3 = 1, id + 1, NULL) AS stop", "if(id % 3 = 2, 'g', NULL) AS gene",
    )
    rows, moved = _shuffled(lanes.regulatory_matches(variants, areas))
    by = {how: sum(r.matched_by == how for r in rows) for how in ("label", "place", "gene")}
    assert by == {"label": 200 * 300, "gene": 400 * 300, "place": sum(p in (s, s + 1) for p in range(400) for s in range(1, 900, 3))} and len(rows) == len(set(rows))
    assert moved < 10_000
    told, moved = _shuffled(shown.regulatory_classes(lanes.regulatory_classes(variants, areas), areas))
    assert sorted(told) == sorted(shown.regulatory_rows(lanes.regulatory_matches(variants, areas), areas).select(told[0].__fields__).collect()) and moved < 10_000


@pytest.mark.parametrize("told", [False, True])
def test_listed_areas_make_small_files(spark, tmp_path, told):
    """Many areas of one gene: a file keeps runs of variants and a cycle of areas, not a value for each of 2 million rows."""
    variants = spark.range(400).selectExpr("id AS sample_id", "concat('k', id) AS variant_key", "CAST(NULL AS string) AS label", "'g' AS gene", "'promoter' AS region", "'c' AS chrom", "CAST(NULL AS long) AS pos")
    areas = spark.range(5000).selectExpr("id AS area", "CAST(NULL AS string) AS label", "'c' AS chrom", "CAST(NULL AS long) AS start", "CAST(NULL AS long) AS stop", "'g' AS gene")
    rows = shown.regulatory_classes(lanes.regulatory_classes(variants, areas), areas) if told else lanes.regulatory_matches(variants, areas)
    rows.write.parquet(f"{tmp_path}/rows")
    back = spark.read.parquet(f"{tmp_path}/rows")
    assert back.count() == back.distinct().count() == 400 * 5000
    assert sum(f.stat().st_size for f in (tmp_path / "rows").iterdir()) < 400 * 5000


def test_variants_with_several_labels_of_a_class_come_once(spark):
    """An area of two labels is a class of two keys, which a variant may meet by both; rows without a sample or key stay."""
    variants = spark.createDataFrame([(1, "k", "a"), (1, "k", "b"), (2, "k", "a"), (2, "k", "a"), (None, "k", "a"), (3, None, "b")], "sample_id long, variant_key string, label string")
    variants = variants.selectExpr("*", "CAST(NULL AS string) AS gene", "'coding' AS region", "CAST(NULL AS string) AS chrom", "CAST(NULL AS long) AS pos")
    areas = spark.createDataFrame([(n, x) for n in range(600) for x in "ab"], "area long, label string").selectExpr("*", "CAST(NULL AS string) AS chrom", "CAST(NULL AS long) AS start", "CAST(NULL AS long) AS stop", "CAST(NULL AS string) AS gene")
    rows = lanes.regulatory_matches(variants, areas).collect()
    assert len(rows) == len(set(rows)) == 4 * 600 and {(r.sample_id, r.variant_key) for r in rows} == {(1, "k"), (2, "k"), (None, "k"), (3, None)}
    # beyond the limit of a broadcast the same rows come from a merge
    found, members = lanes.regulatory_classes(variants, areas)[0]
    assert sorted(map(str, joins.listed(found, members, 0).select("sample_id", "variant_key", "area", "matched_by").collect())) == sorted(map(str, rows))


def test_catalogued_drugs_are_listed_after_the_shuffle(spark, variants, entries):
    rows, moved = _shuffled(lanes.catalogue_evidence(variants, entries, "v"))
    # k6 has an entry of its own, for one drug
    assert len(rows) == len(set(rows)) == 199 * 60 + 1 and moved < 3000
    pairs = lanes.catalogue_evidence(variants, entries, "v").select("sample_id", "variant_key", "drug")
    limits = spark.createDataFrame([("p", 0.1)], "platform string, lod double")
    found, moved = _shuffled(lanes.minority_findings(variants, pairs, limits))
    assert len(found) == 199 * 60 + 1 and {r.reason for r in found} == {"minority"} and moved < 5000
    rows, moved = _shuffled(lanes.lane_counts(lanes.dispatch(variants, [lanes.catalogue_evidence(variants, entries, "v")])[1]))
    assert sum(r.n for r in rows if r.lane == "catalogue") == sum(r.n for r in rows if r.lane == "unexamined") == 200 and moved < 6000


def test_few_genes_do_not_gather_all_variants(spark, variants):
    drugs = spark.range(50).selectExpr("'g' AS gene", "concat('d', id) AS drug")
    rows, moved = _shuffled(lanes.uncertain_evidence(variants, drugs, spark.createDataFrame([("g_a",)], "label string")))
    assert len(rows) == len(set(rows)) == 200 * 50 and moved < 1000
    other = drugs.selectExpr("'h' AS gene", "drug")
    resolved = spark.createDataFrame([("g_b",)], "label string")
    for df in (lanes.uncertain_evidence(variants, drugs, resolved), lanes.regulator_evidence(variants, other, drugs), mechanisms.mechanism_queue(variants, other, drugs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((gene|label)#\d+, \d+\)", plan) and "SortMergeJoin" not in plan
        assert df.count() == 400 * 50


def test_carriers_are_not_shuffled_for_each_drug(spark):
    drugs = spark.range(10).selectExpr("concat('d', id) AS drug")
    placed = spark.range(100).selectExpr("id AS isolate_id", "'' AS background", "'' AS lineage", "id % 2 AS site_id").crossJoin(drugs)
    mic = placed.selectExpr("isolate_id", "drug", "CAST(isolate_id % 4 AS DOUBLE) AS log2_bound", "'none' AS censoring")
    carriage = spark.range(4000).selectExpr("id DIV 40 AS isolate_id", "concat('v', id % 40) AS label").where("label <> concat('v', isolate_id)")
    pairs = carriage.select("label").distinct().crossJoin(drugs).where("label <> 'v0' OR drug = 'd0'")
    rows, moved = _shuffled(effects.stratum_bins(placed, mic, carriage, pairs))
    assert sum(r.n_a for r in rows) == 39 * 99 * 10 + 99 and len({(r.label, r.drug) for r in rows}) == 39 * 10 + 1
    assert moved < 20_000


def test_each_match_hands_on_its_smallest_drug(spark, variants, entries):
    order = [F.upper("drug"), F.col("call")]
    whole, first = lanes.catalogue_evidence(variants, entries, "v1"), lanes.catalogue_evidence(variants, entries, "v1", order).collect()
    least = whole.groupBy("sample_id", "variant_key").agg(F.min_by(F.struct(*whole.columns), F.struct(*order)).alias("r")).select("r.*")
    assert sorted(first) == sorted(least.collect()) and len(first) == 200 and whole.count() > 10_000


def test_texts_are_written_once(spark):
    rows = spark.range(1000).selectExpr("id", "if(id % 3 = 0, NULL, concat('a_', id % 3)) AS a", "concat('b_', id % 2) AS b")
    for limit in (100, 1):
        out = joins.rewritten(rows, ["a", "b"], readable, limit)
        assert out.columns == rows.columns and sorted(out.collect(), key=lambda r: r.id) == rows.select("id", readable(F.col("a")).alias("a"), readable(F.col("b")).alias("b")).orderBy("id").collect()
        assert ("split(" in out._jdf.queryExecution().optimizedPlan().toString()) == (limit == 1)


def test_gate_makes_no_row_for_each_locus_of_each_drug(spark):
    samples = spark.range(200).selectExpr("id AS isolate_id")
    profile = spark.range(1500).selectExpr("concat('d', id DIV 50) AS drug", "concat('l', id % 50) AS locus").unionByName(spark.createDataFrame([("none", None)], "drug string, locus string"))
    seen = spark.range(200 * 50).selectExpr("id DIV 50 AS isolate_id", "concat('l', id % 50) AS locus", "if(id % 50 = 7 AND id DIV 50 % 2 = 0, 0.5D, 1.0D) AS callable_fraction", "if(id % 50 = 9 AND id DIV 50 = 1, 3.0D, NULL) AS mean_depth").where("isolate_id <> 5 OR locus <> 'l3'")
    rows, moved = _shuffled(coverage.required_loci(samples, profile, seen))
    told = {(r.isolate_id, r.drug): (r.adequate, r.n_required, r.missing) for r in rows}
    assert len(rows) == len(told) == 200 * 31 and moved < 30_000  # 300,000 loci of samples and drugs
    assert told[0, "d3"] == (False, 50, "l7") and told[1, "d3"] == (False, 50, "l9") and told[3, "d3"] == (True, 50, "") and told[5, "d0"] == (False, 50, "l3") and told[3, "none"] == (False, 0, "")


@pytest.fixture
def few_rows_a_task(spark, monkeypatch):
    """Tasks of 500 rows, and no join that broadcasts unasked; sf0.001 has 6,000 order lines."""
    monkeypatch.setattr(joins, "TASK_ROWS", 500)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _dealt_to(df):
    """{key: partitions} of the shuffles by several keys or by one."""
    return {key: int(n) for key, n in re.findall(r"hashpartitioning\((\w+)#\d+L?(?:, \w+#\d+L?)*, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())}


def test_spread_follows_the_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 500)
    rows = spark.range(4000)
    assert joins.spread(rows, 2000, "id") is rows and joins.spread(rows, 2001, "id").rdd.getNumPartitions() == 5
    assert joins.spread(rows, 0, "id") is rows and joins.spread(rows, 4000, "id").count() == 4000


def test_engines_are_compared_in_tasks_of_bounded_rows(spark, few_rows_a_task):
    df = queries.engine_agreement(spark, SMALL)
    dealt, plan = _dealt_to(df), df._jdf.queryExecution().executedPlan().toString()
    assert {dealt[k] for k in ("l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "sample_id")} == {12}
    assert "SortAggregate" not in plan and len(re.findall(r"FileScan parquet .*l_orderkey", plan)) == 1
    said = duckdb.connect().execute("".join(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet';" for t in TABLES) + oracles.SQL["engine_agreement"]).fetchall()
    assert sorted(tuple(r) for r in df.select("drug", "state", "n").collect()) == sorted(said)


def test_engine_states(spark):
    rows = [(s, "d", c) for s, calls in enumerate((["Resistant ", "resistant", None], ["resistant", "susceptible"], [None, "susceptible"], [None, "x"], ["susceptible", " SUSCEPTIBLE"])) for c in calls]
    found = accuracy.engine_agreement(spark.createDataFrame(rows, "sample_id long, drug string, call string"))
    assert found.columns == ["sample_id", "drug", "n_called", "state"]
    assert {r.sample_id: (r.n_called, r.state) for r in found.collect()} == {0: (2, "agreed"), 1: (2, "disagreed"), 2: (1, "single_source"), 3: (0, "unassessed"), 4: (2, "agreed")}


def test_results_are_written_in_tasks_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 500)
    df = queries.QUERIES["stored_results"](spark, SMALL)
    parts = Counter(re.search(r"drug=([^/]*)/", f)[1] for f in df.inputFiles() if "/calls/" in f)
    assert len(parts) == 5 and set(parts.values()) == {12}
    said = duckdb.connect().execute("".join(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet';" for t in TABLES) + oracles.SQL["stored_results"])
    columns = [d[0] for d in said.description]
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, said.fetchall()))
