"""The organism rule, the mechanism queue, sample pages and rows for readers: odd input, and plain loops beside them."""

import collections

from pyspark.sql import functions as F

from isoframe.functions.display import given, percent, readable, readable_all, variant_name, whole
from isoframe.operators import evidence, lanes, mechanisms, reports, shown

PAIRS = "isolate_id long, drug string"
STATES = "isolate_id long, organism string, subspecies string, erm41_status string, rrl_status string, note string"


def test_silence_under_an_organism_rule_stays_open(spark):
    full = ("abscessus", "nonfunctional", "wild_type")
    states = [(1, "mabscessus", *full, "x"), (2, "mabscessus", " ", "functional", "wild_type", "x"), (3, "mtbc", None, None, None, "x"), (4, None, *full, None), (5, " ", None, "nonfunctional", "wild_type", None), (7, "mabscessus", *full, "a"), (7, "mabscessus", "abscessus", "nonfunctional", None, "b")]
    pairs = [(k, d) for k in range(1, 8) for d in ("clarithromycin", "amikacin")] + [(2, "clarithromycin"), (None, "clarithromycin")]
    made = lambda rows, kind: spark.createDataFrame(rows, kind)
    told = evidence.organism_refusals(made(pairs, PAIRS), made(states, STATES))
    assert {(r.isolate_id, r.drug): r.unmet for r in told.collect()} == {
        (2, "clarithromycin"): "subspecies,erm41_status", (5, "clarithromycin"): "subspecies", (6, "clarithromycin"): "subspecies,erm41_status,rrl_status", (7, "clarithromycin"): "rrl_status", (None, "clarithromycin"): "subspecies,erm41_status,rrl_status",
    }
    kind = "isolate_id long, drug string, call string, tier string, scope string, asserts_coverage boolean, engine string"
    own = ("susceptible", "catalogued", "isolate", True, "e")
    rows = [(2, "clarithromycin", *own), (1, "clarithromycin", *own), (5, "clarithromycin", "resistant", "catalogued", "isolate", False, "e"), (6, "clarithromycin", "susceptible", "phenotypic", "isolate", False, None)]
    gate = made([(k, "clarithromycin", k != 7) for k in range(1, 8)], "isolate_id long, drug string, adequate boolean")
    allowed = made([(1, "clarithromycin", "e"), (2, "clarithromycin", "e")], "isolate_id long, drug string, engine string")
    got = {r.isolate_id: (r.genomic_call, r.call, r.reason) for r in evidence.reconcile(made(rows, kind), gate, allowed, refused=told).collect()}
    assert got == {
        1: ("susceptible", "susceptible", "asserted"), 2: ("indeterminate", "indeterminate", "organism"), 3: ("indeterminate", "indeterminate", "no scope"), 4: ("indeterminate", "indeterminate", "no scope"),
        5: ("resistant", "resistant", "evidence"), 6: ("indeterminate", "susceptible", "phenotype"), 7: ("indeterminate", "indeterminate", "organism"),
    }
    assert evidence.organism_refusals(made([], PAIRS), made([], STATES)).count() == 0 and evidence.organism_refusals(made(pairs, PAIRS), made(states, STATES), {}).where("unmet <> ''").count() == 0


VARIANTS = "sample_id long, variant_key string, label string, gene string, region string, consequence string, kind string"


def test_every_indeterminate_mechanism_has_one_row(spark):
    rows = [
        (1, "k1", "r_L1R", "r", "coding", "frameshift", "x"), (1, "k1", "r_L1R", "r", "coding", "frameshift", "x"), (1, "k2", "r_A2A", "r", "coding", "synonymous", "x"), (2, "k3", "r_c.-5", "r", "promoter", None, "x"), (2, "k4", "p_c.-9", "p", "intergenic", "upstream", None),
        (2, "k5", "p_S1T", "p", "coding", "missense", None), (3, "k6", None, None, "promoter", "missense", None), (None, None, "r_x", "r", None, "missense", None),
    ]
    variants = spark.createDataFrame(rows, VARIANTS)
    regulators, promoters = spark.createDataFrame([("r", "d1"), ("r", "d2"), ("r", "d2"), ("q", "d9")], "gene string, drug string"), spark.createDataFrame([("r", "d2"), ("r", "d3"), ("p", "d3"), (None, "d4")], "gene string, drug string")
    queue = mechanisms.mechanism_queue(variants, regulators, promoters)
    got = sorted(((r.sample_id, r.variant_key, r.drug, r.kind) for r in queue.collect()), key=repr)
    assert got == sorted([
        (1, "k1", "d1", "regulator lost"), (1, "k1", "d2", "regulator lost"), (2, "k3", "d1", "regulator altered"), (2, "k3", "d2", "regulator altered"), (2, "k3", "d3", "upstream"), (2, "k4", "d3", "upstream"),
        (None, None, "d1", "regulator altered"), (None, None, "d2", "regulator altered"),
    ], key=repr)
    spoken = lanes.regulator_evidence(variants, regulators, promoters)
    assert sorted(((r.sample_id, r.variant_key, r.drug) for r in spoken.collect()), key=repr) == sorted((g[:3] for g in got), key=repr)
    one = queue.where("kind = 'regulator lost' AND drug = 'd1'").first()
    assert "r mutant" in one.experiments[0] and "d1" in one.experiments[1] and len(one.gaps) == len(one.experiments) == 2 and "{" not in one.hypothesis + "".join(one.experiments)
    cards = {(r.variant_key, r.drug): r for r in mechanisms.mechanism_cards(queue).collect()}
    assert cards["k4", "d3"].title == "p c.-9 - D3" and cards["k4", "d3"].tags == ["Indeterminate", "p", "evidence gap"] and " Missing: " in cards["k4", "d3"].body and " Resolved by: " in cards["k4", "d3"].body
    assert mechanisms.mechanism_queue(variants.limit(0), regulators, promoters).count() == 0 and mechanisms.mechanism_cards(queue.limit(0)).count() == 0


def test_pages_of_a_sample_lose_no_item(spark):
    results = [(k, f"d{j}", "resistant" if j % 2 else "not_assessed", "x") for k in (1, 2) for j in range(40 if k == 1 else 2)] + [(1, "d1", "resistant", "x"), (None, "d1", "resistant", "x"), (4, None, "resistant", "x")]
    coverage = [(1, f"g{j}", j / 50, 10.0) for j in range(23)] + [(1, "g3", 0.9, None), (1, "g4", None, None), (3, "g1", None, None), (3, None, 0.5, 1.0)]
    found = [(1, f"g{j}_v", f"g{j}", d, "indeterminate", "inferred") for j in range(31) for d in ("d1", "d2")] + [(2, None, "g1", "d1", "resistant", "catalogued"), (2, None, None, "d1", "resistant", "catalogued")]
    contexts = [(2, "s1", " ", "mtbc"), (5, None, "L4", None), (5, None, "L5", None), (None, "s", "L", "o")]
    made = lambda rows, kind: spark.createDataFrame(rows, kind)
    tables = (made(results, "sample_id long, drug string, call string, page string"), made(coverage, "sample_id long, locus string, callable_fraction double, mean_depth double"), made(found, "sample_id long, label string, gene string, drug string, call string, tier string"), made(contexts, "sample_id long, site_id string, lineage string, organism string"))
    whole_, paged = (reports.sample_pages(*tables, page=n).collect() for n in (1000, 7))
    assert {r.sample_id: (r.page, r.site, r.lineage, r.organism, r.assay, len(r.calls), len(r.variants), len(r.loci)) for r in whole_} == {
        1: (0, "Not recorded", "Untyped", "Not recorded", "Unknown", 40, 31, 23), 2: (0, "s1", "Untyped", "mtbc", "Unknown", 2, 1, 0), 3: (0, "Not recorded", "Untyped", "Not recorded", "Unknown", 0, 0, 1), 5: (0, "Not recorded", "L4", "Not recorded", "Unknown", 0, 0, 0),
    }
    pages = collections.Counter(r.sample_id for r in paged)
    assert pages[1] > 3 and pages[2] == pages[3] == pages[5] == 1
    for field in ("calls", "variants", "loci"):
        merged = collections.defaultdict(list)
        for r in paged:
            merged[r.sample_id] += r[field]
        assert {k: sorted(v) for k, v in merged.items()} == {r.sample_id: sorted(r[field]) for r in whole_}
    first = {r.sample_id: r for r in whole_}
    assert {x.locus: x.callable_fraction for x in first[1].loci}["g3"] == 0.9 and {x.locus: x.callable_fraction for x in first[1].loci}["g4"] == 4 / 50 and first[2].variants[0].variant == "g1"
    assert {x.drug for x in first[1].variants} == {"D1"} and first[3].loci[0].callable_fraction is None
    assert reports.sample_pages(*[t.limit(0) for t in tables]).count() == 0


def test_tokens_are_written_for_readers(spark):
    words = {
        "not_assessed": "Not assessed", "likelyResistant": "Likely resistant", "mic": "MIC", "SNV_count": "SNV count", "DNA gyrase": "DNA gyrase", "EFFLUX": "Efflux", "RIF": "RIF", "in_vitro.mic-shift": "In vitro MIC shift", "rpoB_S450L": "Rpo B S450 L", " ": None, None: None, "--": "--", "gene mmpR5x": "Gene mmp r5x", "é_test": "É test",
    }
    rows = spark.createDataFrame([(k,) for k in words], "t string").select("t", readable(F.col("t")).alias("r"), readable_all(F.array("t", F.lit("qc"), F.lit(" "))).alias("all"), readable_all(F.array(F.lit(" "))).alias("none")).collect()
    assert {r.t: r.r for r in rows} == words and all(r["none"] is None for r in rows)
    assert {r.t: r["all"] for r in rows}["not_assessed"] == "Not assessed, QC" and {r.t: r["all"] for r in rows}[None] == "QC"
    names = spark.createDataFrame([("g_c_1",), ("g",), (" ",), (None,), ("_x",)], "t string").select(variant_name(F.col("t"))).collect()
    assert [r[0] for r in names] == ["g c_1", "g", None, None, " x"]
    numbers = spark.createDataFrame([("0.95",), ("1",), ("96.555",), ("n/a",), (" ",), (None,), ("0",), ("NaN",), ("-3",)], "t string").select(percent(F.col("t")).alias("p"), whole(F.col("t")).alias("w")).collect()
    assert [r.p for r in numbers] == [95.0, 100.0, 96.56, None, None, None, 0.0, None, -300.0] and [r.w for r in numbers] == [None, 1, None, None, None, None, 0, None, -3]
    df = spark.createDataFrame([(" ", "b", 0)], "x string, y string, z int")
    assert df.select(given(df, "w", "x", "y"), given(df, "z"), given(df, "w")).first()[:] == ("b", "0", None)


def test_rows_for_readers_take_what_is_missing(spark):
    """Tables without the optional columns, with clashing further columns, with nulls and repeated rows, and empty ones."""
    made = lambda rows, kind: spark.createDataFrame(rows, kind)
    models = made([("m", None, 0.5), ("m", None, 0.5), (None, "RIF", None)], "model string, drug string, verdict_key double")
    targets, audit = made([(None, "g1"), (" ", None), ("t", "g2")], "target string, gene string"), made([("open_case", None, None)], "action string, actor string, at string")
    watch, tickets = made([(None, 5), ("rif", None)], "drug string, n_isolates long"), made([("0123456789abcdef", 7, "no_call", None)], "ticket_id string, sample_id long, genomic_call string, status string")
    pairs = made([(1, 2, None, "a_b", None)], "sample_id long, rule long, drug string, key_a string, key_b string")
    claims, links = made([("g_x", 4.5)], "variant string, ligand_distance double"), made([(1, 2, None, None)], "sample_id long, observation_id long, gene string, drugs string")
    predicted, rows = made([(None, None, "m1")], "variant string, drug string, model string"), made([(1, "<=0.25 ", None)], "isolate_id long, mic string, call string")
    cases = [(shown.model_rows, models, 3), (shown.target_rows, targets, 2), (shown.audit_rows, audit, 1), (shown.watch_rows, watch, 1), (shown.ticket_rows, tickets, 1), (shown.epistasis_rows, pairs, 1), (shown.structural_rows, claims, 1), (shown.expression_rows, links, 1), (shown.prediction_rows, predicted, 1), (shown.concentration_rows, rows, 1)]
    told = {}
    for view, table, n in cases:
        told[view.__name__] = view(table).collect()
        assert len(told[view.__name__]) == n and view(table.limit(0)).collect() == []
    first = {k: v[0].asDict() for k, v in told.items()}
    assert first["model_rows"]["verdict_key"] == "not-supplied" and first["model_rows"]["drug"] == "Not supplied" and first["model_rows"]["call_rate"] is None and first["model_rows"]["registry_ready"] is False
    assert first["target_rows"]["target"] == "g1" and first["audit_rows"]["event"] == "Open case" and first["audit_rows"]["actor"] == "unknown"
    assert first["watch_rows"]["unresolved_isolates"] is None and first["ticket_rows"]["ticket"] == "0123456789ab" and first["ticket_rows"]["status_key"] == "open" and first["ticket_rows"]["genomic_call"] == "No call"
    assert first["epistasis_rows"]["pair"] == "a b" and first["structural_rows"]["distance"] == "4.5" and first["expression_rows"]["drugs"] == "None" and first["prediction_rows"]["variant"] == "Not supplied" and first["concentration_rows"]["value"] == "<=0.25"
    areas = made([(1, "a1", None), (1, "a0", "g"), (None, "n", "g")], "area long, name string, gene string")
    matches = made([(1, 5, "g_x", "label"), (2, 5, None, "place")], "area long, sample_id long, variant_key string, matched_by string")
    assert sorted((r.area, r.name, r.gene, r.variant, r.type) for r in shown.regulatory_rows(matches, areas).collect()) == [("1", "a0", "g", "g x", "Unknown"), ("2", "Not supplied", "Not supplied", "Not supplied", "Unknown")]
    groups, classes = made([(1, 0.1, 2, 0.1), (1, 0.5, 3, 0.52)], "sample_id long, group double, size long, median_vaf double"), made([(1, "possible_coinfection"), (2, None)], "sample_id long, classification string")
    assert {r.sample_id: (r.classification, r.n_groups, [tuple(g) for g in r.groups]) for r in shown.population_rows(groups, classes).collect()} == {1: ("Possible coinfection", 2, [(0.1, 2, "Not assigned"), (0.52, 3, "Not assigned")]), 2: ("Indeterminate", 0, [])}
    profile = made([("d1", "a"), ("d1", "b"), ("d1", "b"), ("d2", None), ("d3", "a")], "drug string, locus string")
    assert {r.drug: (r.n_loci, r.n_kept, r.missing, r.supported) for r in shown.panel_rows(profile, made([("a",), ("a",)], "locus string")).collect()} == {"D1": (2, 1, ["b"], False), "D2": (0, 0, [], False), "D3": (1, 1, [], True)}
