"""Rules of the cohort operators on hand-made rows, refusals included."""

import collections
import math

from pyspark.sql import functions as F

from isoframe.operators import accuracy, censored, evidence, federated, ledger, strata, testing


def test_abstention_is_not_a_negative(spark):
    rows = [("d", "Resistant ", "R", "L1"), ("d", None, "R", " "), ("d", "not_assessed", "S", None), ("d", "susceptible", "R", "L1"), ("d", "resistant", None, "L1")]
    df = spark.createDataFrame(rows, "drug string, call_a string, phenotype string, lineage string")
    got = {r.lineage: r for r in accuracy.with_rates(accuracy.confusion_by_lineage(df)).collect()}
    assert (got["all"].n_evaluable, got["all"].n_called, got["all"].abstained_r, got["all"].abstained_s) == (4, 2, 1, 1)
    assert got["all"].sensitivity == 0.5 and got["all"].specificity is None
    assert got["unknown"].n_called == 0 and got["unknown"].sensitivity is None


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 12), (19, 19), (0, 0)], "a int, n int")
    low, high = accuracy.wilson(F.col("a"), F.col("n"))
    got = df.select(low.alias("l"), high.alias("h")).collect()
    assert got[0].l == 0 and math.isclose(got[0].h, 0.2425, abs_tol=1e-3) and got[1].h == 1 and got[2].l is None


def test_verdict_states(spark):
    rates = spark.createDataFrame([("a", 50, 0.5, 0.0, 1.0), ("b", 5, 0.5, 0.0, 1.0), ("c", 50, None, 0.0, 1.0), ("x", 50, 0.0, 0.0, 1.0)], "drug string, n_evaluable long, vme_rate double, me_rate double, call_rate double")
    goals = accuracy.targets(spark, [(d, 0.9, 0.9, 0.9, 20) for d in "abc"])
    got = {r.drug: (r.verdict, r.reasons) for r in accuracy.verdicts(rates, goals).collect()}
    assert got == {"a": ("fail", "VME above bound"), "b": ("underpowered", ""), "c": ("pass", "VME not estimable"), "x": ("not-targeted", "")}


def test_censored_parse_and_order(spark):
    df = censored.parsed(spark.createDataFrame([("<=0.25",), (">8",), (" 2 ",), ("NA",), ("",), (None,), ("text",)], "mic string"))
    assert [(r.censoring, r.mic_value) for r in df.collect()] == [("left", 0.25), ("right", 8.0), ("none", 2.0), (None, None), (None, None), (None, None), ("none", None)]
    sides = ["left", "right", "none"]
    pairs = spark.createDataFrame([(a, s, b, t) for a in (0.0, 1.0) for s in sides for b in (0.0, 1.0) for t in sides], "a double, s string, b double, t string")
    got = {(r.a, r.s, r.b, r.t): r.o for r in pairs.withColumn("o", censored.order_of(F.col("a"), F.col("s"), F.col("b"), F.col("t"))).collect()}
    assert got[0.0, "none", 1.0, "none"] == -1 and got[1.0, "none", 1.0, "none"] == 0
    assert got[0.0, "left", 1.0, "none"] == -1 and got[0.0, "left", 0.0, "none"] is None
    assert got[0.0, "left", 0.0, "right"] == -1 and got[1.0, "left", 0.0, "right"] is None
    assert got[0.0, "left", 1.0, "left"] is None and got[1.0, "right", 1.0, "none"] == 1
    assert all(got[b, t, a, s] == (None if o is None else -o) for (a, s, b, t), o in got.items())


def test_shift_equals_all_pairs(spark):
    mic = spark.range(200).select((F.col("id") % 2 == 0).alias("carrier"), F.lit("d").alias("drug"), (F.col("id") % 7).cast("double").alias("log2_bound"), F.element_at(F.array(F.lit("none"), F.lit("left"), F.lit("right")), (F.col("id") % 5 % 3 + 1).cast("int")).alias("censoring"))
    got = censored.shift(mic.where("carrier"), mic.where("NOT carrier"), ["drug"]).first()
    rows = mic.collect()
    order = {}
    pairs = spark.createDataFrame([(a.log2_bound, a.censoring, b.log2_bound, b.censoring) for a in rows if a.carrier for b in rows if not b.carrier], "a double, s string, b double, t string")
    sums = pairs.withColumn("o", censored.order_of(F.col("a"), F.col("s"), F.col("b"), F.col("t"))).agg(F.count("o").alias("n"), F.sum("o").alias("net")).first()
    assert got.n_decisive == sums.n and math.isclose(got.delta, sums.net / sums.n) and not order
    small = censored.shift(mic.where("carrier").limit(3), mic.where("NOT carrier"), ["drug"]).first()
    assert small.delta is None and small.refused == "too few observations"


def test_holm_keeps_gaps_and_ties(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.04), (4, None), (5, 0.9)], "k int, p double")
    got = {r.k: r.holm for r in testing.holm(df).collect()}
    assert got[4] is None and math.isclose(got[1], 0.04) and math.isclose(got[2], 0.12) and got[2] == got[3] and math.isclose(got[5], 0.9)
    assert {r.k: r.survives for r in testing.benjamini_hochberg(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_ledger_reasons(spark):
    import hashlib

    own = lambda seq, payload, prev: hashlib.sha256(f"{seq}|{payload}|{prev}".encode()).hexdigest()
    a = own(0, "a", ledger.GENESIS)
    b = own(1, "b", a)
    good = [(0, "a", ledger.GENESIS, a), (1, "b", a, b)]
    schema = "seq long, payload string, prev_hash string, entry_hash string"
    assert ledger.verify(spark.createDataFrame(good, schema)).count() == 0
    bad = spark.createDataFrame([good[0], (1, "changed", a, b), (3, "d", b, own(3, "d", b))], schema)
    assert {(r.seq, r.reason) for r in ledger.verify(bad).collect()} == {(1, "altered entry"), (3, "gap")}
    twice = ledger.verify(spark.createDataFrame([*good, good[1]], schema)).collect()
    assert [(r.seq, r.reason) for r in twice] == [(1, "repeated")] * 2
    made = ledger.append_entries(spark.createDataFrame([("c", 2, "b"), ("c", 1, "a"), ("d", 1, "a")], "chain string, o int, p string"), "chain", "o", "p")
    assert {(r.chain, r.seq): r.entry_hash for r in made.collect()} == {("c", 0): a, ("c", 1): b, ("d", 0): a}


def test_refused_events_leave_the_state(spark):
    rows = [("k", 1, "open", "r"), ("k", 2, "close", "r"), ("k", 3, "review", " "), ("k", 4, "review", "r"), ("k", 5, "close", "r"), ("j", 1, "close", None)]
    events = spark.createDataFrame(rows, "key string, n long, action string, reviewer string")
    told = ledger.replay(events, {"start": ["open"], "open": ["review"], "review": ["close"]}, "key", "n", "action", ("reviewer",))
    got = {(r.key, r.n): (r.previous, r.allowed) for r in told.collect()}
    assert got == {("k", 1): ("start", True), ("k", 2): ("open", False), ("k", 3): ("open", False), ("k", 4): ("open", True), ("k", 5): ("review", True), ("j", 1): ("start", False)}
    assert {r.key: (r.state, r.n_refused) for r in ledger.states(told, "key", "n", "action").collect()} == {"k": ("close", 2), "j": (None, 1)}


def test_nothing_missing_becomes_a_negative(spark):
    kind = "isolate_id long, drug string, call string, tier string, scope string, asserts_coverage boolean, engine string"
    s = ("susceptible", "catalogued", "isolate", True)
    rows = [(1, "d", *s, "e"), (2, "d", *s, "x"), (3, "d", "resistant", "inferred", "variant", False, "e"), (3, "d", *s, "e"), (4, "d", "susceptible", "catalogued", "variant", False, "e"), (6, "d", "susceptible", "phenotypic", "isolate", False, None), (7, "d", *s, "x")]
    gate = spark.createDataFrame([(1, "d", False), (2, "d", True), (3, "d", True), (4, "d", False), (5, "d", True), (6, "d", False), (7, "d", False), (8, "d", True)], "isolate_id long, drug string, adequate boolean")
    allowed = spark.createDataFrame([(1, "d", "e"), (3, "d", "e"), (5, "d", "catalogue")], "isolate_id long, drug string, engine string")
    got = {r.isolate_id: (r.call, r.reason) for r in evidence.reconcile(spark.createDataFrame(rows, kind), gate, allowed).collect()}
    assert got == {
        1: ("susceptible", "asserted"), 2: ("indeterminate", "no scope"), 3: ("indeterminate", "conflict"), 4: ("not_assessed", "loci"), 5: ("susceptible", "catalogue"), 6: ("susceptible", "phenotype"),
        7: ("indeterminate", "no scope"), 8: ("indeterminate", "no scope"),
    }


def test_suppression_drops_small_cells(spark):
    rows = [(k, k, 0, "d", "R", None, 1) for k in range(6)] + [(9, 9, 0, "d", "R", None, 2)]
    obs = spark.createDataFrame(rows, "arrival long, isolate_id long, site_id int, drug string, phenotype string, lineage string, variant long")
    assert federated.suppressed(obs).count() == 6
    assert {r.variant for r in federated.small_cells(obs, min_sites=1).collect()} == {2}


def test_partitioning_does_not_matter(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 37 % 101 / 200).alias("p"))
    one, many = (sorted((r.k, r.holm) for r in testing.holm(df.repartition(n)).collect()) for n in (1, 13))
    assert one == many


def test_strata_leave_out_the_candidate_and_the_not_assessed(spark):
    isolates = [(k, k % 2, None if k % 3 == 0 else "L1") for k in range(60)]
    carriage = [(k, label) for k in range(60) for j, label in enumerate(("d1", "d2", "e1", "c1")) if (k * 7 + j * 5) % (j + 3) == 0]
    determinants = [("A", "d1"), ("A", "d2"), ("B", "e1")]
    unassessed = [(k, label) for k in range(60) for j, label in enumerate(("d1", "c1", "zz")) if (k + j) % 5 < 2]
    labels, drugs = ["d1", "e1", "c1"], ["A", "B"]
    held, gaps = set(carriage), set(unassessed)

    def brute(gaps):
        want = {}
        for label in labels:
            for drug in drugs:
                key = lambda k: "+".join(sorted(x for d, x in determinants if d == drug and x != label and (k, x) in held))
                groups = collections.defaultdict(lambda: [0, 0])
                for k, site, lineage in isolates:
                    if (k, label) in held:
                        groups[key(k), lineage, site][0] += 1
                    elif (k, label) not in gaps:
                        groups[key(k), lineage, site][1] += 1
                want |= {(label, drug, *g): tuple(n) for g, n in groups.items() if n[0]}
        return want

    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    people, has, known = made(isolates, "isolate_id long, site_id int, lineage string"), made(carriage, "isolate_id long, label string"), made(determinants, "drug string, label string")
    placed, candidates = strata.background(people, has, known), made([(x,) for x in labels], "label string")
    for missing, want in ((None, brute(set())), (made(unassessed, "isolate_id long, label string"), brute(gaps))):
        got = strata.carriers(placed, has, candidates, known, missing).collect()
        assert {(r.label, r.drug, r.background, r.lineage, r.site_id): (r.n_carriers, r.n_others) for r in got} == want and len(got) == len(want)
