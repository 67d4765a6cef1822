"""Queries of streams and of tables read from text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isoframe.operators import federated, ledger
from isoframe.plans.bindings import bound, rounded, with_bindings
from isoframe.sources import tables
from isoframe.sources.scratch import shared_path, stored
from isoframe.streaming import intake, monitoring

SECRETS = {str(k): f"secret-{k}" for k in range(10)}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def _through(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """The table that a stream appends to, after all of it has come."""
    table = shared_path(spark, name)
    intake.append(stream, table, shared_path(spark, f"{name}-checkpoint")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(table)


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions of 12 sites, of which 10 are known: most signed, some forged, some with observations of another site."""
    e = _events(spark, sf_dir)
    sent, site = F.col("ts") - F.make_interval(hours=F.col("event_id") % 40 - 3), (F.col("user_id") % 12).cast("string")
    named = F.when(F.col("event_id") % 13 == 6, (F.col("user_id") % 12 + 1).cast("string")).otherwise(site)
    rows = e.select(
        F.col("event_id").alias("submission_id"), (F.col("event_id") * 7 % 500).alias("nonce"), site.alias("site_id"), F.col("ts").alias("received"), sent.alias("sent"),
        F.to_json(F.array(F.struct(named.alias("site_id"), F.col("props").alias("said")))).alias("payload"),
    )
    keyed = rows.join(intake.pads(spark, SECRETS).hint("broadcast"), F.col("site_id") == F.col("_site"), "left")
    signature = F.when(F.col("submission_id") % 17 == 0, "forged").otherwise(intake.keyed_hash(F.col("payload")))
    return keyed.withColumn("signature", signature).drop("_site", "_inner", "_outer")


def submission_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every submission of a stream with the reason for which it is refused; replays are what is accepted but for its nonce."""
    rows = intake.signed(_submissions(spark, sf_dir), SECRETS).withColumn("mismatch", intake.of_other_site(F.col("payload"), F.col("site_id")))
    return _through(spark, intake.checked(rows).select("submission_id", "site_id", "nonce", "reject_reason"), "submissions")


def accepted_nonces(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = intake.checked(_submissions(spark, sf_dir).withColumn("valid", F.lit(True)))
    return _through(spark, intake.accepted(told, "3650 days").select("nonce"), "accepted")


def streamed_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("ticket_id"), "event_id", F.col("event_type").alias("action"), F.when(F.col("value") > 5, "r").alias("reviewer"), F.lit("because").alias("rationale"))
    allowed = {"new": ["signup", "view"], "signup": ["view", "click"], "view": ["click", "purchase", "view"], "click": ["purchase", "view"], "purchase": ["view"], "error": ["view"]}
    return _through(spark, intake.ticket_states(e, allowed), "tickets")


def streamed_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of the stream, read after all of it has come (complete mode)."""
    name = f"trend_{shared_path(spark, 'trend').rsplit('-', 1)[1]}"
    out = monitoring.trend(_events(spark, sf_dir), ["event_type"], "6 hours", lateness="3650 days")
    out.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_path(spark, "trend-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    held = stored(spark.table(name), "trend")
    spark.catalog.dropTempView(name)
    return rounded(held.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on time and late of a table that is streamed a second time, in pieces of a file each."""
    spread = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 4).alias("piece"))
    source = shared_path(spark, "late-source")
    for piece in range(4):
        spread.where(F.col("piece") == piece).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spread.schema).option("maxFilesPerTrigger", 1).parquet(source)
    on_time, late = shared_path(spark, "on-time"), shared_path(spark, "late")
    intake.split_late(stream, on_time, late, shared_path(spark, "late-checkpoint"), "ts", 86_400).awaitTermination()
    read = lambda t, kind: spark.read.schema(spread.schema).parquet(t).agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return read(on_time, "on time").unionByName(read(late, "late"))


def streamed_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation records and retractions that come as a stream, and the verdicts they leave."""
    e = _events(spark, sf_dir)
    kind = F.when(F.col("event_type") == "error", "retract").otherwise("record")
    rows = e.select(
        kind.alias("kind"), (F.col("user_id") % 20).alias("variant"), F.lit("d").alias("drug"), F.col("event_id").alias("arrival"), F.when(F.col("value") < 60, "resistant").otherwise("susceptible").alias("result"), F.col("user_id").alias("isolate_id"),
        (F.col("event_id") % 5).alias("site_id"), F.concat(F.lit("L"), (F.col("event_id") % 3).cast("string")).alias("lineage"), (F.col("event_id") % 50).cast("int").alias("record_index"),
    )
    return intake.validation_verdicts(_through(spark, rows, "validations"))


def appended_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a ledger that came as a stream, each with the first reason for which its chain breaks there (none)."""
    rows = _through(spark, _events(spark, sf_dir).select("user_id", "event_id", "event_type"), "ledger")
    entries = stored(ledger.append_entries(rows, "user_id", "event_id", "event_type"), "entries")
    return entries.join(ledger.verify(entries, ["user_id"]).hint("merge"), ["user_id", "seq"], "left").select("user_id", "seq", "payload", "entry_hash", "reason")


def _table_text(spark: SparkSession, sf_dir: str) -> str:
    """Delimited files, each with a header, one of them with a comment; the header starts with a byte order mark."""
    path = shared_path(spark, "table")
    rows = bound(spark, sf_dir, "labs").select(F.col("observation_id").cast("string").alias("\ufeffobservation_id"), F.col("isolate_id").cast("string"), "drug", "result", "quality")
    rows.write.option("header", True).option("sep", "\t").csv(path)
    more = spark.createDataFrame([("\t".join(rows.columns),), ("# a comment",), ("",)], "value string")
    more.coalesce(1).write.mode("append").text(path)
    return path


def delimited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_table(spark, _table_text(spark, sf_dir), "\t", ("observation_id", "drug"))


def renamed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    export = bound(spark, sf_dir, "entries").select(F.col("label").alias("Mutation "), F.col("drug").alias("DRUG"), F.col("call").alias("Final grading"), F.col("variant_key").alias("unused"))
    return tables.renamed(export, {"label": ("mutation", "variant"), "drug": ("drug_name",), "call": ("grade", "final grading")}, ("label", "drug"))


def loaded_truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "labs").select(F.col("isolate_id").alias("sample_id"), "drug", F.upper(F.substring("result", 1, 1)).alias("phenotype"), F.when(F.col("quality") == "pass", " high").otherwise("low").alias("quality"), "observation_id")
    return tables.truths(rows, "observation_id")


def loaded_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "labs").select("isolate_id", "drug", F.when(F.col("observation_id") % 3 == 0, F.upper(F.substring("result", 1, 1))).otherwise(F.col("result")).alias("predicted"), (F.col("observation_id") % 10 / 10).cast("string").alias("confidence"))
    return rounded(tables.predictions(rows))


def loaded_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bound(spark, sf_dir, "performance").groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.upper("drug").alias("k"), F.struct(F.col("call_rate").cast("string").alias("coverage"), F.when(F.col("error_rate") > 0.04, "none").otherwise(F.col("error_rate").cast("string")).alias("error_rate")).alias("v"))))).alias("m"))
    texts = rows.select("model", F.when(F.col("model") < "m5", F.to_json(F.struct(F.col("m").alias("baselines")))).otherwise(F.to_json("m")).alias("value"))
    alike = Window.partitionBy("drug", "base_coverage", "base_risk")
    return tables.baselines(texts).withColumn("n", F.count("*").over(alike))


def json_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labs = bound(spark, sf_dir, "labs").select("isolate_id", F.struct("observation_id", "drug", "result", "mic").alias("o"))
    files = labs.groupBy(F.col("isolate_id").cast("string").alias("file")).agg(F.collect_list("o").alias("observations"))
    value = F.when(F.col("file").cast("long") % 9 == 2, "nothing").otherwise(F.to_json(F.struct("observations")))
    rows, failed = tables.json_rows(files.select("file", value.alias("value")), "observation_id: bigint, drug: string, result: string, mic: double", "observations")
    return rows.withColumn("mic", F.floor(F.col("mic") * 1000)).withColumn("reason", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written with a manifest and read back: the rows of one, with what the manifest says of its size."""
    folder = shared_path(spark, "results")
    parts = {"calls": bound(spark, sf_dir, "results"), "labs": bound(spark, sf_dir, "labs")}
    tables.write_results(parts, folder, {"cohort": "c1"}, {"calls": "drug"})
    facts = spark.read.schema("manifest map<string, string>").json(f"{folder}/manifest").select(F.col("manifest")["cohort"].alias("cohort"), F.col("manifest")["n_calls"].alias("n_calls"))
    # The manifest is one row.
    return spark.read.schema(parts["calls"].schema).parquet(f"{folder}/calls").select("sample_id", "drug", "site_id", "genomic_call", "phenotypic_call", "call").crossJoin(F.broadcast(facts))


def promotion_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_size > 40").select(F.col("p_partkey").alias("variant"))
    obs = bound(spark, sf_dir, "observations")
    found = federated.promotion(obs, known, {"min_n": 5, "min_fraction": 0.3, "min_sites": 3, "min_s": 10, "min_lineages": 2, "min_lineage_n": 2, "max_cooccurrence": 0.9})
    return rounded(found)


def provisional_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(federated.provisional(promotion_gates(spark, sf_dir), bound(spark, sf_dir, "observations").where("variant % 2 = 0").select("variant", "drug").distinct()))


_REPLAYED = """WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
rp AS (SELECT user_id, event_id, event_type AS action, 'new' AS previous, coalesce(value > 5, false) AND event_type IN ('signup', 'view') AS allowed, k FROM ev WHERE k = 1
  UNION ALL SELECT e.user_id, e.event_id, e.event_type, CASE WHEN rp.allowed THEN rp.action ELSE rp.previous END, coalesce(e.value > 5, false) AND CASE CASE WHEN rp.allowed THEN rp.action ELSE rp.previous END WHEN 'new' THEN e.event_type IN ('signup', 'view') WHEN 'signup' THEN e.event_type IN ('view', 'click')
    WHEN 'view' THEN e.event_type IN ('click', 'purchase', 'view') WHEN 'click' THEN e.event_type IN ('purchase', 'view') WHEN 'purchase' THEN e.event_type = 'view' WHEN 'error' THEN e.event_type = 'view' ELSE false END, e.k FROM rp JOIN ev AS e ON e.user_id = rp.user_id AND e.k = rp.k + 1)
"""
_PROMOTED = """, kn AS (SELECT arrival, isolate_id, site_id, drug, phenotype, variant, coalesce(lineage, 'unknown') AS lineage FROM observations WHERE phenotype IN ('R', 'S')),
of AS (SELECT drug, isolate_id, variant, MIN(arrival) AS arrival FROM kn WHERE variant IS NOT NULL GROUP BY drug, isolate_id, variant),
o1 AS (SELECT DISTINCT k.variant AS variant, k.drug AS drug, k.isolate_id AS isolate_id, k.arrival AS arrival, k.phenotype AS phenotype, k.site_id AS site_id, k.lineage AS lineage FROM kn AS k JOIN of ON of.drug = k.drug AND of.isolate_id = k.isolate_id AND of.variant = k.variant AND of.arrival = k.arrival),
a1 AS (SELECT variant, drug, COUNT(*) AS n, COUNT(CASE WHEN phenotype = 'R' THEN 1 END) AS n_r, COUNT(CASE WHEN phenotype = 'S' THEN 1 END) AS n_s, COUNT(DISTINCT site_id) AS n_sites FROM o1 GROUP BY variant, drug),
l1 AS (SELECT variant, drug, lineage, COUNT(*) AS n, COUNT(CASE WHEN phenotype = 'R' THEN 1 END) AS r FROM o1 GROUP BY variant, drug, lineage),
l2 AS (SELECT variant, drug, COUNT(CASE WHEN n >= 2 AND r >= 0.3 * n THEN 1 END) AS n_lineages FROM l1 GROUP BY variant, drug),
o2 AS (SELECT drug, phenotype, row_number() OVER (PARTITION BY drug, isolate_id ORDER BY arrival) AS k FROM kn), c1 AS (SELECT drug, COUNT(*) AS n_all, COUNT(CASE WHEN phenotype = 'S' THEN 1 END) AS cohort_s FROM o2 WHERE k = 1 GROUP BY drug),
w1 AS (SELECT DISTINCT arrival, isolate_id, drug, variant FROM kn WHERE variant IS NOT NULL),
x1 AS (SELECT o.variant AS variant, o.drug AS drug, w.variant AS other, COUNT(*) AS c FROM o1 AS o JOIN w1 AS w ON w.arrival = o.arrival AND w.isolate_id = o.isolate_id AND w.drug = o.drug AND w.variant <> o.variant GROUP BY o.variant, o.drug, w.variant),
x2 AS (SELECT *, row_number() OVER (PARTITION BY variant, drug ORDER BY c DESC, other) AS k FROM x1),
x3 AS (SELECT x.variant AS variant, x.drug AS drug, COUNT(*) AS bad FROM x2 AS x JOIN a1 ON a1.variant = x.variant AND a1.drug = x.drug JOIN part ON p_partkey = x.other AND p_size > 40 WHERE k <= 5 AND n_r > 0 AND c >= 0.9 * n_r GROUP BY x.variant, x.drug),
pm AS (SELECT a1.*, n_lineages, cohort_s, CAST(n_r AS DOUBLE) / n AS f, concat_ws(',', CASE WHEN n < 5 THEN 'isolates' END, CASE WHEN CAST(n_r AS DOUBLE) / n < 0.3 THEN 'fraction' END, CASE WHEN n_sites < 3 THEN 'sites' END, CASE WHEN cohort_s < 10 THEN 'susceptible cohort' END, CASE WHEN n_all - n <= 0 THEN 'controls' END,
  CASE WHEN n_lineages < 2 THEN 'lineages' END, CASE WHEN bad IS NOT NULL THEN 'co-occurrence' END) AS failed FROM a1 JOIN c1 ON c1.drug = a1.drug JOIN l2 ON l2.variant = a1.variant AND l2.drug = a1.drug LEFT JOIN x3 ON x3.variant = a1.variant AND x3.drug = a1.drug)"""

QUERIES = {f.__name__: f for f in (
    submission_intake, accepted_nonces, streamed_tickets, streamed_trend, late_rows, streamed_verdicts, appended_ledger, delimited_table, renamed_entries, loaded_truths, loaded_predictions, loaded_baselines,
    json_observations, stored_results, promotion_gates, provisional_entries,
)}
#: Which rows are late depends on how a stream is cut, so late_rows has no SQL; a test streams a fixed sequence.
SQL = {
    "submission_intake": """SELECT event_id AS submission_id, CAST(user_id % 12 AS VARCHAR) AS site_id, event_id * 7 % 500 AS nonce, CASE WHEN event_id % 17 = 0 OR user_id % 12 > 9 THEN 'signature' WHEN event_id % 13 = 6 THEN 'site' WHEN event_id % 40 - 3 > 24 THEN 'stale' WHEN event_id % 40 - 3 < -1 THEN 'future' END AS reject_reason FROM events""",
    "accepted_nonces": "SELECT DISTINCT event_id * 7 % 500 AS nonce FROM events WHERE event_id % 40 - 3 BETWEEN -1 AND 24",
    "streamed_tickets": _REPLAYED + "SELECT CAST(user_id AS VARCHAR) AS ticket_id, event_id, action, previous, allowed FROM rp",
    "streamed_trend": "SELECT event_type, strftime(time_bucket(INTERVAL 6 HOUR, CAST(ts AS TIMESTAMP), TIMESTAMP '1970-01-01 00:00:00'), '%Y-%m-%d %H:%M:%S') AS start, COUNT(value) AS n, round(AVG(value), 6) + 0.0 AS mean FROM events GROUP BY 1, 2",
    "streamed_verdicts": """WITH rc AS (SELECT user_id % 20 AS variant, event_id, value < 60 AS r, user_id, event_id % 5 AS site, 'L' || CAST(event_id % 3 AS VARCHAR) AS lineage, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS i FROM events WHERE event_type <> 'error'),
gone AS (SELECT DISTINCT user_id % 20 AS variant, event_id % 50 AS i FROM events WHERE event_type = 'error'), lf AS (SELECT rc.* FROM rc LEFT JOIN gone AS g ON g.variant = rc.variant AND g.i = rc.i WHERE g.i IS NULL)
SELECT variant, 'd' AS drug, CASE WHEN COUNT(DISTINCT r) > 1 THEN 'indeterminate' WHEN bool_and(r) THEN 'resistant' ELSE 'susceptible' END AS call, COUNT(*) AS n_records, COUNT(DISTINCT user_id) AS n_isolates, COUNT(DISTINCT site) AS n_sites, string_agg(DISTINCT lineage, ',' ORDER BY lineage) AS lineages FROM lf GROUP BY variant""",
    "appended_ledger": """WITH RECURSIVE ev AS (SELECT user_id, event_type AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
lc AS (SELECT user_id, seq, payload, sha256('0|' || payload || '|' || repeat('0', 64)) AS entry_hash FROM ev WHERE seq = 0
  UNION ALL SELECT ev.user_id, ev.seq, ev.payload, sha256(CAST(ev.seq AS VARCHAR) || '|' || ev.payload || '|' || lc.entry_hash) FROM lc JOIN ev ON ev.user_id = lc.user_id AND ev.seq = lc.seq + 1)
SELECT user_id, seq, payload, entry_hash, CAST(NULL AS VARCHAR) AS reason FROM lc""",
    "delimited_table": with_bindings("labs", " SELECT CAST(observation_id AS VARCHAR) AS observation_id, CAST(isolate_id AS VARCHAR) AS isolate_id, drug, result, quality FROM labs"),
    "renamed_entries": with_bindings("entries", " SELECT label, drug, call FROM entries"),
    "loaded_truths": with_bindings("labs", " SELECT CAST(isolate_id AS VARCHAR) AS isolate_id, lower(drug) AS drug, arg_max(result, observation_id) AS truth FROM labs WHERE result <> 'indeterminate' AND quality = 'pass' GROUP BY isolate_id, drug"),
    "loaded_predictions": with_bindings("labs", " SELECT CAST(isolate_id AS VARCHAR) AS isolate_id, lower(drug) AS drug, CASE WHEN result <> 'indeterminate' THEN result END AS predicted, round(observation_id % 10 / CAST(10 AS DOUBLE), 6) + 0.0 AS confidence FROM labs"),
    "loaded_baselines": with_bindings("performance", " SELECT lower(drug) AS drug, call_rate AS base_coverage, error_rate AS base_risk, COUNT(*) OVER (PARTITION BY lower(drug), call_rate, error_rate) AS n FROM performance WHERE error_rate <= 0.04"),
    "json_observations": with_bindings("labs", " SELECT CAST(isolate_id AS VARCHAR) AS file, observation_id, drug, result, CAST(floor(mic * 1000) AS BIGINT) AS mic, NULL AS reason FROM labs WHERE isolate_id % 9 <> 2 UNION ALL SELECT CAST(isolate_id AS VARCHAR), NULL, NULL, NULL, NULL, 'no JSON rows' FROM labs WHERE isolate_id % 9 = 2 GROUP BY isolate_id"),
    "stored_results": with_bindings("results", " SELECT *, 'c1' AS cohort, CAST((SELECT COUNT(*) FROM results) AS VARCHAR) AS n_calls FROM results"),
    "promotion_gates": with_bindings("observations", _PROMOTED + " SELECT variant, drug, n, n_r, n_s, n_sites, n_lineages, cohort_s, round(f, 6) + 0.0 AS r_fraction, failed = '' AS eligible, failed FROM pm"),
    "provisional_entries": with_bindings("observations", _PROMOTED + " SELECT variant, drug, 'resistant' AS call, round(round(f, 3), 6) + 0.0 AS confidence, n, n_sites FROM pm WHERE failed = '' AND variant % 2 = 0"),
}
