"""Cumulative monitoring over streams: counts per cohort, ingested once, and trends over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from isoframe.operators.accuracy import CALLED, known_lineage, normal_call

COUNTS = "drug string, lineage string, tp long, fp long, tn long, fn long, abstained long, cohort_id string"


def increments(rows: DataFrame) -> DataFrame:
    """Counts per (cohort, drug, lineage) of evaluable rows."""
    c, p = normal_call("predicted"), F.upper(F.trim("phenotype"))
    count = lambda x: F.count(F.when(x, 1))
    return rows.where(p.isin("R", "S")).groupBy("cohort_id", "drug", known_lineage("lineage").alias("lineage")).agg(
        count((c == "resistant") & (p == "R")).alias("tp"), count((c == "resistant") & (p == "S")).alias("fp"),
        count((c == "susceptible") & (p == "S")).alias("tn"), count((c == "susceptible") & (p == "R")).alias("fn"), count(~c.isin(*CALLED)).alias("abstained"),
    )


def ingest(stream: DataFrame, table: str, checkpoint: str, delivery: str) -> StreamingQuery:
    """Append the counts of cohorts that no other delivery has brought to a Parquet table.

    ``delivery`` names what is sent, so a cohort may span any number of micro-batches of
    one delivery, and a cohort sent again changes nothing, whatever rows it has then. A
    batch writes to a folder of its own, so one that runs again after a failure
    overwrites itself.
    """
    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema(f"{COUNTS}, delivery string, batch long").parquet(table).where(F.col("delivery") != delivery).select("cohort_id").distinct()
        increments(batch).join(seen, "cohort_id", "left_anti").write.mode("overwrite").parquet(f"{table}/delivery={delivery}/batch={number}")

    spark = stream.sparkSession
    spark.createDataFrame([], COUNTS).write.mode("append").parquet(f"{table}/delivery=none/batch=-1")
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(table: DataFrame) -> DataFrame:
    """Cumulative counts per (drug, lineage)."""
    return table.groupBy("drug", "lineage").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn", "abstained")])


def trend(events: DataFrame, by: list[str], duration: str = "1 day", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Mean value per key and window of event time; works on a stream or a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", lateness) if events.isStreaming else timed
    windows = F.window("ts", duration, slide) if slide else F.window("ts", duration)
    out = timed.groupBy(windows.alias("_w"), *by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return out.select(*by, F.col("_w.start").alias("start"), "n", "mean")
