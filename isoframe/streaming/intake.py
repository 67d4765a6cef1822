"""Submissions, tickets and validations as streams: each keeps its state and says why it refuses."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from isoframe.operators.linked import local_verdicts


def pads(spark: SparkSession, secrets: dict[str, str]) -> DataFrame:
    """(site, inner, outer): the two padded keys of each site, made once from its secret."""
    rows = []
    for site, secret in secrets.items():
        key = secret.encode()
        key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        rows.append((site, bytearray(x ^ 0x36 for x in key), bytearray(x ^ 0x5C for x in key)))
    return spark.createDataFrame(rows, "_site string, _inner binary, _outer binary")


def keyed_hash(body: Column) -> Column:
    """HMAC-SHA-256 of a text with the pads of its row, in hex."""
    inner = F.sha2(F.concat(F.col("_inner"), F.encode(body, "UTF-8")), 256)
    return F.sha2(F.concat(F.col("_outer"), F.unhex(inner)), 256)


def signed(df: DataFrame, secrets: dict[str, str], site: str = "site_id", body: str = "payload", signature: str = "signature", broadcast_sites: int = 100_000) -> DataFrame:
    """Add valid: whether the signature is the keyed hash of the payload by its site's secret; an unknown site, a null payload or signature is not valid.

    The hash is computed by Spark's own functions from pads that are joined by site (broadcast up to ``broadcast_sites`` sites).
    """
    keys = pads(df.sparkSession, secrets).hint("broadcast" if len(secrets) <= broadcast_sites else "merge")
    joined = df.join(keys, F.col(site).cast("string") == F.col("_site"), "left")
    return joined.withColumn("valid", F.coalesce(keyed_hash(F.col(body)) == F.col(signature), F.lit(False))).drop("_site", "_inner", "_outer")


def of_other_site(payload: Column, site: Column) -> Column:
    """Whether an observation in the payload (a JSON list) names another site than the submission, or none."""
    rows = F.from_json(payload, "array<struct<site_id: string>>")
    return F.coalesce(F.exists(rows, lambda r: ~r["site_id"].eqNullSafe(site.cast("string"))), F.lit(False))


def checked(stream: DataFrame, max_age_hours: int = 24, future_hours: int = 1) -> DataFrame:
    """Add reject_reason of each row alone: signature, site, stale or future; ``stream`` has valid, sent and received, and may have mismatch (see ``of_other_site``)."""
    age = F.unix_micros(F.col("received").cast("timestamp")) - F.unix_micros(F.col("sent").cast("timestamp"))
    hour = 3_600_000_000
    mismatch = F.coalesce(F.col("mismatch"), F.lit(False)) if "mismatch" in stream.columns else F.lit(False)
    reason = F.when(~F.coalesce(F.col("valid"), F.lit(False)), "signature").when(mismatch, "site").when(age > max_age_hours * hour, "stale").when(age < -future_hours * hour, "future")
    return stream.withColumn("reject_reason", reason)


def accepted(stream: DataFrame, lateness: str = "24 hours") -> DataFrame:
    """Rows without a reason, the first of each nonce within the watermark; a nonce that comes again is a replay and is dropped."""
    fresh = stream.where("reject_reason IS NULL").withColumn("received", F.col("received").cast("timestamp"))
    return fresh.withWatermark("received", lateness).dropDuplicatesWithinWatermark(["nonce"]) if stream.isStreaming else fresh.dropDuplicates(["nonce"])


class TicketProcessor(StatefulProcessor):
    """The state of a ticket as one typed value, which expires ``ttl_ms`` after it was last set."""

    def __init__(self, allowed: dict[str, list[str]], start: str, ttl_ms: int | None):
        self.allowed, self.start, self.ttl_ms = allowed, start, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string", self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self.state.update((initialState["state"].iloc[0],))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        filled = np.logical_and.reduce([table[c].map(lambda x: isinstance(x, str) and bool(x.strip())).to_numpy(bool) for c in ("reviewer", "rationale")])
        now = self.state.get()[0] if self.state.exists() else self.start
        previous, fits = [], []
        for action, whole in zip(table["action"].tolist(), filled.tolist(), strict=True):
            previous.append(now)
            fits.append(whole and action in self.allowed.get(now, ()))
            now = action if fits[-1] else now
        self.state.update((now,))
        yield pd.DataFrame({"ticket_id": key[0], "event_id": table["event_id"].to_numpy(), "action": table["action"].to_numpy(), "previous": previous, "allowed": fits})

    def close(self) -> None:
        pass


def ticket_states(stream: DataFrame, allowed: dict[str, list[str]], start: str = "new", ttl_hours: float | None = None, initial: DataFrame | None = None) -> DataFrame:
    """Every ticket event with the state before it and whether it is allowed; state is kept per ticket_id.

    ``stream`` has ticket_id, event_id, action, reviewer and rationale. Events of a micro-batch
    are taken in order of event_id; a refused one changes nothing. A ticket begins in
    ``start`` or, in a new stream, in its state in ``initial`` (ticket_id, state). With
    ``ttl_hours`` a ticket without events for so long is forgotten and begins anew (see ``append``). State
    is in the RocksDB store, which this sets for the session, and survives a restart from the checkpoint.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = stream.select(F.col("ticket_id").cast("string").alias("ticket_id"), "event_id", "action", "reviewer", "rationale")
    processor = TicketProcessor(allowed, start, None if ttl_hours is None else int(ttl_hours * 3_600_000))
    begun = None if initial is None else initial.select(F.col("ticket_id").cast("string").alias("ticket_id"), "state").groupBy("ticket_id")
    result = "ticket_id string, event_id long, action string, previous string, allowed boolean"
    return keyed.groupBy("ticket_id").transformWithStateInPandas(processor, result, "append", "None" if ttl_hours is None else "processingTime", begun)


def append(stream: DataFrame, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to a Parquet table, each row once: all there is now, or with ``once`` one batch.

    State that expires asks for batches without end, so such a stream takes ``once``.
    """
    writer = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(once=True) if once else writer.trigger(availableNow=True)).start()


def validation_verdicts(events: DataFrame) -> DataFrame:
    """Current verdicts from a table of events: records (kind record) and retractions (kind retract, with record_index)."""
    records = events.where("kind = 'record'").drop("record_index", "kind")
    return local_verdicts(records, events.where("kind = 'retract'").select("variant", "drug", "record_index"))


def split_late(stream: DataFrame, on_time: str, late: str, checkpoint: str, column: str, lateness_seconds: int) -> StreamingQuery:
    """Write rows to ``on_time`` or, where they are older than the latest seen before by more than the lateness, to ``late``.

    The latest time is that of earlier batches, kept in the tables themselves.
    """

    def route(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kind = f"{column} timestamp, batch long"
        seen = [spark.read.schema(kind).parquet(t).where(F.col("batch") < number).agg(F.max(column).alias("m")) for t in (on_time, late)]
        latest = seen[0].unionByName(seen[1]).agg(F.max("m")).first()[0]
        edge = F.lit(latest).cast("timestamp") - F.make_interval(secs=F.lit(lateness_seconds))
        behind = F.coalesce(F.col(column).cast("timestamp") < edge, F.lit(False))
        batch.where(~behind).write.mode("overwrite").parquet(f"{on_time}/batch={number}")
        batch.where(behind).write.mode("overwrite").parquet(f"{late}/batch={number}")

    spark = stream.sparkSession
    for table in (on_time, late):
        spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{table}/batch=-1")
    return stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
