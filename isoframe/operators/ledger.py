"""Hash-chained ledgers: building, verifying and replaying."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoframe.operators.running import first_of_group, scan_states

#: Fixed: what the first entry of a chain points to.
GENESIS = "0" * 64


def _body(seq: Column, payload: Column, before: Column) -> Column:
    """The hash of an entry. A missing payload has no part of its own, so it is not an empty one."""
    return F.sha2(F.concat_ws("|", seq.cast("string"), payload, before), 256)


def append_entries(rows: DataFrame, chain: str, order: str, payload: str) -> DataFrame:
    """Ledger entries (chain, seq, payload, prev_hash, entry_hash) of each chain's rows in order, from seq 0.

    Every hash needs the one before, so a chain is worked through in one task; that task
    holds its last hash and a batch of rows, however long the chain is. Rows of equal order
    are taken in order of payload.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seq, before = None, 0, GENESIS
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh, last = first_of_group(batch, [chain], last)
            numbers, prev, own = [], [], []
            for new, text in zip(fresh.tolist(), batch.column("_payload").to_pylist(), strict=True):
                if new:
                    seq, before = 0, GENESIS
                numbers.append(seq)
                prev.append(before)
                before = hashlib.sha256("|".join(x for x in (str(seq), text, before) if x is not None).encode()).hexdigest()
                own.append(before)
                seq += 1
            yield pa.RecordBatch.from_arrays([batch.column(chain), pa.array(numbers, pa.int64()), batch.column("_payload"), pa.array(prev), pa.array(own)], [chain, "seq", "payload", "prev_hash", "entry_hash"])

    listed = rows.select(chain, F.col(order).alias("_order"), F.col(payload).cast("string").alias("_payload")).repartition(chain).sortWithinPartitions(chain, "_order", "_payload")
    return listed.drop("_order").mapInArrow(link, f"`{chain}` {rows.schema[chain].dataType.simpleString()}, seq long, payload string, prev_hash string, entry_hash string")


def verify(entries: DataFrame, chain: list[str] | None = None, genesis: str = GENESIS) -> DataFrame:
    """Entries that break their chain, with the first reason that applies.

    ``entries`` has seq, payload, prev_hash and entry_hash; seq counts from 0 within each
    chain, and a seq that occurs twice is a break. The neighbours of an entry are looked
    up by seq, so a chain of any length is checked without sorting it in one task.
    """
    keys = chain or []
    places = entries.groupBy(*keys, "seq").agg(F.count("*").alias("_times"), F.max("entry_hash").alias("_hash"))
    before = places.select(*keys, (F.col("seq") + 1).alias("seq"), F.col("_hash").alias("_before"))
    joined = entries.join(places.select(*keys, "seq", "_times").hint("merge"), [*keys, "seq"]).join(before.hint("merge"), [*keys, "seq"], "left")
    expected = _body(F.col("seq"), F.col("payload"), F.coalesce("prev_hash", F.lit("")))
    reason = (
        F.when(F.col("_times") > 1, "repeated").when((F.col("seq") > 0) & F.col("_before").isNull(), "gap")
        .when(~F.col("prev_hash").eqNullSafe(F.coalesce("_before", F.lit(genesis))), "broken link").when(~F.col("entry_hash").eqNullSafe(expected), "altered entry")
    )
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select(*keys, "seq", "reason")


def replay(events: DataFrame, allowed: dict[str, list[str]], key: str, order: str, action: str, required: tuple[str, ...] = (), start: str = "start", ranges: int = 64) -> DataFrame:
    """Events of each key in order, the state before each, and whether it was allowed.

    A refused event (not among those that may follow the state, or with a blank in the
    ``required`` columns, such as reviewer or rationale) leaves the state as it was. Events
    of equal order are taken in order of action, unfilled ones first. Every event is a
    function on the few states; functions are composed in parallel, so the events of one
    key are shared out over tasks (see ``running.scan_states``).
    """
    filled = F.lit(True)
    for c in required:
        filled = filled & (F.coalesce(F.trim(c), F.lit("")) != "")
    names = sorted({start, *allowed, *(a for after in allowed.values() for a in after)})
    place = {name: k for k, name in enumerate(names)}
    table = np.tile(np.arange(len(names)), (len(names) + 1, 1))  # the last row: refused whatever the state
    for state, after in allowed.items():
        for a in after:
            table[place[a], place[state]] = place[a]
    told = F.create_map(*[F.lit(x) for p in place.items() for x in p])
    code = F.when(filled, F.coalesce(F.try_element_at(told, F.col(action)), F.lit(len(names)))).otherwise(len(names))
    rows = events.select(key, F.col(order).cast("long").alias(order), F.col(action).alias(action), filled.alias("_filled"), code.cast("int").alias("code"))
    moved = scan_states(rows, key, [order, action, "_filled"], table, place[start], ranges=ranges)
    previous = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("before") + 1)
    fits = F.col("_filled") & F.coalesce(F.array_contains(F.try_element_at(F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.lit(a) for a in x]).cast("array<string>") for p in allowed.items() for x in p]), previous), F.col(action)), F.lit(False))
    return moved.select(key, order, action, previous.alias("previous"), fits.alias("allowed"))


def states(replayed: DataFrame, key: str, order: str, action: str) -> DataFrame:
    """The state of each key after its last allowed event, and how many events were refused."""
    return replayed.groupBy(key).agg(F.max_by(action, F.when(F.col("allowed"), F.col(order))).alias("state"), F.count(F.when(~F.col("allowed"), 1)).alias("n_refused"))
