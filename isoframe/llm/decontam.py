"""Benchmark windows found in documents by a prefix-filtered join on rare words.

A window is a run of item words. Its words are ordered by how often they occur in the
corpus; a document that holds the window must hold its rarest word, so the prefix of
one word is what is joined. A match fixes where the window would start; it must lie
inside the document (positional and length bounds), and the window is then compared
word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoframe.llm.common import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed: separators of the word contract before A-Z is lower-cased.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are (``lower`` does just that on pure ASCII)."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions and filters read instead of computing it again (a one-row explode keeps them apart)."""
    return df.withColumn(name, F.explode(F.array(value)))


def raw_words(text: Column) -> Column:
    """Words of a text, letter case kept; null and wordless texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), lambda w: w != "")


def _split(text: Column) -> Column:
    """As raw_words, but the first and the last may be empty (cheaper where all are exploded)."""
    return F.split(F.coalesce(text, F.lit("")), _SEPARATORS)


def item_windows(items: DataFrame, width: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (window_id, words, size, items): ``width`` words, or all of a shorter item."""
    words = items.select(F.col(item_col).cast("string").alias("item_id"), F.transform(raw_words(F.col(text_col)), lowered).alias("_w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (width - 1), F.lit(1)))
    return (
        words.where(F.size("_w") > 0)
        .select("item_id", F.explode(F.transform(starts, lambda s: F.slice("_w", s, width))).alias("words"))
        .groupBy("words").agg(F.collect_set("item_id").alias("items"))
        .withColumn("window_id", F.sha2(F.array_join("words", " "), 256))
        .withColumn("size", F.size("words"))
    )


def window_hits(
    docs: DataFrame, items: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row for each document row: doc_id, row (all its columns), n_words, and ``hits``, an array of (start, size, items).

    Every occurrence of every window is in ``hits``; ``start`` counts words from 0. Null
    and wordless texts have 0 words and no hits; items without words have no windows;
    an empty benchmark gives no hits. Repeated rows are judged one by one, rows with a
    null id as well. A text of any length is compared whole; its words are one array. Windows
    of an item without an id hit like others, but name no item. Other columns of either
    table play no part.

    The benchmark's words and windows are broadcast while they have at most
    ``broadcast_rows`` windows (counted first); beyond that they are joined by shuffle,
    where adaptive execution splits frequent words. Candidates are gathered by a hash
    of the text, so copies share theirs, and meet the texts in one shuffle.
    """
    windows = written(item_windows(items, width, item_col, item_text_col), "windows")
    words_of = windows.select("window_id", F.posexplode("words").alias("offset", "word"))
    joined_by = "broadcast" if windows.count() <= broadcast_rows else "merge"

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(F.col(id_col).alias("doc_id"), row, F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_key"))
    spread = keyed.select("_key", F.posexplode(_split(F.col("_text"))).alias("_pos", "_raw"))
    spread = spread.select("_key", "_pos", lowered(F.col("_raw")).alias("word"))

    # Rarity of the benchmark's words over the whole corpus; a word that never occurs rules its window out.
    vocabulary = words_of.select("word").distinct()
    rarity = spread.select("word").join(vocabulary.hint(joined_by), "word", "left_semi").groupBy("word").agg(F.count("*").alias("_df"))
    order = Window.partitionBy("window_id").orderBy(F.coalesce("_df", F.lit(0)), "word", "offset")
    prefix = (
        words_of.join(rarity.hint("shuffle_hash"), "word", "left")
        .withColumn("_rank", F.row_number().over(order))
        .where("_rank = 1 AND _df IS NOT NULL").select("word", "offset", "window_id")
    )
    prefix = written(prefix, "prefix")

    # A text that starts with a separator splits into an empty string and its words: all positions shift alike.
    found = spread.join(prefix.hint(joined_by), "word").select("_key", (F.col("_pos") - F.col("offset")).alias("_at"), "window_id")
    candidates = (
        found.where("_at >= 0").join(windows.hint(joined_by), "window_id")
        .groupBy("_key").agg(F.collect_set(F.struct("_at", "words", "items")).alias("_found"))
    )
    judged = keyed.join(candidates.hint("merge"), "_key", "left")
    judged = once(judged.select("doc_id", "row", "_text", "_found"), "_words", _split(F.col("_text"))).drop("_text")
    blank = F.when(F.get("_words", F.lit(0)) == "", 1).otherwise(0)
    there = F.filter(
        F.coalesce("_found", F.array()),
        lambda c: F.transform(F.slice("_words", c["_at"] + 1, F.size(c["words"])), lowered) == c["words"],
    )
    hits = F.transform(there, lambda c: F.struct((c["_at"] - blank).alias("start"), F.size(c["words"]).alias("size"), c["items"].alias("items")))
    return once(judged, "hits", hits).select("doc_id", "row", F.size(F.filter("_words", lambda w: w != "")).alias("n_words"), "hits")


def contamination(hits: DataFrame, share: int = 20) -> DataFrame:
    """Per document: doc_id, row, n_words, n_hit (words inside any hit), item_ids, and contaminated.

    A document is contaminated if it has a hit word and ``share`` times its hit words
    reach its words.
    """
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1))))
    n_hit = F.when(F.size("hits") > 0, F.size(covered)).otherwise(0).cast("long")
    return once(hits, "n_hit", n_hit).select(
        "doc_id", "row", F.col("n_words").cast("long").alias("n_words"), "n_hit",
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("item_ids"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
