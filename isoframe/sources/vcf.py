"""Bulk scan of single-sample variant text and its match with a coordinate catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.functions.alleles import trimmed

#: Fixed: FILTER values that count as a call, and ALT texts that carry no allele.
ACCEPTED = ("PASS", ".", "")
NO_ALLELE = ("", ".", "*")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines of (compressed) files with the file they come from."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), "value")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read instead of computing it again (a one-row explode keeps them apart)."""
    return df.withColumn(name, F.explode(F.array(value)))


def sites(text: DataFrame) -> DataFrame:
    """Records with a position: file, value, contig, pos, ref; only the first fields are split."""
    head = _once(text.where("NOT startswith(value, '#')"), "_h", F.split("value", "\t", 6))
    out = head.select("file", "value", F.get("_h", F.lit(0)).alias("contig"), F.get("_h", F.lit(1)).try_cast("long").alias("pos"), F.get("_h", F.lit(3)).alias("ref"))
    return out.where("pos IS NOT NULL AND ref IS NOT NULL")


def candidates(text: DataFrame, positions: DataFrame, longest: int = 16, broadcast_rows: int = 5_000_000) -> DataFrame:
    """Records that can match a catalogued position, before most of the line is split.

    ``positions`` has pos. A single-base REF cannot move, so its own position decides; a
    longer one can reach the positions it spans. Each start before a position is listed
    once with the length that reaches the nearest position, so one join decides both
    cases; a REF of more than ``longest`` bases is kept unseen. The list is broadcast
    while it is short enough (counted), else joined by shuffle.
    """
    starts = positions.select("pos").distinct().withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(longest - 1))))
    starts = starts.groupBy((F.col("pos") - F.col("_k")).alias("_start")).agg(F.min("_k").alias("_reach"))
    hint = "broadcast" if positions.count() * longest <= broadcast_rows else "merge"
    found = sites(text)
    joined = found.join(starts.hint(hint), F.col("pos") == F.col("_start"), "left")
    return joined.where((F.length("ref") > F.coalesce("_reach", F.lit(longest)))).drop("_start", "_reach")


def alleles(records: DataFrame) -> DataFrame:
    """One row per ALT allele: file, pos, ref, alt, allele_index, carried, and status.

    status is ok, filtered (FILTER or a genotype that is not called) or error (more than
    one sample, or a genotype beyond the ALT count). Symbolic ALTs have no row.
    """
    fields = _once(records, "_f", F.split("value", "\t"))
    field = lambda k: F.get("_f", F.lit(k))
    filters = F.filter(F.split(F.coalesce(field(6), F.lit("")), ";"), lambda x: ~x.isin(*ACCEPTED))
    place = F.array_position(F.split(F.coalesce(field(8), F.lit("")), ":"), "GT")
    genotype = F.when((F.size("_f") == 10) & (place > 0), F.coalesce(F.try_element_at(F.split(field(9), ":"), place.cast("int")), F.lit(".")))
    parts = F.struct(F.split(field(4), ",").alias("alts"), F.size("_f").alias("n"), F.size(filters).alias("bad"), F.split(genotype, "[/|]").alias("gt"))
    df = _once(fields, "_p", parts).select("file", "contig", "pos", "ref", F.col("_p.alts").alias("_alts"), F.size("_p.alts").alias("_count"), F.col("_p.n").alias("_n"), F.col("_p.bad").alias("_bad"), F.col("_p.gt").alias("_gt"))
    uncalled = F.exists("_gt", lambda a: ~a.rlike("^[0-9]+$"))
    beyond = F.array_max(F.transform("_gt", lambda a: a.try_cast("int"))) > F.col("_count")
    status = F.when(F.col("_bad") > 0, "filtered").when(F.col("_n") > 10, "error").when(F.coalesce(uncalled, F.lit(False)), "filtered").when(F.coalesce(beyond, F.lit(False)), "error").otherwise("ok")
    out = df.withColumn("status", status).select("file", "contig", "pos", "ref", "status", "_gt", F.posexplode("_alts").alias("_k", "alt"))
    out = out.withColumn("alt", F.trim("alt")).where(~F.col("alt").isin(*NO_ALLELE) & ~F.col("alt").startswith("<"))
    index = F.col("_k") + 1
    carried = F.col("_gt").isNull() | F.array_contains(F.col("_gt"), index.cast("string"))
    return out.select("file", "contig", "pos", "ref", "alt", index.alias("allele_index"), carried.alias("carried"), "status")


def matched(rows: DataFrame, catalogue: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Labels per file: carried in any allele, or only assessed (a record examined it).

    ``catalogue`` has pos, ref, alt, label. A record matches by its own spelling or by
    the trimmed one; one allele may hit several labels.
    """
    hint = "broadcast" if catalogue.count() <= broadcast_rows else "merge"
    keys = catalogue.select(F.col("pos").alias("_p"), F.upper("ref").alias("_r"), F.upper("alt").alias("_a"), "label").distinct().hint(hint)
    ok = rows.where("status = 'ok'").withColumn("_raw", F.struct(F.col("pos").cast("long").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt")))
    several = (F.length("ref") > 1) & (F.length("alt") > 1)
    spellings = F.when(several, F.array("_raw", trimmed(F.col("pos"), F.col("ref"), F.col("alt")))).otherwise(F.array("_raw"))
    spelled = ok.select("file", "carried", F.explode(spellings).alias("_key"))
    joined = spelled.join(keys, (F.col("_key.pos") == F.col("_p")) & (F.col("_key.ref") == F.col("_r")) & (F.col("_key.alt") == F.col("_a")))
    return joined.groupBy("file", "label").agg(F.max("carried").alias("carried"))


def several_samples(text: DataFrame) -> DataFrame:
    """Files whose header names more than one sample; they are refused as a whole."""
    return text.where("startswith(value, '#CHROM')").where(F.size(F.split("value", "\t")) > 10).select("file").distinct()


def single_sample(text: DataFrame) -> DataFrame:
    """Lines of the files that are not refused."""
    return text.join(several_samples(text).hint("merge"), "file", "left_anti")


def load_summary(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Per file: alleles by status, contigs, labels assessed and carried, and the share of usable alleles that are filtered or in error.

    ``rows`` are alleles, ``found`` their matches (see ``matched``).
    """
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    counts = rows.groupBy("file").agg(
        F.count("*").alias("n_alleles"), n("ok").alias("n_ok"), n("filtered").alias("n_filtered"), n("error").alias("n_error"), F.array_join(F.array_sort(F.collect_set("contig")), ",").alias("contigs")
    )
    labels = found.groupBy("file").agg(F.count("*").alias("n_assessed"), F.count(F.when(F.col("carried"), 1)).alias("n_carried"))
    out = counts.join(labels.hint("merge"), "file", "left").na.fill(0, ["n_assessed", "n_carried"])
    return out.withColumn("lost_fraction", 1 - F.col("n_ok") / F.col("n_alleles"))
