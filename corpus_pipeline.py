"""A training corpus from documents: good, distinct, without repeats and benchmark text, packed.

Every stage takes (spark, docs, sf_dir); its table is written as Parquet and read again
as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.llm import decontam, ngram_join, packing, quality_model, suffix_dedup
from isoframe.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more.

    Null, empty and very long texts are scored like others; null ids and repeated rows are
    judged row by row, an empty table stays empty, further columns are carried along.
    """
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.scored_rows(docs, model).where("score >= 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest id, and of its rows that of the smallest text hash.

    Rows with equal id and text are one document. Rows without words are no copies of
    anything and all stay; a null id comes after the others.
    """
    found = written(ngram_join.components(docs), "components")
    best = found.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    kept = best.select("best.doc_id", "best.text_key", F.lit(True).alias("one"))
    alone = found.where("n_shingles = 0").select("doc_id", "text_key", F.lit(False).alias("one")).distinct()
    kept = written(kept.unionByName(alone), "kept")

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    same = keyed["id"].eqNullSafe(kept["doc_id"]) & (keyed["key"] == kept["text_key"])
    rows = keyed.join(kept.hint("merge"), same).select("row", "id", "key", "one")
    first = rows.where("one").groupBy("id", "key").agg(F.first("row").alias("row")).select("row.*")
    return first.unionByName(rows.where("NOT one").select("row.*"))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that occur more than once in the corpus.

    Every row stays, with what is left of its text (null becomes empty) and its length in
    n_chars; null ids, repeated rows and further columns are kept, an empty table stays empty.
    """
    cut = suffix_dedup.remove_repeats(docs, as_text=True).select("row.*", F.col("kept").alias("text"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items.

    Texts without words, null ones too, are kept; null ids and repeated rows are judged row
    by row, further columns are carried along, an empty table or benchmark removes nothing.
    """
    hits = decontam.window_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.contamination(hits).where("NOT contaminated").select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of 1024, with their ids.

    Null and empty texts are one piece, the end id; null ids and repeated rows are packed as
    they are, an empty table gives no piece, further columns are not read.
    """
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("benchmark_text", benchmark_text),
    ("sequences", sequences),
]

#: Classifier, similarity classes and tokenizer cannot be stated in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
