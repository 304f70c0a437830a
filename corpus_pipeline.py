"""From raw documents to packed training sequences; each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontam, line_dedup, packing, quality
from tabulon.llm.encode import tokenizer_path
from tabulon.llm.jaccard_join import jaccard_components
from tabulon.llm.store import Scratch


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores at least 0.5, each by its own text: null and repeated doc_ids and repeated rows too. An empty table stays empty; other columns pass through."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs, labels).where("quality_score >= 0.5").select(*docs.columns)


def without_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines are cut; documents of which nothing is left go. n_chars counts the new text.

    A null text stays as it is; a null doc_id orders first and a null source counts as one site. Other columns pass through.
    """
    cut = line_dedup.drop_site_lines(docs).where("trim(text) <> '' or n_removed = 0")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near rows, the one with the smallest doc_id.

    Each row counts by itself under a key of its own, whether its doc_id is null or repeats. A null doc_id comes after all others, and
    rows of one doc_id by the hash of the text. Rows without words all stay.
    """
    rows, key = Scratch(spark, "groups").keyed(docs)
    place = rows.select(F.col(key).alias("k"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.col(key).alias("k")).alias("place"))
    groups = jaccard_components(rows, id_col=key).select(F.col("doc_id").alias("k"), "component_id")
    first = groups.join(place, "k").groupBy("component_id").agg(F.min("place").alias("m")).select(F.col("m.k").alias(key))
    return rows.join(first, key, "left_semi").select(*docs.columns)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat no benchmark item; each is judged by its own text, whether its doc_id is null or repeats."""
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in their sequences; a null or empty text is the end id alone, and null or repeated doc_ids are packed each."""
    return packing.pack_documents(docs, tokenizer=tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", without_site_lines),
    ("n-gram jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_documents),
    ("packing", packed),
]

#: A trained model and a curve order have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and reread as the next one's docs."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
