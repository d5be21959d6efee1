"""A corpus pipeline: quality rules, line dedup, near duplicates, mixing, packing.  Each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridair.llm import budget_tree, divergence, line_chunks, packing, simhash_rings
from gridair.llm.common import written
from gridair.llm.queries import DOMAIN, LEVELS, WEIGHTS
from gridair.llm.tokens import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of the tokens of all documents that the mix keeps, as a fraction.
MIX_SHARE = (9, 10)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and both distances pass.  A null text goes."""
    judged = divergence.judge(docs, carry=("text", "lang", "source", "n_chars"))
    return judged.where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that still have text, without repeated chunks; n_chars follows the text."""
    cut = line_chunks.dedup(docs)
    return cut.where(F.length("text") > 0).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id (of rows with the same id the first by text).  Rows without an id stay."""
    found = simhash_rings.near_duplicates(docs).where("doc_id is not null")
    kept = found.groupBy("doc_id").agg(F.min("component_id").alias("c")).where("doc_id = c").select("doc_id")
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source"))
    return named.withColumn("_n", first).where("_n = 1").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix (one epoch), the last of each leaf cut to the tokens taken.  Rows without an id go."""
    rows = docs.withColumn("tokens", budget_tree.n_words("text")).withColumn("domain", F.expr(DOMAIN))
    taken = written(budget_tree.mix(rows, LEVELS, WEIGHTS, MIX_SHARE, 1, "mix").select("doc_id", "tokens", "taken"), "mixed")
    text = F.when(F.col("taken") < F.col("tokens"), budget_tree.first_words("text", "taken")).otherwise(F.col("text"))
    cut = docs.join(taken, "doc_id").withColumn("text", text)
    return cut.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each packed piece."""
    return packing.digest(packing.pack(packing.pieces(docs, vocabulary_path("word_bpe_49k.json"))))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("mixing", mixing), ("packing", pack)]
#: The last stage needs a tokenizer, which SQL has not.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
