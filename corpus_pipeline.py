"""A training corpus from `documents` in five stages, each written as Parquet and read again as the next one's input."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import decontamination, language_id, line_dedup, minhash, packing, token_counts
from refrain.llm._shared import done, stored
from refrain.llm.queries import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without a letter, and texts of 30 letters and more that are in none of the learned languages."""
    return language_id.identify(docs, language_id.profiles(docs)).where("not in_none").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of runs of lines; a text all of whose lines were such copies goes. Texts without lines stay."""
    found = line_dedup.dedup_lines(docs).where("n_deleted = 0 or n_deleted < n_lines")
    return _resized(found, docs).select(*docs.columns)


def _resized(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group, that with the smallest doc_id; rows that repeat its doc_id stay with it, as do rows
    without a doc_id, which link with nothing."""
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, docs.doc_id == kept["__id"], "left_semi").unionByName(docs.where("doc_id is null"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item. Null texts, items without text and an empty benchmark hold none."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, cut and batched by their exact numbers of tokens. Null and empty texts have no piece."""
    return packing.pack(token_counts.token_counts(docs), F.col("n_tokens"))


STAGES = [("language_id", language), ("line_dedup", lines), ("near_duplicates", near_copies), ("decontamination", benchmark), ("packing", packed)]

#: Language profiles and minhash components have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. Null texts are rejected by the first."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), name)
        done(last)
    return STAGES[-1][1](spark, docs, sf_dir)
