"""Inverted and forward index as DataFrames.

The primary form is ``(term, doc_id)`` rows; arrays are made only for export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.lexical import INDEX_SUFFIXES, kept_tokens, stem

INDEX_VERSION = 1


def stems(df: DataFrame, id_col: str, text_col: str, mode: str = "index", suffixes=INDEX_SUFFIXES, position: bool = False) -> DataFrame:
    """``(doc_id, [pos,] term)``, one row per kept occurrence."""
    t = kept_tokens(df, id_col, text_col, mode, position)
    return t.select(F.col(id_col).alias("doc_id"), *(["pos"] if position else []), stem(F.col("token"), suffixes).alias("term"))


def postings(occurrences: DataFrame) -> DataFrame:
    """Distinct ``(term, doc_id)``; the map side removes repeats before the shuffle."""
    return occurrences.select("term", "doc_id").distinct()


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def posting_lists(post: DataFrame) -> DataFrame:
    """``(term, df, postings)`` with ascending ids (export form)."""
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list("doc_id")).alias("postings"))


def posting_segments(post: DataFrame, span: int = 1 << 20) -> DataFrame:
    """Posting lists cut at every ``span`` ids, so that no list outgrows a task."""
    return post.groupBy("term", F.floor(F.col("doc_id") / span).alias("segment")).agg(
        F.count(F.lit(1)).alias("df"), F.sort_array(F.collect_list("doc_id")).alias("postings")
    )


def forward_index(occurrences: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents with at least one kept token: ``docs`` columns and term_count."""
    counts = occurrences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("term_count"))
    return docs.join(counts, "doc_id")


def index_stats(occurrences: DataFrame) -> DataFrame:
    """Documents, terms, occurrences and mean term bytes, from two-level aggregation."""
    per_doc = occurrences.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("b"))
    docs = per_doc.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.round(F.sum("b") / F.sum("n"), 6).alias("mean_bytes"))
    terms = occurrences.select("term").distinct().agg(F.count(F.lit(1)).alias("terms"))
    return docs.crossJoin(terms).select("docs", "terms", "occurrences", "mean_bytes")


def save(post: DataFrame, forward: DataFrame, path: str) -> None:
    """Postings range-partitioned and sorted by term (min/max pruning), and documents."""
    post.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    forward.write.mode("overwrite").parquet(f"{path}/docs")
    post.sparkSession.createDataFrame([("lexmill-index", INDEX_VERSION)], "magic string, version int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(postings, docs)``; raises ValueError on another format or version."""
    meta = spark.read.schema("magic string, version int").json(f"{path}/meta").first()
    if meta is None or meta["magic"] != "lexmill-index" or meta["version"] != INDEX_VERSION:
        raise ValueError(f"not a version {INDEX_VERSION} index: {path}")
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs")
