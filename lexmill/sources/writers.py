"""Writers: partitioned pages, metadata CSV, article XML, vocabulary, tokens, search results."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.htmltext import char_count, word_count
from lexmill.operators.crawlstate import ARTICLES, HASHES, STATE


def pages_parquet(pages: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """Append pages partitioned by source; file names already ``known`` are skipped."""
    if known is not None:
        pages = pages.join(known.select("filename"), "filename", "left_anti")
    pages.write.mode("append").partitionBy("source_name").parquet(path)


# Tables of the store and their columns are in ``crawlstate``.
def create_tables(spark, database: str = "default") -> None:
    """The three tables of the crawl's store, where they do not exist."""
    for name, schema in (("articles", ARTICLES), ("article_hashes", HASHES), ("parser_state", STATE)):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")


def metadata_csv(meta: DataFrame, path: str) -> None:
    meta.write.mode("append").option("header", True).option("escape", '"').csv(path)


def xml_rows(clean: DataFrame) -> DataFrame:
    """``clean(doc_id, text, url, source)`` in the nested shape of the XML file."""
    cdata = F.concat(F.lit("<![CDATA[\n"), F.col("text"), F.lit("\n]]>"))
    stats = F.struct(char_count(F.col("text")).cast("bigint").alias("character_count"), word_count(F.col("text")).cast("bigint").alias("word_count"))
    return clean.where(F.col("text") != "").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "url", cdata.alias("content"), stats.alias("statistics"))


# Namespace, version and date of the XML file.
XML_ROOT = 'articles xmlns="http://www.example.com/f1news" version="1.0"'
XML_DATE = "2024"


def articles_xml(clean: DataFrame, path: str) -> None:
    """One ``articles`` document per partition file, and one that holds ``meta`` with the number of articles."""
    rows = xml_rows(clean)
    rows.write.mode("overwrite").format("xml").option("rootTag", XML_ROOT).option("rowTag", "article").save(path)
    meta = rows.agg(F.count(F.lit(1)).alias("total_articles"), F.lit(XML_DATE).alias("generated_date"))
    meta.coalesce(1).write.mode("append").format("xml").option("rootTag", XML_ROOT).option("rowTag", "meta").save(path)


def validate_xml(spark, path: str) -> tuple[int, str]:
    """Article count and a 100-character preview of the first article."""
    from lexmill.sources.readers import articles_xml as read

    rows = read(spark, path)
    first = rows.orderBy("doc_id").select(preview(F.col("content")).alias("p")).first()
    return rows.count(), first["p"] if first else ""


def preview(text):
    return F.replace(F.replace(F.substring(text, 1, 100), F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))


def token_list(freq: DataFrame, path: str) -> None:
    freq.orderBy(F.desc("freq"), F.asc("token")).select("token").write.mode("overwrite").text(path)


def token_rows(tokens: DataFrame, path: str) -> None:
    tokens.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def zipf_csv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report(rows: DataFrame, title: str, log=None, most: int = 100) -> None:
    """A small result as lines of a log: its title, then ``column: value`` of each row; ``most`` bounds what is shown."""
    say = log or logging.getLogger("lexmill").info
    say(title)
    for r in rows.limit(most).collect():
        say(", ".join(f"{c}: {v}" for c, v in r.asDict().items()))


def search_report(report: DataFrame, path: str) -> None:
    report.orderBy("query_no").write.mode("overwrite").json(path)
