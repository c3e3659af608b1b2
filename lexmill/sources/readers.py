"""Readers: tables, HTML folders, article XML, token CSV, sitemaps, query batches."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("articles", "article_hashes", "crawl_metadata", "parser_state", "query_batch", "documents", "reading_labels", "mix_targets")
# Columns of the exchanged files.
XML_SCHEMA = "_id BIGINT, _source STRING, url STRING, content STRING, statistics STRUCT<character_count: BIGINT, word_count: BIGINT>"
METADATA_SCHEMA = "id BIGINT, url STRING, filename STRING, date_downloaded STRING, date_published STRING"


@dataclasses.dataclass(frozen=True)
class SiteOptions:
    """Options of one site's crawl."""

    source_name: str
    base_url: str
    encoding: str = "UTF-8"
    delay_seconds: float = 1.0
    target_count: int = 30_000
    recheck_seconds: int = 0


#: Option names of a site's file and the fields that they set.
_OPTIONS = {"source_name": "source_name", "base_url": "base_url", "encoding": "encoding", "delay": "delay_seconds", "target_count": "target_count", "recrawl_interval": "recheck_seconds"}


def site_options(text: str) -> SiteOptions:
    """Options from the text of a site's file: ``key: value`` lines in sections; comments and unknown keys are ignored."""
    kinds = {f.name: type(f.default) if f.default is not dataclasses.MISSING else str for f in dataclasses.fields(SiteOptions)}
    found = {}
    for line in text.splitlines():
        key, _, value = line.partition(":")
        value = value.split(" #")[0].strip().strip("\"'")
        field = _OPTIONS.get(key.strip())
        if field and value:
            found[field] = kinds[field](value)
    return SiteOptions(**found)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def html_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, length)`` of every .html/.htm file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{html,htm}").load(path)
    return files.select("path", "content", "length")


def html_folder_count(spark: SparkSession, path: str) -> int:
    return html_folder(spark, path).select("path").count()


_LABELS = {"windows-1251": "cp1251"}


def decode_bytes(content: Column, encoding: str = "UTF-8") -> Column:
    """Bytes to text; malformed bytes become U+FFFD and null stays null.

    Done in an Arrow-batched UDF: the built-in decoder refuses windows-1251 and
    malformed input unless two legacy session settings are on.
    """
    label = _LABELS.get(encoding.lower(), encoding)

    @F.pandas_udf("string")
    def run(s):
        return s.map(lambda b: bytes(b).decode(label, "replace"), na_action="ignore")

    return run(content)


def declare_utf8(html: Column) -> Column:
    """Rewrite a windows-1251 declaration; add one after the first <head> if none is near the top."""
    out = F.replace(F.replace(html, F.lit("charset=windows-1251"), F.lit("charset=UTF-8")), F.lit("charset=Windows-1251"), F.lit("charset=UTF-8"))
    at = F.instr(out, "<head>")
    added = F.concat(F.substring(out, F.lit(1), at + 5), F.lit('<meta charset="UTF-8">'), F.substring(out, at + 6, F.length(out)))
    lacks = F.instr(F.lower(F.substring(out, 1, 500)), "<meta charset=") == 0
    return F.when(lacks & (at > 0), added).otherwise(out)


def sitemap_urls(lines: DataFrame, col: str = "value") -> DataFrame:
    """``(url)`` from lines that are exactly one <loc> element with an http address; blanks around and inside are trimmed."""
    v = F.trim(F.regexp_replace(col, r"[\r\t]", " "))
    inner = F.trim(F.substring(v, F.lit(6), F.length(v) - 11))
    return lines.where(F.startswith(v, F.lit("<loc>")) & F.endswith(v, F.lit("</loc>"))).select(inner.alias("url")).where(F.startswith("url", F.lit("http")))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    return sitemap_urls(spark.read.text(path))


def articles_xml(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, source, url, content)``; rows without id or content are skipped, CDATA marks dropped."""
    rows = spark.read.format("xml").option("rowTag", "article").schema(XML_SCHEMA).load(path)
    text = F.replace(F.replace("content", F.lit("<![CDATA["), F.lit("")), F.lit("]]>"), F.lit(""))
    return rows.where(F.col("_id").isNotNull() & F.col("content").isNotNull()).select(
        F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.regexp_replace("url", r"[\r\n]", "").alias("url"), F.regexp_replace(text, r"^\s+|\s+$", "").alias("content"), "statistics"
    )


def tokens_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id BIGINT, token STRING").option("header", True).option("escape", '"').csv(path)


def metadata_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA_SCHEMA).option("header", True).option("escape", '"').csv(path)


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a store partitioned by source_name, which stays a string."""
    names = spark.read.parquet(path)
    return names.withColumn("source_name", F.col("source_name").cast("string"))


def last_published(meta: DataFrame) -> DataFrame:
    """date_published of the row with the largest id (ties: later download, then value)."""
    top = F.max(F.struct("id", F.coalesce("date_downloaded", F.lit("")), F.coalesce("date_published", F.lit("")), "date_published"))
    return meta.agg(top.alias("m")).select(F.col("m.date_published").alias("date_published"))


def query_lines(df: DataFrame, col: str = "line") -> list[str]:
    """Typed queries in file order (a person's batch: bounded and small); ``boolq.numbered`` tells which count."""
    return [r[0] or "" for r in df.select(col).collect()]


def nonempty_articles(articles: DataFrame) -> DataFrame:
    """The exporter's scan; callers that need order sort by id."""
    return articles.where(F.col("html_content").isNotNull() & (F.col("html_content") != "")).select("id", "html_content", "url", "source_name")


def jdbc_articles(spark: SparkSession, url: str, properties: dict) -> DataFrame:
    """The same scan pushed down to a relational database."""
    query = "(SELECT id, html_content, url, source_name FROM articles WHERE html_content IS NOT NULL AND html_content <> '') t"
    return spark.read.jdbc(url, query, properties=properties)

