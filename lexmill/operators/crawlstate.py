"""Crawl bookkeeping: hashes, change detection, upserts, recrawl, checkpoints.

``articles`` have unique urls; ``article_hashes`` may repeat a url, and its
latest check counts (null checks first, ties by larger hash).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ARTICLES = "id BIGINT, url STRING, html_content STRING, source_name STRING, crawl_timestamp BIGINT, crawl_date STRING, filename STRING, article_number INT"
HASHES = "url STRING, content_hash STRING, last_checked BIGINT"
STATE = "source_name STRING, position STRING, articles_count INT, last_update BIGINT"


def content_hash(html: Column) -> Column:
    """md5, lower-case hex of the UTF-8 bytes; null for null."""
    return F.md5(html)


def latest_hashes(hashes: DataFrame) -> DataFrame:
    """One row per url; partial maxima are taken before the shuffle."""
    top = F.max(F.struct(F.coalesce("last_checked", F.lit(-(1 << 62))).alias("o"), F.coalesce("content_hash", F.lit("")).alias("h"), "content_hash", "last_checked")).alias("m")
    return hashes.groupBy("url").agg(top).select("url", "m.content_hash", "m.last_checked")


def change_status(pages: DataFrame, known: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(url, status)``: new, changed or unchanged; no stored hash means unchanged.

    ``pages(url, html_content)`` is the batch, ``known(url)`` the stored articles.
    """
    old = known.select("url").distinct().withColumn("_known", F.lit(True))
    new = pages.select("url", content_hash(F.col("html_content")).alias("_new"))
    status = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("content_hash").isNotNull() & (F.lower("content_hash") != F.col("_new")), "changed")
        .otherwise("unchanged")
    )
    return new.join(old, "url", "left").join(latest_hashes(hashes), "url", "left").select("url", status.alias("status"))


def existing(pages: DataFrame, known: DataFrame) -> DataFrame:
    return pages.join(known.select("url"), "url", "left_semi")


def missing(pages: DataFrame, known: DataFrame) -> DataFrame:
    return pages.join(known.select("url"), "url", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, update: list[str]) -> DataFrame:
    """Rows of both; for keys in both, ``update`` columns come from ``new``.

    Columns are those of ``old``; ``new`` must hold them and have unique keys.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    pick = lambda c: F.when(F.col(f"o.{key}").isNull(), F.col(f"n.{c}")).when(F.lit(c in update) & F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*(pick(c).alias(c) for c in old.columns))


def upsert_articles(old: DataFrame, new: DataFrame, with_date: bool = False) -> DataFrame:
    return upsert(old, new, "url", ["html_content", "crawl_timestamp", *(["crawl_date"] if with_date else [])])


def upsert_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(latest_hashes(old), new, "url", ["content_hash", "last_checked"])


def upsert_state(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, "source_name", ["position", "articles_count", "last_update"])


def recrawl_due(articles: DataFrame, hashes: DataFrame, source: str, now: int, interval: int, limit: int) -> DataFrame:
    """Never checked or stale urls of a source, first ``limit`` by url; none if interval <= 0."""
    if interval <= 0:
        return articles.select("url").where(F.lit(False))
    own = articles.where(F.col("source_name") == source).select("url")
    due = own.join(latest_hashes(hashes), "url", "left").where(F.col("last_checked").isNull() | (F.col("last_checked") < now - interval))
    return due.select("url").orderBy("url").limit(limit)


def recrawl_points(pages: DataFrame, processed: str, every: int = 50, at_start: bool = False) -> DataFrame:
    """Rows of a crawl after which old pages are checked again: each ``every``-th one processed, with ``at_start`` the 0th too."""
    n = F.col(processed)
    return pages.where((F.pmod(n, F.lit(every)) == 0) & (F.lit(at_start) | (n > 0)))


def crawl_summary(pages: DataFrame, known: DataFrame) -> DataFrame:
    """``(processed, saved, skipped, success_pct)`` of a batch of landed pages.

    Saved are pages with content whose address was not ``known``; known ones are
    skipped, and what remains has failed.
    """
    old = known.select("url").distinct().withColumn("_known", F.lit(True))
    n, ok = F.count(F.lit(1)), F.col("_known").isNull() & (F.coalesce("html_content", F.lit("")) != "")
    saved, skipped = F.count(F.when(ok, 1)), F.count("_known")
    pct = F.when(n > 0, F.round(saved * 100.0 / n, 6)).alias("success_pct")
    return pages.select("url", "html_content").join(old, "url", "left").agg(n.alias("processed"), saved.alias("saved"), skipped.alias("skipped"), pct)


def stored_count(articles: DataFrame, source: str) -> DataFrame:
    return articles.where(F.col("source_name") == source).agg(F.count(F.lit(1)).alias("n"))


def days_until(counts: DataFrame, max_empty: int, target: int | None = None) -> DataFrame:
    """Days, newest first, that a crawl visits: up to ``max_empty`` empty ones in a row or ``target`` pages.

    ``counts(day, n)`` has every day of the calendar once, so it is small.
    """
    order = W.orderBy(F.desc("day"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = counts.withColumn("_k", F.row_number().over(order)).withColumn("_full", F.when(F.col("n") > 0, F.col("_k")))
    rows = rows.withColumn("_last", F.coalesce(F.max("_full").over(before), F.lit(0))).withColumn("_run", F.col("_k") - 1 - F.col("_last"))
    rows = rows.withColumn("_worst", F.coalesce(F.max("_run").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))).withColumn("_sum", F.coalesce(F.sum("n").over(before), F.lit(0)))
    open_ = F.col("_worst") < max_empty
    return rows.where(open_ if target is None else open_ & (F.col("_sum") < target)).select("day", "n")


def resume_after(links: DataFrame, position: str | None, order: str = "pos") -> DataFrame:
    """Links after the last completed one; all where it is unknown or not listed."""
    if position is None:
        return links
    at = links.where(F.col("url") == position).agg(F.max(order).alias("_at"))
    return links.crossJoin(F.broadcast(at)).where(F.col("_at").isNull() | (F.col(order) > F.col("_at"))).drop("_at")


def resume_days(spark, position: str | None, stop: str) -> DataFrame:
    """Days from the stored ``yyyy/MM/dd`` position down to ``stop``, newest first."""
    start = F.coalesce(F.try_to_date(F.lit(position), "yyyy/MM/dd"), F.to_date(F.lit(stop), "yyyy/MM/dd"))
    last = F.to_date(F.lit(stop), "yyyy/MM/dd")
    days = F.when(start >= last, F.sequence(start, last, F.expr("interval -1 day"))).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(days).alias("day"))
