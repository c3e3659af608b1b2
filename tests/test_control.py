"""Crawl control, progress, reports and the interactive shell."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexmill import shell, store
from lexmill.operators import crawlstate as C
from lexmill.operators import index
from lexmill.sources import writers
from lexmill.streaming import landing


def days(spark, counts):
    first = datetime.date(2025, 12, 22)
    return spark.createDataFrame([(first - datetime.timedelta(k), n) for k, n in enumerate(counts)], "day DATE, n BIGINT")


def test_days_until(spark):
    visited = lambda counts, *a: [r.n for r in C.days_until(days(spark, counts), *a).orderBy(F.desc("day")).collect()]
    assert visited([1, 0, 0, 2, 0, 0, 0, 5], 3) == [1, 0, 0, 2, 0, 0, 0]
    assert visited([0, 0, 1], 2) == [0, 0]
    assert visited([3, 4, 5], 9, 7) == [3, 4]
    assert visited([], 3) == []


def test_recrawl_points(spark):
    rows = spark.range(0, 151).select(F.col("id").cast("int").alias("n"))
    assert [r.n for r in C.recrawl_points(rows, "n").orderBy("n").collect()] == [50, 100, 150]
    assert [r.n for r in C.recrawl_points(rows, "n", 100, at_start=True).orderBy("n").collect()] == [0, 100]


def test_crawl_summary(spark):
    pages = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", ""), ("d", None)], "url STRING, html_content STRING")
    known = spark.createDataFrame([("b",), ("b",)], "url STRING")
    assert tuple(C.crawl_summary(pages, known).first()) == (4, 1, 1, 25.0)
    assert tuple(C.crawl_summary(pages.where("false"), known).first()) == (0, 0, 0, None)


def test_progress_line():
    assert landing.progress_line(50, 200, 3600) == "50 of 200 pages (25.0 %), 50 an hour, 3.0 hours left"
    assert landing.progress_line(0, 0, 0) == "0 of 0 pages (- %), 0 an hour, - hours left"


def test_a_running_stream_is_watched_and_stopped_between_batches(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x", "s", 1, "d", "f", 1)], C.ARTICLES).write.parquet(str(tmp_path / "in"))
    said, seen = [], []
    watch = landing.Progress(4, said.append)
    spark.streams.addListener(watch)
    try:
        q = landing.start(landing.landed(spark, str(tmp_path / "in")), lambda df, _: seen.append(df.count()), str(tmp_path / "ck"), interval=0.2)
        q.processAllAvailable()
        landing.stop_after_batch(q)
        assert not q.isActive and sum(seen) == 1
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(watch)
    assert not said or said[0].startswith("1 of 4 pages (25.0 %)")


def test_shell(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"red car {'blue' if i % 2 else 'green'}", f"u{i}") for i in range(120)], "doc_id BIGINT, text STRING, url STRING")
    stems = index.stems(docs, "doc_id", "text")
    index.save(index.postings(stems), index.forward_index(stems, docs.select("doc_id", "url")), str(tmp_path / "i"))
    said = []
    shell.run(*index.load(spark, str(tmp_path / "i")), ["blue && car\r\n", "\n", "nothing\n", "exit\n", "red\n"], said.append)
    assert said[0] == "1. [1] u1" and said[49] == "50. [99] u99" and said[50] == "... 10 more" and said[51].endswith(" ms")
    assert said[52] == "no documents" and len(said) == 54


def test_report(spark):
    said = []
    writers.report(spark.createDataFrame([("a", 1)], "source STRING, n INT"), "Corpus", said.append)
    assert said == ["Corpus", "source: a, n: 1"]


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        def getConf(self):
            return self

    class Session:
        conf = sparkContext = Conf()

    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        store.folder(Session)
    Session.conf["spark.checkpoint.dir"] = "hdfs:///shared"
    assert store.folder(Session) == "hdfs:///shared"
