from pyspark.sql import functions as F

from lexmill.operators import crawlstate as C
from lexmill.streaming import landing


def test_status(spark):
    pages = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", None), (None, "x")], "url STRING, html_content STRING")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "url STRING")
    hashes = spark.createDataFrame([("a", "9DD4E461268C8034F5C8564E155C67A6", 5), ("a", "old", 1), ("b", "other", 1), ("b", "o", None)], C.HASHES)
    got = {r.url: r.status for r in C.change_status(pages, known, hashes).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "new", None: "new"}


def test_upsert_keeps_what_is_not_updated(spark):
    old = spark.createDataFrame([(1, "a", "x", "s", 1, "d", "f", 1)], C.ARTICLES)
    new = spark.createDataFrame([(9, "a", "y", "t", 2, "e", "g", 2), (2, "b", "z", "t", 3, None, None, None)], C.ARTICLES)
    got = {r.url: tuple(r) for r in C.upsert_articles(old, new).collect()}
    assert got["a"] == (1, "a", "y", "s", 2, "d", "f", 1) and got["b"] == (2, "b", "z", "t", 3, None, None, None)
    assert C.upsert_articles(old, old.where(F.lit(False))).count() == 1
    assert C.upsert_articles(old.where(F.lit(False)), new).count() == 2


def test_recrawl(spark):
    a = spark.createDataFrame([(u, "s") for u in "abc"] + [("d", "t")], "url STRING, source_name STRING")
    h = spark.createDataFrame([("a", "x", 100), ("b", "x", 10)], C.HASHES)
    due = lambda i, n: [r.url for r in C.recrawl_due(a, h, "s", 110, i, n).collect()]
    assert due(50, 9) == ["b", "c"] and due(50, 1) == ["b"] and due(0, 9) == []


def test_resume(spark):
    links = spark.createDataFrame([(u, i) for i, u in enumerate("abcd")], "url STRING, pos BIGINT")
    after = lambda p: sorted(r.url for r in C.resume_after(links, p).collect())
    assert after("b") == ["c", "d"] and after(None) == list("abcd") and after("zz") == list("abcd")
    days = [str(r.day) for r in C.resume_days(spark, "2025/01/03", "2025/01/01").collect()]
    assert days == ["2025-01-03", "2025-01-02", "2025-01-01"]


def test_state_and_streaming(spark, tmp_path):
    row = lambda u, h, t: (1, u, h, "s", t, "d", "f", 1)
    spark.createDataFrame([row("a", "x", 100), row("a", "x", 200), row("a", "y", 300)], C.ARTICLES).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    q = landing.start(landing.fresh(landing.landed(spark, str(tmp_path / "in"))), lambda df, _: seen.extend((r.url, r.html_content) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted(seen) == [("a", "x"), ("a", "y")]
