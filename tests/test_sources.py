import datetime

import pytest
from pyspark.sql import functions as F

from lexmill.functions import htmltext as H
from lexmill.functions import urls as U
from lexmill.sources import readers as R
from lexmill.sources import writers as S


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} STRING" for k in values))
    return df.select(col.alias("x")).first().x


@pytest.mark.parametrize("text", ["2025/12/22", "2025-12-22", "2025.12.22", "22/12/2025", "22.12.2025"])
def test_dates(spark, text):
    assert one(spark, U.parse_date(F.col("d")), d=text) == datetime.date(2025, 12, 22)


@pytest.mark.parametrize("text", ["x", "", None, "2025-13-40", "unknown"])
def test_no_dates(spark, text):
    assert one(spark, U.parse_date(F.col("d")), d=text) is None


def test_site_layouts(spark):
    a, b = H.site_a_text(F.col("h")), H.site_b_text(F.col("h"))
    assert one(spark, a, h='<div id="content"><p>x <b>y</b></p><div><p>ad</p></div></div>') == "xy"
    assert one(spark, a, h='<body><div class="big post_content"><p>x</p><div><div>ad</div><p>no</p></div><script>s</script><p>y</p></div><p>out</p>') == "x y"
    assert one(spark, b, h='<div id="content"><h1>T</h1><div id="textblock">a<br>b<div>ad</div></div></div>') == "a b"
    assert one(spark, b, h='<div id="content"><h1>T</h1>a<div>ad<div>x</div></div> b</div>c') == "a b"
    assert one(spark, a, h="") == "" and one(spark, a, h=None) is None and one(spark, b, h="<p>x") == "" and one(spark, b, h=None) is None


def test_generic_layout(spark):
    g = H.generic_text(F.col("h"))
    assert one(spark, g, h="<body><nav>n</nav><main>m</main></body>") == "m"
    assert one(spark, g, h="") == "" and one(spark, g, h=None) is None
    assert one(spark, g, h="<article>a<article>b</article>c</article>d") == "a b c"
    assert one(spark, g, h="<body>x<article> </article></body>") == ""
    assert one(spark, g, h='<main>m</main><div class="post-content wide">p<div>q</div></div>') == "p q"
    assert one(spark, g, h="<div class=content>p</div><body>no</body>") == "p"
    assert one(spark, g, h='<section class="contents">no</section><main class="x">m') == "m"
    assert one(spark, H.normalize_space(F.col("h")), h="a b ") == "a b"


def test_character_references(spark):
    from html import unescape

    d = H.decode_entities(F.col("h"))
    for text in ("a", "", "&laquo;x&raquo; &#8212; &#xBB;", "&amp;lt;", "&auml;&Ouml;&euro;&hellip;&Alpha;", "&#128512;&#x1F600;", "&#150;&#0;&#xD800;&#9999999;", "&nosuch;&", "A&B; &#; &#x;", "&lt;b&gt;"):
        assert one(spark, d, h=text) == unescape(text), text
    assert one(spark, d, h=None) is None


def test_sitemap(spark):
    lines = spark.createDataFrame([("<loc>http://a/1</loc>",), ("<url>",), ("  <loc>ftp://x</loc>",), (None,)], "value STRING")
    assert [r.url for r in R.sitemap_urls(lines).collect()] == ["http://a/1"]
    assert [r.url for r in R.sitemap_urls(lines.selectExpr("replace(value, 'http:', '  http:') AS value")).collect()] == ["http://a/1"]


def test_xml_round_trip(spark, tmp_path):
    clean = spark.createDataFrame([(1, "a & <b>", "http://u/1", "s"), (2, "", "http://u/2", "s"), (3, "я", "http://u/3", "t")], "doc_id BIGINT, text STRING, url STRING, source STRING")
    path = str(tmp_path / "x")
    S.articles_xml(clean, path)
    got = {r.doc_id: (r.source, r.url, r.content, r.statistics.character_count) for r in R.articles_xml(spark, path).collect()}
    assert got == {1: ("s", "http://u/1", "a & <b>", 7), 3: ("t", "http://u/3", "я", 1)}
    assert S.validate_xml(spark, path) == (2, "a & <b>")
    whole = "".join(r.value for r in spark.read.option("wholetext", True).text(path).collect())
    assert "<total_articles>2</total_articles>" in whole and "<generated_date>2024</generated_date>" in whole and 'version="1.0"' in whole and "xmlns=" in whole


def test_csv_round_trip(spark, tmp_path):
    t = spark.createDataFrame([(1, 'a"b'), (2, "в,г")], "doc_id BIGINT, token STRING")
    S.token_rows(t, str(tmp_path / "t"))
    assert {tuple(r) for r in R.tokens_csv(spark, str(tmp_path / "t")).collect()} == {(1, 'a"b'), (2, "в,г")}
    m = spark.createDataFrame([(1, "u", "f", "d", "2025/01/01"), (2, "u", "f", "d", "2025/01/02")], R.METADATA_SCHEMA)
    S.metadata_csv(m, str(tmp_path / "m"))
    S.metadata_csv(m.where("id = 2"), str(tmp_path / "m"))
    assert R.last_published(R.metadata_csv(spark, str(tmp_path / "m"))).first().date_published == "2025/01/02"


def test_html_folder_and_charsets(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.html").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "b.htm").write_bytes(b"ok\xff")
    (tmp_path / "c.txt").write_bytes(b"no")
    files = R.html_folder(spark, str(tmp_path))
    assert R.html_folder_count(spark, str(tmp_path)) == 2
    cp = {r.path[-6:]: r.t for r in files.select("path", R.decode_bytes(F.col("content"), "windows-1251").alias("t")).collect()}
    assert cp["a.html"] == "Привет"
    utf = {r.path[-5:]: r.t for r in files.select("path", R.decode_bytes(F.col("content")).alias("t")).collect()}
    assert utf["b.htm"] == "ok�"


def test_declared_charset(spark):
    d = R.declare_utf8(F.col("h"))
    assert one(spark, d, h='<head><meta http-equiv="x" content="text/html; charset=windows-1251">').count("UTF-8") == 2
    assert one(spark, d, h='<head><meta charset="utf-8"></head>') == '<head><meta charset="utf-8"></head>'


def test_canonical_addresses(spark):
    same = ["https://a.example/x/y/", "http://WWW.A.EXAMPLE:80//x/y", "https://a.example:443/x/y?utm_source=m#top", "https://a.example/x/%79"]
    other = ["https://b.a.example/x/y", "https://a.example/x/y?page=2", "https://a.example/x/Y"]
    c = U.canonical(F.col("u"))
    keys = {one(spark, c, u=u) for u in same}
    assert len(keys) == 1 and keys.isdisjoint({one(spark, c, u=u) for u in other})
    assert one(spark, c, u="http://a/?b=1&a=2&fbclid=3") == one(spark, c, u="https://a?a=2&b=1")
    assert one(spark, c, u=None) is None


def test_absolute(spark):
    a = U.absolute(F.col("b"), F.col("h"))
    assert one(spark, a, b="https://s/x/y", h="/z") == "https://s/z"
    assert one(spark, a, b="https://s/x/y", h="z") == "https://s/x/z"
    assert one(spark, a, b="https://s/x/y", h="//t/z") == "https://t/z"
    assert one(spark, a, b="https://s/x/y", h="mailto:q") == "mailto:q"


@pytest.mark.parametrize("base", ["https://s/x/y?q=1#f", "https://s", "https://s/", "https://s/a/b/c/"])
def test_absolute_equals_the_library(spark, base):
    from urllib.parse import urljoin

    hrefs = ["", "#top", "?p=2", "z", "./z", "../z", "../../../z?u=/../v", "/z/../w", "/a/./b/", "..", ".", "z#f", "//t/z", "http://t/../z"]
    rows = spark.createDataFrame([(base, h) for h in hrefs], "b STRING, h STRING").select("h", U.absolute(F.col("b"), F.col("h")).alias("x")).collect()
    assert {r.h: r.x for r in rows} == {h: urljoin(base, h) for h in hrefs}


def test_file_names(spark):
    rows = spark.createDataFrame([("https://s/news/a:b", 1), ("https://s/a.html", 2), ("https://s/", 3), ("https://s", 4), (f"https://s/{'x' * 99}.html", 5), (None, 6)], "u STRING, n BIGINT")
    got = [tuple(r) for r in rows.select(U.file_name_flat(F.col("u"), F.col("n")), U.file_name_capped(F.col("u"), F.col("n"))).collect()]
    assert [a for a, _ in got] == ["news_a_b.html", "a.html", "article_3.html", "article_4.html", "x" * 99 + ".html", None]
    assert got[4][1] == "x" * 95 + ".html" and got[1][1] == "a.html"


def test_listing_links(spark):
    html = '<a href="/news/2025/01/02/x">by day</a><a href="/news/y">no</a><div class="News-list"><div><a href="/news/z">in</a></div></div><a href="/news/w">after</a><li class=item><a href="/q">no news</a><a href="/news/z">again</a>'
    rows = spark.createDataFrame([(html, "2025/01/02"), (html, None), (None, "x"), ("", "x")], "h STRING, d STRING")
    got = [r.x for r in rows.select(H.listing_links(F.col("h"), F.col("d")).alias("x")).collect()]
    assert got == [["/news/2025/01/02/x", "/news/z"], ["/news/z"], None, []]


def test_site_options():
    text = 'db:\n  host: localhost\nlogic:\n  base_url: https://s\n  source_name: s  # name\n  delay: 2.5\n  target_count: 7\n  recrawl_interval: 60 # a minute\n'
    assert R.site_options(text) == R.SiteOptions("s", "https://s", delay_seconds=2.5, target_count=7, recheck_seconds=60)


def test_tables_are_made_once(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS lexmill_test")
    try:
        S.create_tables(spark, "lexmill_test")
        S.create_tables(spark, "lexmill_test")
        assert {r.tableName for r in spark.sql("SHOW TABLES IN lexmill_test").collect()} == {"articles", "article_hashes", "parser_state"}
    finally:
        spark.sql("DROP DATABASE lexmill_test CASCADE")


def test_pages_sink_skips_known(spark, tmp_path):
    p = spark.createDataFrame([("s", "f1", "x"), ("t", "f2", "y")], "source_name STRING, filename STRING, html STRING")
    path = str(tmp_path / "p")
    S.pages_parquet(p, path)
    S.pages_parquet(p, path, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 2
