import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.functions import lexical as L
from lexmill.operators import vocab

GOLDEN = dict(
    p.split(">")
    for p in "гонщики>гонщик гонщиков>гонщик гонщикам>гонщикам команда>команд команды>команд командами>команд чемпионат>чемпионат чемпионата>чемпионат чемпионате>чемпионат побед>побед победа>побед победы>побед победами>побед этап>этап этапа>этап этапов>этап этапами>этап машина>машин машины>машин машинами>машин трасса>трасс трассы>трасс трассе>трасс racing>rac races>race raced>rac driver>driv drivers>driver driving>driv red>red used>used seeds>seed она>он ну>ну".split()
)


def rows(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING")


def tokens(spark, text, mode="index"):
    return [r.token for r in L.kept_tokens(rows(spark, text), "doc_id", "text", mode, True).orderBy("pos").collect()]


def test_stemmer_golden(spark):
    df = spark.createDataFrame([(w,) for w in GOLDEN], "w STRING").select("w", L.stem(F.col("w")).alias("s"))
    assert {r.w: r.s for r in df.collect()} == GOLDEN
    assert L.stem_word("driver") == "driver"
    assert all(L.stem_word(w, L.INDEX_SUFFIXES) == s for w, s in GOLDEN.items())


def test_fold_is_narrow(spark):
    got = rows(spark, "РЯБИНА Ёлка ÉTÉ").select(L.fold(F.col("text")).alias("f")).first().f
    assert got == "рябина ёлка ÉtÉ"


@pytest.mark.parametrize(
    "text,mode,want",
    [
        ("«Феррари» — лидер", "index", ["«феррари»", "—", "лидер"]),
        ("5 a % я", "index", ["a", "я"]),
        ("http httpd www1 f1 news cdata", "index", []),
        ("AT&T", "frequency", ["at&t"]),
        ("AT&T", "index", ["at", "t"]),
        ("я" * 24 + " " + "я" * 25, "index", ["я" * 24]),
        ("", "index", []),
    ],
)
def test_tokens(spark, text, mode, want):
    assert tokens(spark, text, mode) == want


def test_null_text_has_no_tokens(spark):
    assert L.kept_tokens(rows(spark, None), "doc_id", "text").count() == 0


def test_ranks_match_a_global_window(spark):
    words = "б б а а в г г г aa ab aa ac b b b".split()
    df = spark.createDataFrame([(w,) for w in words], "token STRING")
    got = [(r.rank, r.token, r.freq) for r in vocab.ranked(vocab.frequencies(df)).orderBy("rank").collect()]
    want = sorted({(-words.count(w), w) for w in words})
    assert got == [(i, w, -n) for i, (n, w) in enumerate(want, 1)]


def test_empty_vocabulary(spark):
    freq = vocab.frequencies(spark.createDataFrame([], "token STRING"))
    assert vocab.summary(freq).first().total_tokens == 0
    assert vocab.ranked(freq).count() == 0
    assert vocab.zipf_table(freq).count() == 0


def test_log_series_saturates(spark):
    r = spark.range(1).select(vocab.log_series(F.lit(10.0)).alias("a"), vocab.log_series(F.lit(1000.0)).alias("b")).first()
    assert abs(r.a - 2.302585) < 1e-3 and abs(r.b - 4.88) < 0.01


@given(st.text("абвaьeing edlyers", max_size=12))
def test_stem_word_strips_once_and_leaves_three_bytes(w):
    s = L.stem_word(w, L.INDEX_SUFFIXES)
    assert w.startswith(s) and (s == w or len(s.encode()) >= 3)
