"""Tokenizer, mixing, reading level and batch deduplication against brute force."""

import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import history, mixing, pages, reading, tokenizer


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.Encoder()


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=tokenizer.load_ranks(tokenizer.RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aaabBz 019\n\t'sé日Жжя<|endoftext|>\U0001f600́\xa0")), max_size=60), max_size=5))
def test_ids_equal_the_library(encoder, reference, texts):
    offsets, ids = encoder.texts(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [reference.encode_ordinary(t) for t in texts]
    assert encoder.counts(texts).tolist() == [len(reference.encode_ordinary(t)) for t in texts]


def test_encode_rows(spark, reference):
    texts = [None, "", " ", "Привет, мир!", "a" * 20_000, "x<|endoftext|>y", "Привет, мир!"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id BIGINT, text STRING, ids INT")
    got = {r.doc_id: list(r.ids) for r in tokenizer.encode(df).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokenizer.encode(df.where("false")).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeinrst", "приветмао"])
def test_long_words_are_merged_in_few_rounds(encoder, reference, letters):
    rng = random.Random(7)
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (1, 2, 3, 50, 999, 20_000)] + [letters[0] * n for n in (5, 6, 7, 5_000)]
    assert [w.tolist() for w in encoder.words(words)] == [reference.encode_ordinary(w) for w in words]


def test_flow_prefers_few_repeats():
    cap = {("a",): 100, ("a", "b"): 100, ("b",): 10}
    flow = mixing.solve(cap, {"a": 150, "b": 60}, {"a": 2, "b": 3})
    assert sum(v for (_, s), v in flow.items() if s == "a") == 150
    assert sum(v for (_, s), v in flow.items() if s == "b") == 60
    assert all(sum(v for (q, _), v in flow.items() if q == p) <= c for p, c in cap.items())
    short = mixing.solve({("a",): 10}, {"a": 100, "b": 5}, {"a": 3, "b": 9})
    assert short == {(("a",), "a"): 30}
    assert mixing.solve({}, {}, {}) == {}
    assert mixing.solve({("a",): 10}, {"a": 35}, {"a": 10**9}) == {(("a",), "a"): 35}


def test_targets():
    rows = [dict(source=s, target_share=w, max_repeats=m) for s, w, m in (("a", 0.5, 2), ("b", 1.5, None), (None, 1.0, 1), ("c", None, 1), ("d", -1.0, 1), ("e", 0.1, 0))]
    assert mixing.targets(rows) == ({"a": 0.25, "b": 0.75}, {"a": 2, "b": 1})


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("red fast car lap wing".split()) for _ in range(rng.randint(20, 60))), "abcd"[min(3, rng.randrange(10) // 2)], 1) for i in range(600)]
    rows += [(1000 + i, "the same words again and again", s, 1) for i, s in enumerate("aabbc")] + [(2000, None, "a", 1), (2001, "", "b", 1), (2002, "no source", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, n_tokens INT")
    target = spark.createDataFrame([("a", 0.4, 3), ("b", 0.3, 3), ("c", 0.2, 2), ("zz", 0.1, 5)], "source STRING, target_share DOUBLE, max_repeats INT")
    chosen, report = mixing.mix(spark, docs, target, name="test_mix")
    c, r = chosen.collect(), {x.source: x for x in report.collect()}
    caps = {"a": 3, "b": 3, "c": 2}
    assert c and all(1 <= x.repeats <= caps[x.source] for x in c)
    homes = {}
    for i, t, s, _ in rows:
        homes.setdefault(t, set()).add(s)
    text = {i: t for i, t, _, _ in rows}
    assert all(x.source in homes[text[x.doc_id]] for x in c)
    for s in "ab":
        assert abs(r[s].tokens - r[s].quota) <= 0.02 * r[s].quota
    assert r["zz"].tokens == 0 and abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    held = {t: sorted(v & {"a", "b", "c"}) for t, v in ((t, {s for _, u, s, _ in rows if u == t and s}) for t in set(text.values()) if t)}
    own = {i: s for i, _, s, _ in rows}
    assert all(x.home == own[x.doc_id] and x.members == held[text[x.doc_id]] and x.source in x.members for x in c)
    again = mixing.mix(spark, docs, target, name="test_mix2")[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, c))
    assert mixing.mix(spark, docs.where("false"), target, name="test_mix3")[0].count() == 0


def test_repeated_rows_fill_their_source(spark):
    """Half of the rows repeat one text; each may be used, whether or not another source holds the text."""
    rng = random.Random(8)
    other = [(i, " ".join(rng.choice("red fast car lap wing".split()) for _ in range(30)), "b", 1) for i in range(300)]
    for k, more in enumerate(([], [(900, "one and the same text " * 6, "b", 1)])):
        rows = other + [(1000 + i, "one and the same text " * 6, "a", 1) for i in range(300)] + more
        docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, n_tokens INT")
        target = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 1), ("zz", 0.2, 1)], "source STRING, target_share DOUBLE, max_repeats INT")
        chosen, report = mixing.mix(spark, docs, target, name=f"test_rows{k}")
        c = chosen.collect()
        assert len({x.doc_id for x in c}) == len(c) and {x.repeats for x in c} == {1}
        for x in report.collect():
            assert x.source == "zz" or abs(x.tokens - x.quota) <= 0.02 * x.quota


EASY = "Папа ест суп дома. Мой друг ведёт счёт. Гость пьёт воду. Кот спит тут. Дед моет окно. Брат ждёт старт. "
HARD = "Нестационарное отделение пограничного слоя компенсирует систематическую погрешность телеметрии, тогда как гистерезисная деформация протектора ограничивает допустимую вариативность конфигураций. "
MID = "В пятницу пилот Анна Белова проверила карту торможений в закрытом парке, и трибуны встали. "


def test_reading_levels(spark):
    rng = random.Random(5)
    mix = lambda s, n: "".join(rng.sample([x + ". " for x in s.strip(". ").split(". ")] * n, n))
    rows = [(i, {1: mix(EASY, 20), 3: MID * rng.randint(4, 8), 5: HARD * rng.randint(2, 4)}[lv], lv) for i, lv in enumerate([1, 3, 5] * 20)]
    docs = spark.createDataFrame([(i, t, "xx", 0) for i, t, _ in rows] + [(900, None, "", 1), (901, "", "", 1), (902, " " * 400, "", 1), (903, "Папа ест суп.", "", 1), (904, "".join(f"{k}. Анна Белова 1:{k},5\n" for k in range(40)), "", 1), (905, HARD * 2000, "", 1)], "doc_id BIGINT, text STRING, lang STRING, level INT")
    labels = spark.createDataFrame([(i, lv) for i, _, lv in rows if i % 2] + [(1, None), (3, 1), (7777, 2)], "doc_id BIGINT, level INT")
    got = {r.doc_id: r.level for r in reading.levels(spark, docs, labels).collect()}
    held = [(got[i], lv) for i, _, lv in rows if i % 2 == 0]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert [got[k] for k in (900, 901, 902, 903, 904)] == [None] * 5 and got[905] == 5
    assert {r.level for r in reading.levels(spark, docs, labels.where("false")).collect()} == {None}


def edited(rng, w):
    w = list(w)
    for _ in range(max(1, len(w) // 40)):
        k = rng.randrange(len(w))
        if rng.random() < 0.5:
            del w[k]
        else:
            w.insert(k, rng.randrange(65536))
    return np.array(w, np.uint16)


@pytest.mark.parametrize("n", [20, 40, 90, 200, 600, 3000])
def test_segments_find_edited_copies(n):
    rng = random.Random(n)
    for _ in range(20):
        a = np.array([rng.randrange(65536) for _ in range(n)], np.uint16)
        b = edited(rng, a)
        assert shared(a, b)
        assert history.is_copy(a, b)
        c = np.array([rng.randrange(65536) for _ in range(n)], np.uint16)
        assert not history.is_copy(a, c)


def shared(a, b):
    """Whether a substring of ``b`` is a segment of ``a``, at a place that the bound allows."""
    (k, at), (p, q) = history.segments(a), history.probes(b)
    most = int(history.EDITS * max(len(a), len(b)))
    return any(x == y and abs(int(i) - int(j)) <= most for x, i in zip(k, at) for y, j in zip(p[p == x], q[p == x]))


def test_edits_fewer_than_segments_are_certain():
    """One edit in each segment but one still leaves a shared segment; classes are met by copies of any allowed length."""
    rng = random.Random(2)
    for n in (*range(32, 140, 5), 500, 1100, 4100):
        a = np.array([rng.randrange(65536) for _ in range(n)], np.uint16)
        (_, at), size = history.segments(a), history.class_of(n)[1]
        assert len(at) == history.class_of(n)[0] and (np.diff(at) >= size).all() and at[0] == 0 and at[-1] == n - size
        b = a.copy()
        spared = rng.randrange(len(at))
        for k, x in enumerate(at):
            if k != spared:
                b[x + size // 2] += 1
        assert shared(a, b)
        for m in (n - int(history.EDITS * n), n, int(n / (1 - history.EDITS))):
            sizes = {len(history.windows(np.arange(m, dtype=np.uint16), s)) for s in (history.RUN, *(s for _, s in history.SIZES))}
            assert m - size + 1 in sizes and np.isin(history.windows(np.arange(m, dtype=np.uint16), size), history.probes(np.arange(m, dtype=np.uint16))[0]).all()


def test_distance_is_levenshtein():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 90))] for _ in range(2))
        if rng.random() < 0.4:
            b = a[: len(a) // 2] + b[:5] + a[len(a) // 2 + 2 :]
        x, y, want = np.array(a, np.uint16), np.array(b, np.uint16), brute(a, b)
        assert history.distance(x, y, 200) == history.distance(y, x, 200) == want
        for most in (want - 1, want, want // 2):
            assert (history.distance(x, y, most) <= most) == (want <= most)


def test_words_apart_are_the_same_both_ways():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(30)] for _ in range(2))
        runs = lambda x: {tuple(x[i : i + 3]) for i in range(len(x) - 2)}
        both = runs(a) & runs(b)
        out = lambda x: sum(not any(tuple(x[j : j + 3]) in both for j in range(max(0, i - 2), i + 1)) for i in range(len(x)))
        x, y = np.array(a, np.uint16), np.array(b, np.uint16)
        assert history.apart(x, y) == history.apart(y, x) == out(a) + out(b)
    a = np.arange(200, dtype=np.uint16)
    assert history.apart(a, np.roll(a, 60)) == 0 and history.is_copy(a, np.roll(a, 40))
    assert history.apart(a, a[:150]) == 50 and not history.is_copy(a, a[::-1].copy())


def page(text):
    return f'<html><body><nav><ul><li>Menu</li></ul></nav><div id="content"><h1>T</h1><p>{text}</p></div></body></html>'


def test_duplicates(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = ["слово" + "абвгдежзик"[k % 10] + "лмнопрстуф"[k // 10 % 10] + "хцчшщыэюяь"[k // 100] for k in range(1000)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(120))
    t = [text() for _ in range(6)]
    start = 1000
    near = " ".join("другое" if k in (10, 50, 90) else w for k, w in enumerate(t[1].split()))
    rows = [
        (1, "http://a.example/1", page(t[0]), 10), (2, "http://a.example/2", page(t[1]), 20),
        (10, "https://www.a.example/9/?utm_x=1", page(t[0]), 1001), (11, "http://a.example/11", page(near), 1002),
        (12, "http://a.example/12", page(t[2]), 1003), (13, "http://a.example/13", page(t[2]), 1004), (14, "http://a.example/14", page(t[3]), 1005),
        (15, None, None, 1006), (16, "http://a.example/16", "", 1007), (17, "http://a.example/17", page("{{ body }}"), 1008), (18, "http://a.example/18", page("{{ body }}"), 1009),
        (None, "http://a.example/1", page(t[0]), 1010), (14, "http://a.example/14", page(t[3]), 1005), (19, "http://a.example/19", page(t[4]), None),
    ]
    a = spark.createDataFrame([(*r, "z") for r in rows], "id BIGINT, url STRING, html_content STRING, crawl_timestamp BIGINT, words STRING")
    from hashlib import md5

    h = md5(page(t[3]).encode()).hexdigest()
    hashes = spark.createDataFrame([("http://a.example:80/9", None, 1), (None, "0" + h.upper().lstrip("0") if h[0] == "0" else h.upper(), 1)], "url STRING, content_hash STRING, last_checked BIGINT")
    s = pages.sample(a)
    got = {(r.id, r.reason) for r in history.duplicates(spark, a, hashes, s, start, "test_p3").collect()}
    assert got == {(10, "url"), (10, "text"), (11, "text"), (13, "text"), (14, "hash")}
    assert history.duplicates(spark, a.where("false"), hashes, s, start, "test_p3e").count() == 0
    # History is parsed once, into a folder; a batch then comes without any earlier article.
    folder = str(tmp_path / "index")
    history.append(spark, history.stories(spark, a.where("crawl_timestamp < 1000"), s), folder)
    batch = a.where("crawl_timestamp >= 1000")
    assert {(r.id, r.reason) for r in history.duplicates(spark, batch, hashes, s, start, "test_p3f", folder).collect()} == got
    before = spark.read.parquet(f"{folder}/stories").count()
    new = history.stories(spark, batch, s)
    history.append(spark, new, folder)
    history.append(spark, new, folder)  # what is there already is not added again
    assert spark.read.parquet(f"{folder}/stories").count() == before + 3


def story_rows(spark, rows):
    df = spark.createDataFrame([(i, t, len(w), np.array(w, np.uint16).tobytes()) for i, t, w in rows], "id BIGINT, t BIGINT, n INT, words BINARY")
    return df.selectExpr("id", "t", "xxhash64(words) AS story", "n", "words")


def test_hot_segments_are_read_whole(spark, monkeypatch):
    """More stories than the first round reads share a segment; the one copy comes last."""
    monkeypatch.setattr(history, "FIRST", 2)
    rng = random.Random(9)
    head = [rng.randrange(65536) for _ in range(20)]
    body = lambda: head + [rng.randrange(65536) for _ in range(130)]
    old = [body() for _ in range(12)]
    copy = list(old[-1])
    copy[70] = 1
    df = story_rows(spark, [(i, 10 + i, w) for i, w in enumerate(old)] + [(99, 5000, copy)])
    assert [r.id for r in history.text_copies(spark, df, 1000, "test_hot").collect()] == [99]


@pytest.mark.parametrize("n", [80, 150])
def test_one_shared_segment_is_enough(spark, n):
    """All segments but one are edited; the verifier takes the copy."""
    rng = random.Random(n)
    old = [np.array([rng.randrange(65536) for _ in range(n)], np.uint16) for _ in range(3)]
    size = history.class_of(n)[1]
    copy = old[1].copy()
    copy[history.segments(old[1])[1][:-1] + size // 2] += 1
    assert len(np.intersect1d(history.segments(old[1])[0], history.probes(copy)[0])) == 1
    assert history.is_copy(old[1], copy)
    df = story_rows(spark, [(i, 10 + i, w) for i, w in enumerate(old)] + [(99, 5000, copy)])
    assert [r.id for r in history.text_copies(spark, df, 1000, f"test_one{n}").collect()] == [99]


def test_the_bound_loses_no_copy():
    rng = random.Random(4)
    for _ in range(150):
        a = np.array([rng.randrange(40) for _ in range(rng.randrange(1, 60))], np.uint16)
        others = [np.array([rng.randrange(40) for _ in range(rng.randrange(1, 60))], np.uint16) for _ in range(5)]
        others += [edited(rng, edited(rng, edited(rng, a))) for _ in range(5) if len(a) > 9] + [a, np.roll(a, 7)]
        rng.shuffle(others)
        may = history.may_copy(a, others)
        assert all(m or not history.is_copy(a, b) for m, b in zip(may, others))
    unlike = [np.arange(k, k + 90, dtype=np.uint16) for k in (1000, 2000)]
    assert history.may_copy(np.arange(90, dtype=np.uint16), unlike).tolist() == [False, False]


@pytest.mark.parametrize("n, at", [(6, [5]), (12, [3, 8]), (20, [3, 9, 16]), (31, [3, 14, 28])])
def test_edited_copies_of_short_stories(spark, n, at):
    rng = random.Random(n)
    old = [np.array([rng.randrange(65536) for _ in range(n)], np.uint16) for _ in range(3)]
    copy = old[1].copy()
    copy[at] += 1
    df = story_rows(spark, [(i, 10 + i, w) for i, w in enumerate(old)] + [(99, 5000, copy)])
    assert [r.id for r in history.text_copies(spark, df, 1000, f"test_short{n}").collect()] == [99]


def test_short_stories_are_searched_exactly():
    rng = random.Random(6)
    seen = 0
    for _ in range(4000):
        a = np.array([rng.randrange(12) for _ in range(rng.randrange(1, history.SHORT))], np.uint16)
        b = np.array(([rng.randrange(12) for _ in range(rng.randrange(4))] + a.tolist()[rng.randrange(3) :])[: rng.randrange(1, 80)] + [rng.randrange(12) for _ in range(rng.randrange(30))], np.uint16)
        if history.is_copy(b, a) and not np.array_equal(a, b):
            seen += 1
            assert len(np.intersect1d(history.segments(a)[0], history.probes(b)[0]))
    assert seen > 200


def test_batches_on_a_kept_index_equal_one_run(spark, monkeypatch, tmp_path):
    """History is written once, each batch probed and appended."""
    monkeypatch.setattr(history, "FIRST", 2)
    rng = random.Random(12)
    fresh = lambda n: [rng.randrange(65536) for _ in range(n)]
    head = fresh(20)
    days = [[head + fresh(130) for _ in range(6)] + [fresh(n) for n in (6, 12, 40, 90, 300)]]
    for _ in range(2):
        earlier = [w for day in days for w in day]
        today = [fresh(n) for n in (7, 50, 120)] + [earlier[3]] + [edited(rng, w).tolist() for w in earlier[5:]]
        days.append(today + [edited(rng, today[2]).tolist()])
    rows, n = [], 0
    for d, day in enumerate(days):
        for k, w in enumerate(day):
            rows.append((n, 1000 * d + k, w))
            n += 1
    df = story_rows(spark, rows)
    whole = {r.id for r in history.text_copies(spark, df, 1000, "test_whole").collect()}
    folder, got = str(tmp_path / "index"), set()
    history.append(spark, df.where("t < 1000"), folder)
    for d in (1, 2):
        batch = df.where(f"t >= {1000 * d} AND t < {1000 * (d + 1)}")
        got |= {r.id for r in history.text_copies(spark, batch, 1000 * d, f"test_day{d}", folder).collect()}
        history.append(spark, batch, folder)
    assert got == whole and len(whole) > 20
    assert not {i for i, t, _ in rows if t % 1000 < 3 and t >= 1000} & whole
