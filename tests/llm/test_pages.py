"""Blocks and the page operators against brute force, on small pages with hard cases."""

from hashlib import md5

import pytest
import regex

from lexmill.llm import encoding, history, lines, mainbody, markup, pages, residue, terms
from lexmill.llm.blocks import blocks, blocks_with_paths, clean

SCHEMA = "id BIGINT, html_content STRING, source_name STRING, text STRING, n INT"


def articles(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, h, s, "x", 1) for i, h, s in rows], SCHEMA)


def story(n, name="Анна Белова"):
    body = "".join(f"<p>В пятницу пилот {name} номер {k} проверил карту торможений в закрытом парке, и трибуны встали.</p>\n" for k in range(n, n + 4))
    return f'<html><head><title>t</title></head><body><div class="c12abm"><div><a href="/">Главная</a></div><div>Архив</div></div><div id="content"><h1>Заголовок {n}</h1>\n{body}<p>Автор: {name}</p></div><footer><p>© site.example, 2024</p></footer></body></html>'


@pytest.mark.parametrize(
    "html,want",
    [
        (None, []),
        ("", []),
        ("a\n\n b&nbsp;&amp;lt; \r\nc", ["a", "b &lt;", "c"]),
        ("<p>x<b>y</b>z</p>w<br>v", ["xyz", "w", "v"]),
        ("<head>h</head><script>s</script><!-- c <p>d</p> --><noscript>n</noscript>e<style>", ["e"]),
        ("<abbr>x</abbr>y", ["x", "y"]),
    ],
)
def test_blocks(html, want):
    assert blocks(html) == want
    assert [b for b, _ in blocks_with_paths(html)] == want


def test_paths_close_implied_tags():
    assert [p for _, p in blocks_with_paths("<ul><li>a<li>b</ul><p>c<p>d")] == [("ul", "li"), ("ul", "li"), ("p",), ("p",)]


def test_terms_against_brute_force(spark):
    rows = [(1, "<p>Ёлка ёлка x²y</p>", "s"), (2, "Ёлка 5 d'or", None), (2, "Ёлка 5 d'or", None), (3, "", "s"), (4, None, "s"), (5, "é́ ÀB", "s")]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in pages.term_marks(articles(spark, rows)).collect()}
    occ, rec = {}, {}
    for _, h, _ in rows:
        found = [t.lower() for b in blocks(h) for t in regex.findall(r"\p{L}+", b)]
        for t in found:
            occ[t] = occ.get(t, 0) + 1
        for t in set(found):
            rec[t] = rec.get(t, 0) + 1
    assert {t: v[:2] for t, v in got.items()} == {t: (occ[t], rec[t]) for t in occ}
    assert got["ёлка"][2] == "common" and got["x"][2] == "rare"
    assert pages.term_marks(articles(spark, [])).count() == 0


def test_lines_against_brute_force(spark):
    rows = [(i, f"<p>Share it ({i})!</p><p>own {'q' * i}</p><p>42</p>", "s") for i in range(12)] + [(3, "<p>SHARE it</p>", "s")] * 3
    rows += [(100 + i, "<p>Share it</p>", "t") for i in range(4)] + [(200, "<p>Share it</p>", None), (None, "<p>Share it</p>", "s")]
    got = {(r.source_name, r.line_md5, r.records) for r in pages.repeated_lines(articles(spark, rows)).collect()}
    assert got == {("s", md5(b"shareit").hexdigest(), 12)}
    assert pages.repeated_lines(articles(spark, [])).count() == 0
    kept = {r.id: r.text for r in pages.without_lines(articles(spark, rows)).where("id <> 3").collect()}
    assert kept[5] == "own qqqqq\n42" and kept[101] == "Share it" and kept[200] == "Share it"
    assert pages.without_lines(articles(spark, rows)).count() == len(rows)


def test_bitmaps():
    import numpy as np

    for n in (1, 100, 5000, 65536):
        x = np.unique(np.random.default_rng(n).integers(0, 65536, n))
        y = np.unique(np.random.default_rng(n + 1).integers(0, 65536, n))
        a, b = lines.pack(x), lines.pack(y)
        assert lines.unpack(a).tolist() == x.tolist() and lines.cardinality(a) == len(x)
        u = lines.unite([a, b, a])
        assert lines.unpack(u).tolist() == np.union1d(x, y).tolist() and lines.cardinality(u) == len(np.union1d(x, y))
        assert [lines.contains(u, k) for k in range(0, 65536, 97)] == np.isin(np.arange(0, 65536, 97), np.union1d(x, y)).tolist()


def test_occurrences_are_packed_like_single_bitmaps():
    import numpy as np

    rng = np.random.default_rng(5)
    held, want = lines.Occurrences(), {}
    for _ in range(40):
        rows = []
        for _ in range(500):
            i, source = int(rng.integers(0, 200_000)), f"s{rng.integers(0, 3)}"
            keys = {lines.line_key(f"l{k}") for k in rng.integers(0, 4, 3)}
            rows.append((i, source, keys))
            for k in keys:
                want.setdefault((source, k, i >> 16), set()).add(i & 0xFFFF)
        held.add(rows)
    names, source, keys, span, bits = held.drain()
    got = {(names[a], k, h): set(lines.unpack(b).tolist()) for a, k, h, b in zip(source.tolist(), keys, span.tolist(), bits)}
    assert got == want and len(got) == len(keys) and held.size == 0 and held.drain()[2] == []


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_lines_are_deleted_by_either_way(spark, monkeypatch, most):
    """Bitmaps looked up in place and bitmaps joined by span give the same text; ids span containers."""
    monkeypatch.setattr(pages, "LOOKED_UP", most)
    rows = [(i * 9_000, f"<p>Share it</p><p>own {'q' * i}</p><p>42</p>", "st"[i % 2]) for i in range(24)] + [(7, None, "s"), (None, "<p>Share it</p>", "s"), (8, "<p>Share it</p>", None), (9, "<p>Share it</p>", "u")]
    got = {r.id: r.text for r in pages.without_lines(articles(spark, rows)).collect()}
    assert got == {i * 9_000: f"own {'q' * i}".strip() + "\n42" if i else "own\n42" for i in range(24)} | {7: "", None: "Share it", 8: "Share it", 9: "Share it"}


def corpus():
    ru = "В пятницу пилот Анна Белова проверила карту торможений. «Дождь всё изменил за минуту», — сказал Олег Смирнов. Неожиданно для всех судьи взяли паузу."
    de = "Überraschend prüfte der Fahrer die Lenkung auf nasser Straße, während die Tribüne jubelte."
    en = "During warm-up the engineer kept the brake map in a crosswind, just like last year."
    return [[f"{ru} {i}", f"{de} {i}", f"{en} {i}", f"Номер {i} снова на старте"] for i in range(60)]


def test_encoding_round_trips():
    model = encoding.fit(corpus())
    repair = encoding.Repairer(model)
    texts = ["Неожиданно пилот проверила карту торможений, и судьи взяли паузу", "«Дождь всё изменил», — сказал Олег"]
    for written, read in (("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp866", "cp1251"), ("cp1251", "koi8-r")):
        for t in texts:
            try:
                raw = t.encode(written)
            except UnicodeEncodeError:
                continue
            bad = "".join(encoding._FROM_BYTES[read][b] for b in raw)
            assert repair([bad]) == {0: t}, (written, read)
    twice = "".join(encoding._FROM_BYTES["cp1252"][b] for b in "".join(encoding._FROM_BYTES["cp1252"][b] for b in texts[0].encode()).encode())
    assert repair([twice]) == {0: texts[0]}
    assert repair([*texts, "Straße während", "Ðalmar Þórsen", "", "plain"]) == {}
    assert repair(["a � b", "???? ????? ???"]) == {0: None, 1: None}
    assert repair(["И кто теперь первый??? Анна молчит."]) == {}


def test_residue():
    ok = [[f"В пятницу пилот Анна проверила карту торможений номер {i}, и трибуны встали. «Сайт выдавал ошибку 404», — сказала она, — мы считали вручную."] * 3 + ["Главная", "Архив", f"\\section{{Ход {i}}}", f"Олег Белов 1:{i}", "Как Анна удивила Порт"] for i in range(80)]
    bad = [[f"404 Not Found", "The page has moved.", f"Ref. {i}", "Главная"] for i in range(10)] + [["{{ title }}", "Dear %%name%%, your story is ready", "Главная"]] * 4
    judge = residue.Judge(residue.fit(ok + bad))
    assert not any(judge(r) for r in ok) and all(judge(r) for r in bad)
    assert judge(["The page has moved."]) and judge(["null null"]) and judge(["$[teaser]"])
    assert not judge([]) and not judge(["Главная"]) and not judge([r"\begin{itemize} \item x \end{itemize}"]) and not judge(["Шаблон {утро/вечер} утвердит Анна."])
    assert not residue.Judge(residue.fit([]))(["404 Not Found again and again in a long story about nothing at all that goes on and on"])


def test_main_body_learns_the_layout(spark):
    train = [blocks_with_paths(story(n)) for n in range(0, 240, 4)]
    tagger = mainbody.fit(train, epochs=12)
    test = [blocks_with_paths(story(n, "Олег Смирнов")) for n in range(1000, 1040, 4)]
    right = total = 0
    for page, mask in zip(test, tagger.label(test)):
        want = mainbody.teach(page)
        right += sum(int(m) == w for m, w in zip(mask, want))
        total += len(want)
    assert right >= 0.97 * total
    assert tagger.label([]) == [] and tagger.label([[]])[0].tolist() == []
    assert not mainbody.fit([]).label([test[0]])[0].any()


def test_gradients_match_differences():
    import numpy as np

    page = blocks_with_paths(story(1))
    y = np.array(mainbody.teach(page), np.float32)
    m = mainbody.Tagger(mainbody._start(np.random.default_rng(1)))
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    s = mainbody.encode([page, page[:5]])
    y = np.concatenate([y, y[:5]])
    _, g = mainbody._gradients(m, s, y)
    for name in ("whf", "wxb", "biasf", "out"):
        k = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        old, e = m.w[name][k], 1e-3
        m.w[name][k] = old + e
        up = mainbody._gradients(m, s, y)[0]
        m.w[name][k] = old - e
        down = mainbody._gradients(m, s, y)[0]
        m.w[name][k] = old
        assert abs((up - down) / (2 * e) - g[name][k]) < 0.05 * abs(g[name][k]) + 1e-4


@pytest.mark.parametrize(
    "text,want",
    [
        ("## Что сказал Олег", {("markdown", "heading")}),
        ("Хронология\n=========", {("markdown", "heading")}),
        ("== Ход гонки ==", {("wiki", "heading")}),
        ("- раз\n- два", {("markdown", "list")}),
        ("1. раз", {("markdown", "list")}),
        ("* [[Анна]] 1:02", {("wiki", "list"), ("wiki", "inline")}),
        ("```\nx = [t for t in y if t < 5]\n# no\n```", {("markdown", "code")}),
        ("`gap = a - b`", {("markdown", "code")}),
        ("<pre><code>a <b> c</code></pre>", {("html", "code")}),
        (r"\begin{verbatim} SELECT * FROM t \end{verbatim}", {("latex", "code")}),
        (r"в парке $a_{y} = v^{2}/r$.", {("latex", "formula")}),
        (r"\[ P = F \cdot v \]", {("latex", "formula")}),
        ("в парке $a_{y} = " + " + ".join(f"x_{{{k}}}" for k in range(200)) + "$.", {("latex", "formula")}),
        ("цена $" + "9" * 300_000 + " и $5", set()),
        ("бюджет $98 млн, а призовые $62 млн", set()),
        ("Номер #83, формула 5*3, lap_time_1_final.csv [1]", set()),
        ("{| class=\"wikitable\"\n|-\n! А !! Б\n|}", {("wiki", "table")}),
        ("| # | А |\n|---|:--|\n| 1 | 2 |", {("markdown", "table")}),
        (r"\begin{tabular}{ll} А & 1 \\ \end{tabular}", {("latex", "table")}),
        ("<table><tr><td>А</td></tr></table>", {("html", "table")}),
        ("пауза.&nbsp;Олег", {("html", "inline")}),
        ("[Анна](/news/1) и **Олег**", {("markdown", "inline")}),
        (r"пауза.~\cite{lap1}", {("latex", "inline")}),
        ("'''Олег'''", {("wiki", "inline")}),
        ("", set()),
    ],
)
def test_constructs(text, want):
    assert markup.constructs(text) == want


@pytest.mark.parametrize(
    "text,want",
    [
        ("## Ход", "# Ход"),
        ("== Ход ==", "# Ход"),
        (r"\section*{Ход}", "# Ход"),
        ("<h3>Ход</h3>", "# Ход"),
        ("* [[Анна|Аня]] 1:02", "- Аня 1:02"),
        (r"\begin{itemize} \item a \item b \end{itemize}", "- a\n- b"),
        ("`x < 5`", "```\nx < 5\n```"),
        ("$$P = F$$", "$P = F$"),
        (r"\begin{tabular}{ll} А & 1 \\ Б & 2 \\ \end{tabular}", "| А | 1 |\n| Б | 2 |"),
        ("**Олег** и [Анна](/n)", "Олег и Анна"),
        ("просто текст", "просто текст"),
        ("", ""),
    ],
)
def test_clean_text(text, want):
    assert markup.clean_text(text) == want


def test_queries_on_hard_rows(spark):
    rows = [(n, story(n), "s") for n in range(0, 120, 4)]
    rows += [(500, "", "s"), (501, None, None), (502, "x" * 300_000, "s"), (None, story(7), "s"), (0, story(0), "s"), (503, "<p>{{ body }}</p>", "s"), (504, story(900).replace("<p>В", "<p>## Ход</p><p>В", 1), "s")]
    a = articles(spark, rows)
    s = pages.sample(a)
    assert {r.id for r in pages.residue_cases(spark, a, s).collect()} == {503}
    got = {(r.id, r.block_md5) for r in pages.main_blocks(spark, a, s).collect()}
    want = {(n, pages.hex_md5(t)) for n, h, _ in rows[:30] for (t, p), y in zip(blocks_with_paths(h), mainbody.teach(blocks_with_paths(h))) if y}
    assert len(got & want) >= 0.9 * len(want) and all(i is not None for i, _ in got)
    assert (504, "markdown", "heading") in {tuple(r) for r in pages.markup_constructs(spark, a, s).collect()}
    assert pages.clean_stories(spark, a, s).count() == len(rows)
    assert pages.garbled_blocks(spark, a, s).count() == 0


def garble(text):
    return "".join(encoding._FROM_BYTES["cp1252"][b] for b in text.encode())


def test_restored_and_clean_records(spark):
    """p7_text restores blocks and counts the lost ones; p6_text gives the same story garbled or not."""
    rows = [(n, story(n), "s") for n in range(0, 200, 4)]
    body = story(900)
    rows += [(500, garble(body), "s"), (501, body, "s"), (502, "<p>ab � cd</p><p>plain</p>", "s"), (503, None, "s"), (504, "", "s"), (None, body, "s")]
    a = articles(spark, rows)
    s = pages.sample(a)
    got = {r.id: r for r in pages.restored_records(spark, a, s).collect()}
    body_of = lambda i: got[i].text.split("\n")[:-1]  # noqa: E731  a footer of one odd sign is too short to be told
    assert body_of(500) == body_of(501) and got[500].restored > 4 and got[501].restored == got[501].lost == 0
    assert (got[502].text, got[502].restored, got[502].lost) == ("ab � cd\nplain", 0, 1)
    assert got[503].text == got[504].text == "" and len(got) == len({i for i, _, _ in rows})
    clean_ = {r.id: r.text for r in pages.clean_stories(spark, a, s).collect()}
    assert clean_[500] == clean_[501] != ""


def rich(n):
    return story(n).replace("и трибуны встали", "и трибуны встали, хотя дождь так и не начался до самого вечера этого дня")


def test_one_decision_on_residue(spark):
    """Problems 1, 2 and 6 leave out the same pages, garbled ones too."""
    rows = [(n, rich(n), "s") for n in range(0, 200, 4)] + [(600 + k, f"<p>404 Not Found</p><p>Страница не найдена {k}</p>", "s") for k in range(8)]
    rows += [(700, garble("<p>Страница не найдена 3</p>"), "s"), (701, rich(800).replace("<p>Автор", "<p>{{ body }}</p><p>Автор"), "s")]
    a = articles(spark, rows)
    s = pages.sample(a)
    cases = {r.id for r in pages.residue_cases(spark, a, s).collect()}
    assert cases == {*range(600, 608), 700, 701}
    assert not cases & {r.id for r in pages.main_blocks(spark, a, s).collect()}
    assert {r.id for r in pages.clean_stories(spark, a, s).where("text = ''").collect()} >= cases
    reader = pages.Reader(pages.fit_encoding(s), pages.fit_residue(s), True)
    assert {i for (i, _, _), c in zip(rows, reader([h for _, h, _ in rows])[2]) if c} == cases


def test_empty_table(spark):
    a = articles(spark, [])
    s = pages.sample(a)
    assert pages.main_blocks(spark, a, s).count() == pages.residue_cases(spark, a, s).count() == pages.markup_constructs(spark, a, s).count() == pages.garbled_blocks(spark, a, s).count() == 0


def test_clean_of_source():
    assert clean("a\x85b\xa0 c&nbsp;") == "a b c"
    assert terms.terms(["İx", "a1b"]) == ["i̇x", "a", "b"]


def test_last_seen_counters_keep_no_record_sets():
    """Every term is counted as it comes, with the record it was last seen in."""
    counter, seen = terms.LastSeen(), []

    def tokens(record):
        for t in record.split():
            yield t
            seen.append(list(counter.of.get(t, ())))

    for record in ("a b a", "b b", "", "a"):
        counter.add(tokens(record))
    assert seen == [[1, 1, 1], [1, 1, 1], [2, 1, 1], [2, 2, 2], [3, 2, 2], [3, 2, 4]]
    assert sorted(zip(*counter.drain())) == [("a", 3, 2), ("b", 3, 2)]


ODD_TEXTS = ["a😀é", "я😀Я", "é", "Ð¿Ñ€", "É", "größe", "яЯЯ", "ЯЯя", "\x85é", "prьfte die Lenkung", "наясдхрэ мю тнпсле", "Дождь всё изменил", "Ãœbung", "„Straße“", "пЯТЬ ШЕСТЬ", "±±± é"]


def test_screens_of_many_texts_equal_those_of_one():
    texts = [*ODD_TEXTS, "plain", *(t for n in range(0, 40, 4) for t in blocks(story(n)))]
    assert encoding.clean_mask(texts).tolist() == [encoding.looks_clean(t) for t in texts]
    model = encoding.fit(corpus())
    wide = [t for t in texts if not t.isascii()]
    wide += [g for k, t in enumerate(wide) if (g := encoding._spoil(t, k))]
    got = encoding.gains(wide, model)
    assert got.tolist() == [encoding.best_chain(t, model)[0] for t in wide] and (got > 0).any()
    assert encoding.clean_mask([]).tolist() == encoding.gains([], model).tolist() == []


@pytest.mark.parametrize("every", [[story(n) for n in range(0, 400, 4)], ["<p>only ascii text</p>", "<p>more of it</p>"], [None, ""]])
def test_model_of_encodings_is_of_all_pages(spark, monkeypatch, every):
    """Counts, margin and gate are those of the whole table, however small the sample is."""
    monkeypatch.setattr(pages, "SHORT_SAMPLE", 5)
    monkeypatch.setattr(pages, "LONG_SAMPLE", 5)
    a = articles(spark, [(n, h, "s") for n, h in enumerate(every)]).repartition(3)
    got, want = pages.fit_encoding(pages.sample(a)), encoding.fit([[b for b in pages.raw_blocks(h) if b and not b.isspace()] for h in every])
    assert (got.gate, got.margin, got.size) == pytest.approx((want.gate, want.margin, want.size))
    assert (got.classes == want.classes).all() and (got.table == want.table).all()


def residue_rows():
    """Pages with body, pages of messages, and one leftover value that only a single page shows."""
    return [*(rich(n) for n in range(0, 120, 4)), *(f"<p>404 Not Found</p><p>Страница не найдена {k}</p>" for k in range(8)), *(f"<p>Коротко {k}</p><p>{rich(900)[-60:]}</p>" for k in range(6)), rich(700).replace("<p>Автор", "<p>{{ body }}</p><p>zyzzyva</p><p>Автор"), "<p>TODO zyzzyva</p><p>TODO</p>", None, ""]


@pytest.mark.parametrize("every", [residue_rows(), ["<p>Коротко</p>"], [None, ""]])
def test_model_of_residue_is_of_all_pages(spark, monkeypatch, every):
    """Weights and prior are those of the whole table, however small the sample is."""
    monkeypatch.setattr(pages, "SHORT_SAMPLE", 3)
    monkeypatch.setattr(pages, "LONG_SAMPLE", 3)
    a = articles(spark, [(n, h, "s") for n, h in enumerate(every)]).repartition(3)
    got, want = pages.fit_residue(pages.sample(a)), residue.fit([blocks(h) for h in every])
    assert got.prior == pytest.approx(want.prior) and got.weights == pytest.approx(want.weights, abs=1e-5)
    assert got.bound == pytest.approx(want.bound, abs=1e-5)
    assert any("zyzzyva" in w for w in want.weights) == (len(every) > 2)


def test_bound_of_residue_lies_under_every_trusted_passage():
    """A message whose words stand in many stories too is found by the model all the same."""
    model = residue.fit([[b.replace("трибуны", f"текст {n}") for b in blocks(rich(n))] for n in range(0, 400, 4)] + [["Текст текст текст текст текст."]] + [["404 Not Found", f"Страница не найдена {k}"] for k in range(200)])
    assert 0 < model.score("Текст текст текст текст текст.") < residue.THRESHOLD
    assert residue.Judge(model)(["Текст текст текст текст текст."]) and not residue.Judge(model)(blocks(rich(40)))


@pytest.mark.parametrize("every", [residue_rows(), ["<p>Коротко</p>"], [None, ""]])
def test_weights_of_words_and_tags_are_of_all_pages(spark, monkeypatch, every):
    """Weights are those of all pages without residue, however small the sample is."""
    monkeypatch.setattr(pages, "SHORT_SAMPLE", 3)
    monkeypatch.setattr(pages, "LONG_SAMPLE", 3)
    a = articles(spark, [(n, h, "s") for n, h in enumerate(every)]).repartition(3)
    s = pages.sample(a)
    got, judge = pages.fit_markup(s), residue.Judge(pages.fit_residue(s))
    want = markup.fit([p for h in every if not judge(blocks(h)) and (p := blocks_with_paths(h))])
    assert got.words == pytest.approx(want.words) and got.tags == pytest.approx(want.tags)
    assert bool(want.words) == bool(want.tags) == (len(every) > 2)


@pytest.mark.parametrize("visits", [1, 20_000])
def test_block_labeller_learns_from_all_pages(spark, monkeypatch, visits):
    """Every page's own word is learned, however small the sample is, and whether pages are gone through once or more often."""
    monkeypatch.setattr(pages, "SHORT_SAMPLE", 3)
    monkeypatch.setattr(pages, "LONG_SAMPLE", 3)
    monkeypatch.setattr(pages, "VISITS", visits, raising=False)
    monkeypatch.setattr(pages, "LEARNT", 20, raising=False)
    rows = [(n, story(n, f"qx{'abcdefgh'[k % 8]}{'klmnopqr'[k // 8]}"), "s") for k, n in enumerate(range(0, 240, 4))] + [(None, story(800, "qxnull"), "s"), (900, None, "s"), (901, "", "s")]
    a = articles(spark, rows).repartition(3)
    s = pages.sample(a)
    got, before = pages.fit_mainbody(s).w["words"], mainbody.start()["words"]
    own = [next(w for w in h.split() if w.startswith("qx")) for _, h, _ in rows[:61]]
    assert len(set(own)) == 61 and [w for w in own if (got[mainbody._WORDS[w]] == before[mainbody._WORDS[w]]).all()] == []
    if visits > 1:
        page = blocks_with_paths(story(1000, "Олег Смирнов"))
        assert sum(pages.fit_mainbody(s).label([page])[0] == mainbody.teach(page)) >= len(page) - 1


def test_added_lines_are_told_as_by_the_whole_pattern():
    texts = ["Автор: я", "сказал автор: я", "by Ann Lee!", "site.example", "see Foo.COM now", "x.de(", "a. bc", "1.ab", "ſ.ſſ", "", "Photo: x"]
    assert [mainbody.added(t) for t in texts] == [mainbody._ADDED.search(t) is not None for t in texts] == [True, False, True, True, True, False, False, False, True, False, True]


def test_stories_of_bare_records_need_all_pages(spark, monkeypatch):
    """An aside that few pages show is no part of a story in a record without tags either, however small the sample is."""
    monkeypatch.setattr(pages, "SHORT_SAMPLE", 3)
    monkeypatch.setattr(pages, "LONG_SAMPLE", 3)
    aside = lambda n: story(n).replace("<p>", "<aside><p>Членская карта клуба даёт скидку на билеты, программу и стоянку весь сезон.</p></aside><p>", 3)
    rows = [(n, 1, aside(n) if n % 20 == 0 else story(n)) for n in range(0, 800, 4)] + [(1000 + n, 1, "\n".join(blocks(aside(n)))) for n in range(0, 200, 20)]
    a = spark.createDataFrame(rows, "id BIGINT, crawl_timestamp BIGINT, html_content STRING").repartition(3)
    got = {r.id: r.story for r in history.stories(spark, a, pages.sample(a)).collect()}
    assert sum(got.get(1000 + n) == got[n] for n in range(0, 200, 20)) >= 9


def test_passages_that_cannot_be_cases_are_not_scored():
    """The bound that spares a passage its score never changes the decision."""
    model = residue.Model({"null": 4.0, "404": 2.5, "найдена": 3.0, "карта": -2.0, "\x03null": 2.5, "{x}": 2.0, "\x02{w}": 3.0, "\x04{w}": 2.0, "\x014": 0.5}, -5.0, 1.0)
    judge, scored = residue.Judge(model), []
    score = judge.score
    judge.score = lambda text: scored.append(text) or score(text)
    texts = ["null", "Null null", "null карта", "{x}", "a {x}, b", "{X} null", "404", "найдена", "Страница не найдена (404)!", "", "карта торможений", "трибуны встали " * 30, "null " * 30 + "карта"]
    got = [judge.passage(t) for t in texts]
    assert got == [model.score(t) > model.bound for t in texts] and True in got
    assert "null" in scored and not {"", "карта торможений", "трибуны встали " * 30} & set(scored)


def test_words_of_a_repeated_block_are_read_once(monkeypatch):
    read = []
    words = markup._words
    monkeypatch.setattr(markup, "_words", lambda text: read.append(text) or words(text))
    weights = markup.Weights({"трибуны": 1.0, "9": -0.5, "^трибуны": 0.25}, {"<p": -0.25})
    page = [("Трибуны 12", ("p",)), ("трибуны", ("p",)), ("Трибуны 12", ("p",))]
    assert weights.scores(page) == weights.scores(page) == [0.5, 0.25, -0.25] and sorted(read) == ["Трибуны 12", "трибуны"]
    assert words("Ёж_2²x — A1\x1fb!") == {"ёж", "9", "—", "a", "b", "!", "\x0141", "^ёж"}


def test_usual_blocks_are_looked_at_once(monkeypatch):
    """Blocks that the model finds usual are remembered, as are odd ones, and restored ones stay the same."""
    repair, asked = encoding.Repairer(encoding.fit(corpus())), []
    odd = encoding.suspicious
    monkeypatch.setattr(encoding, "suspicious", lambda raws, model: asked.extend(raws) or odd(raws, model))
    good, bad = "Неожиданно пилот проверила карту торможений, и судьи взяли паузу", "«Дождь всё изменил», — сказал Олег"
    raws = [good, "".join(encoding._FROM_BYTES["cp1252"][b] for b in bad.encode()), good, "plain", "a � b"]
    assert repair(raws) == repair(raws) == {1: bad, 4: None}
    assert sorted(asked) == sorted(raws[:2])


def test_states_of_a_batch_are_those_of_single_pages():
    """Rows laid out step by step give every page, of any length, its own scores; training keeps its states in one piece."""
    import numpy as np

    found = [blocks_with_paths(story(n)) for n in range(4)]
    found = [found[0][:3], found[1], [], found[2][:1], found[3]]
    tagger, s = mainbody.Tagger(mainbody.start()), mainbody.encode(found)
    alone = [tagger.scores(mainbody.encode([p])) for p in found]
    assert np.allclose(tagger.scores(s), np.concatenate(alone), atol=1e-5)
    tapes = []
    tagger.run(tagger.inputs(s), s.lengths, tapes)
    live, firsts, at, gates, *states = tapes[1]
    assert sum(live) == firsts[-1] == len(at) == len(gates) and sorted(at) == list(range(len(s.text_of))) and all(len(x) == len(at) for x in states)
