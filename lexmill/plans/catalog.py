"""The registered queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lexmill.functions import htmltext as H
from lexmill.functions import lexical as L
from lexmill.functions import urls as U
from lexmill.operators import boolq, crawlstate, index, vocab
from lexmill.sources import readers, writers
from lexmill.sources.readers import last_published, nonempty_articles, query_lines, sitemap_urls, table
from lexmill.sources.writers import preview, xml_rows
from lexmill.store import new_path

# Reference instant of the recrawl queries (never the wall clock).
NOW, WEEK = 1765152000, 7 * 86400
BATCH_START = 1764374400
HOT_SOURCE = "apex-herald.example"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def _tokens(s, d, mode="index", position=False):
    return L.kept_tokens(table(s, d, "documents"), "doc_id", "text", mode, position)


def _stems(s, d, **k):
    return index.stems(table(s, d, "documents"), "doc_id", "text", **k)


_indexes: dict = {}


def _index(s, d):
    """``(postings, docs)`` read from a saved index, which is built once per session and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _indexes:
        path = new_path(s, "index")
        index.save(index.postings(_stems(s, d)), index.forward_index(_stems(s, d), table(s, d, "documents").select("doc_id", "source", "url")), path)
        _indexes[key] = path
    return index.load(s, _indexes[key])


TOK = "WITH " + L.sql_tokens("documents", "doc_id", "text", "index")
TOKF = "WITH " + L.sql_tokens("documents", "doc_id", "text", "frequency")
ST = TOK + f", st AS (SELECT doc_id, {L.sql_stem('t')} AS term FROM tok)"
STF = TOKF + f", st AS (SELECT doc_id, {L.sql_stem('t')} AS t FROM tok)"
FR = TOKF + ", fr AS (SELECT t AS token, count(*) AS freq FROM tok GROUP BY t)"
SFR = STF + ", fr AS (SELECT t AS token, count(*) AS freq FROM st GROUP BY t)"
RANK = "row_number() OVER (ORDER BY freq DESC, token ASC)"


def _freq(s, d):
    return vocab.frequencies(_tokens(s, d, "frequency"))


def _stem_freq(s, d):
    return vocab.frequencies(_stems(s, d, mode="frequency"), "term")


# --- documents: sizes and scans


@query("SELECT source, count(*) AS n_docs, sum(coalesce(octet_length(encode(text)), 0))::BIGINT AS text_bytes, round(sum(coalesce(octet_length(encode(text)), 0)) / count(*) / 1024.0, 6) AS mean_kb FROM documents GROUP BY source")
def corpus_size_by_source(s, d):
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return table(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size).alias("text_bytes"), F.round(F.sum(size) / F.count(F.lit(1)) / 1024.0, 6).alias("mean_kb"))


@query("SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents WHERE text IS NOT NULL AND text <> ''")
def nonempty_ordered_scan(s, d):
    return table(s, d, "documents").where("text <> ''").select("doc_id", F.length("text").cast("bigint").alias("n_chars")).orderBy("doc_id")


@query("SELECT id, url, source_name, octet_length(encode(html_content))::BIGINT AS n_bytes FROM articles WHERE html_content <> ''")
def article_scan(s, d):
    return nonempty_articles(table(s, d, "articles")).select("id", "url", "source_name", F.octet_length("html_content").cast("bigint").alias("n_bytes")).orderBy("id")


_CLEAN = r"trim(regexp_replace(text, '[\s\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))"
_STATS = f"t AS (SELECT source, {_CLEAN} AS c FROM documents), u AS (SELECT source, length(c) AS n, len(string_split(c, ' ')) AS w FROM t WHERE c <> '')"


@query(f"WITH {_STATS} SELECT source, count(*) AS articles, sum(n)::BIGINT AS chars, sum(w)::BIGINT AS words, (sum(n) // count(*))::BIGINT AS mean_chars FROM u GROUP BY source")
def article_stats(s, d):
    text = H.normalize_space(F.col("text"))
    rows = table(s, d, "documents").select("source", text.alias("c")).where("c <> ''")
    n, c = F.sum(H.char_count(F.col("c"))).cast("bigint"), F.count(F.lit(1))
    return rows.groupBy("source").agg(c.alias("articles"), n.alias("chars"), F.sum(H.word_count(F.col("c"))).cast("bigint").alias("words"), F.floor(n / c).cast("bigint").alias("mean_chars"))


# --- vocabulary


@query(FR + " SELECT token, freq FROM fr")
def token_frequency(s, d):
    return _freq(s, d)


@query(FR + f" SELECT {RANK} AS rank, token, freq FROM fr")
def token_rank(s, d):
    return vocab.ranked(_freq(s, d))


def _top_sql(fr, k):
    return fr + f" SELECT {RANK} AS rank, token, freq, round(freq * 100.0 / (SELECT sum(freq) FROM fr), 6) AS pct FROM fr ORDER BY freq DESC, token ASC LIMIT {k}"


@query(_top_sql(FR, 50))
def token_top50(s, d):
    return vocab.top(_freq(s, d), 50)


@query(SFR + " SELECT token, freq FROM fr")
def stem_frequency(s, d):
    return _stem_freq(s, d)


@query(_top_sql(SFR, 30))
def stem_top30(s, d):
    return vocab.top(_stem_freq(s, d), 30)


@query(FR + " SELECT sum(freq)::BIGINT AS total_tokens, count(*) AS types, round(count(*) * 100.0 / sum(freq), 6) AS type_token_pct, round(sum(octet_length(encode(token)) * freq) / sum(freq), 6) AS mean_bytes FROM fr")
def vocab_summary(s, d):
    return vocab.summary(_freq(s, d))


@query(TOKF + " SELECT (SELECT count(*) FROM tok) + (SELECT count(*) FROM raw) AS total_asbuilt")
def total_as_built(s, d):
    """Kept plus all tokens: the total of the first tokenizer, which counts kept ones twice."""
    t = table(s, d, "documents").select(F.explode(L.split_tokens(F.col("text"), "frequency")).alias("token"))
    kept = L.in_bounds(F.col("token")) & ~L.is_junk(F.col("token"))
    return t.agg((F.count(F.lit(1)) + F.count(F.when(kept, 1))).alias("total_asbuilt"))


@query(FR + " SELECT freq, count(*) AS n FROM fr WHERE freq <= 30 GROUP BY freq")
def freq_of_freq(s, d):
    return vocab.frequency_of_frequencies(_freq(s, d))


@query(FR + " SELECT count(*) FILTER (WHERE freq = 1) AS hapax, round(count(*) FILTER (WHERE freq = 1) * 100.0 / count(*), 6) AS pct FROM fr")
def hapax(s, d):
    return vocab.hapax(_freq(s, d))


@query(FR + f", r AS (SELECT freq, {RANK} AS rank FROM fr) SELECT round(sum(freq) FILTER (WHERE rank <= 10) * 100.0 / sum(freq), 6) AS top10_pct, round(CASE WHEN count(*) >= 100 THEN sum(freq) FILTER (WHERE rank <= 100) * 100.0 / sum(freq) END, 6) AS top100_pct FROM r")
def coverage_top(s, d):
    return vocab.coverage(_freq(s, d))


_C = ", r AS (SELECT token, freq, {R} AS rank FROM fr), c AS (SELECT sum(freq)::BIGINT AS n, count(*) AS v, round(sum(freq) / sum(1.0::DOUBLE / rank), 4) AS zc FROM r)".replace("{R}", RANK)


@query(FR + _C + " SELECT n AS total_tokens, v AS types, zc AS zipf_c FROM c")
def zipf_constant(s, d):
    return vocab.zipf_constant(_freq(s, d))


@query(SFR + _C + " SELECT n AS total_tokens, v AS types, zc AS zipf_c FROM c")
def zipf_constant_stemmed(s, d):
    return vocab.zipf_constant(_stem_freq(s, d))


_Z = ", z AS (SELECT rank, token, freq, zc / rank AS zf FROM r, c)"


@query(FR + _C + _Z + " SELECT rank, token, freq, round(zf, 6) AS zipf_freq, round((freq - zf) / zf * 100.0, 6) AS deviation_pct, round(ln(rank), 6) AS log_rank, round(ln(freq), 6) AS log_freq, round(ln(zf), 6) AS log_zipf FROM z WHERE rank <= 50")
def zipf_table(s, d):
    return vocab.zipf_table(_freq(s, d))


def _fit_sql(fr, k, bounds, names):
    arms = " ".join(f"WHEN m < {b} THEN '{w}'" for b, w in zip(bounds, names))
    return fr + _C + _Z + f", a AS (SELECT round(avg(abs(round((freq - zf) / zf * 100.0, 6))), 4) AS m FROM z WHERE rank <= {k}) SELECT {k}::BIGINT AS k, m AS mean_abs_dev, CASE {arms} ELSE '{names[-1]}' END AS verdict FROM a"


FIT50 = (50, (20.0, 40.0, 60.0), ("excellent", "good", "fair", "poor"))
FIT30 = (30, (30.0, 50.0), ("good", "fair", "poor"))


@query(_fit_sql(FR, *FIT30))
def zipf_fit30(s, d):
    return vocab.zipf_fit(_freq(s, d), *FIT30)


@query(_fit_sql(SFR, *FIT50))
def zipf_fit50_stemmed(s, d):
    return vocab.zipf_fit(_stem_freq(s, d), *FIT50)


@query(STF + ", n AS (SELECT (SELECT count(DISTINCT t) FROM tok) AS a, (SELECT count(DISTINCT t) FROM st) AS b) SELECT a AS raw_types, b AS stems, a - b AS reduction, round((a - b) * 100.0 / a, 6) AS reduction_pct FROM n")
def stem_reduction(s, d):
    """Stems are taken of the distinct tokens: one shuffle of types, not of occurrences."""
    types = _tokens(s, d, "frequency").select("token").distinct()
    per = types.groupBy(L.stem(F.col("token")).alias("stem")).agg(F.count(F.lit(1)).alias("n"))
    a, b = F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))
    return per.agg(a.alias("raw_types"), b.alias("stems"), (a - b).alias("reduction"), F.round((a - b) * 100.0 / a, 6).alias("reduction_pct"))


@query(TOKF + " SELECT t AS token, count(*) AS n FROM raw WHERE octet_length(encode(t)) >= 50 OR t IN (" + ", ".join(map(L._q, L.JUNK)) + ") OR starts_with(t,'http') OR starts_with(t,'www') OR (octet_length(encode(t)) = 1 AND NOT (t >= 'a' AND t <= 'z')) GROUP BY t")
def junk_tokens(s, d):
    t = table(s, d, "documents").select(F.explode(L.split_tokens(F.col("text"), "frequency")).alias("token"))
    return t.where(~L.in_bounds(F.col("token")) | L.is_junk(F.col("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, pos, " + L.sql_stem("t") + " AS stem FROM (SELECT doc_id, unnest(a) AS t, unnest(range(len(a)))::INTEGER AS pos FROM (SELECT doc_id, regexp_extract_all(translate(text, '{U}', '{L}'), {P}) AS a FROM documents)) WHERE octet_length(encode(t)) < 50 AND t NOT IN ({J}) AND NOT starts_with(t,'http') AND NOT starts_with(t,'www') AND NOT (octet_length(encode(t)) = 1 AND NOT (t >= 'a' AND t <= 'z'))".replace("{U}", L.UPPER).replace("{L}", L.LOWER).replace("{P}", L._q(L.INDEX_PATTERN)).replace("{J}", ", ".join(map(L._q, L.JUNK))))
def token_stream(s, d):
    return _stems(s, d, position=True).select("doc_id", F.col("pos").cast("int").alias("pos"), F.col("term").alias("stem"))


_DEMO = "гонщики гонщиков гонщикам команда команды командами чемпионат чемпионата чемпионате побед победа победы победами этап этапа этапов этапами машина машины машинами racing races raced driver drivers driving red used seeds она ну".split()


@query("SELECT w AS word, " + L.sql_stem("w") + " AS index_stem, " + L.sql_stem("w", L.QUERY_SUFFIXES) + " AS query_stem FROM (VALUES " + ", ".join(f"('{w}')" for w in _DEMO) + ") v(w)")
def stem_demo(s, d):
    w = F.col("word")
    return s.createDataFrame([(x,) for x in _DEMO], "word string").select("word", L.stem(w).alias("index_stem"), L.stem(w, L.QUERY_SUFFIXES).alias("query_stem"))


# --- index


# Ids of one segment of a term's list; small, so that the test tables cut lists too.
SEGMENT = 500


@query(ST + f" SELECT term, doc_id // {SEGMENT} AS segment, count(DISTINCT doc_id) AS df, array_to_string(list_sort(list(DISTINCT doc_id)), ' ') AS postings FROM st GROUP BY ALL")
def inverted_index(s, d):
    """A term's list in segments by id, so that no task holds the whole list of a term in every document."""
    lists = index.posting_segments(index.postings(_stems(s, d)), SEGMENT)
    return lists.select("term", "segment", "df", F.array_join(F.transform("postings", lambda x: x.cast("string")), " ").alias("postings"))


@query(ST + " SELECT term, count(DISTINCT doc_id) AS df FROM st GROUP BY term")
def document_frequency(s, d):
    return index.document_frequency(_index(s, d)[0])


@query(ST + " SELECT d.doc_id, d.source, d.url, c.n AS term_count, c.terms FROM documents d JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT term) AS terms FROM st GROUP BY doc_id) c USING (doc_id)")
def index_round_trip(s, d):
    """The saved index read back: documents and how many postings each has."""
    post, docs = _index(s, d)
    return docs.join(post.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms")), "doc_id").select("doc_id", "source", "url", "term_count", "terms")


@query(ST + " SELECT DISTINCT term, doc_id FROM st")
def posting_rows(s, d):
    return index.postings(_stems(s, d))


@query(ST + " SELECT d.doc_id, d.source, d.url, c.n AS term_count FROM documents d JOIN (SELECT doc_id, count(*) AS n FROM st GROUP BY doc_id) c USING (doc_id)")
def forward_index(s, d):
    return index.forward_index(_stems(s, d), table(s, d, "documents").select("doc_id", "source", "url"))


@query(ST + " SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT term) AS terms, count(*) AS occurrences, round(avg(octet_length(encode(term))), 6) AS mean_bytes FROM st")
def index_stats(s, d):
    return index.index_stats(_stems(s, d))


@query(ST + " SELECT DISTINCT doc_id FROM st WHERE term = '" + L.stem_word("пилот") + "'")
def term_lookup(s, d):
    return _index(s, d)[0].where(F.col("term") == L.stem_word("пилот")).select("doc_id")


# --- boolean queries

SAMPLES = {
    "bool_and": "пилот && штраф",
    "bool_or": "резина || tyres",
    "bool_not": "!команда",
    "bool_and_not": "podium !rain",
    "bool_group": "мотора && (режим || масла)",
    "bool_implicit_and": "stewards penalty",
    "bool_missing_term": "зюзюка",
    "bool_double_neg": "!!погоды",
    "bool_nested": "(дождь || ветер) && !финиш",
    "bool_stray_paren": "трасса ) старт",
    "bool_leading_and": "&& план",
    "bool_index_stemmer": "drivers || driver",
}


def _search(text, **k):
    def run(s, d):
        post, docs = _index(s, d)
        return boolq.search(post, docs, text, **k)

    return run


for _name, _text in SAMPLES.items():
    _k = {"stemmer": "index"} if _name == "bool_index_stemmer" else {}
    QUERIES[_name] = _search(_text, **_k)
    SQL[_name] = ST + f" SELECT doc_id FROM st GROUP BY doc_id HAVING {boolq.sql_search(_text, **_k)}"


@query(ST + f" SELECT doc_id FROM st GROUP BY doc_id HAVING {boolq.sql_search(SAMPLES['bool_nested'])}")
def bool_scan(s, d):
    """Search without an index: flags of the query's words over one scan of the texts."""
    return boolq.search(_stems(s, d), None, SAMPLES["bool_nested"])


@query()
def bool_batch(s, d):
    return boolq.batch_report(s, *_index(s, d), query_lines(table(s, d, "query_batch")))


def _batch_sql(folder: str) -> str | None:
    """Set-based SQL for the typed queries of the (fixed) batch table."""
    path = f"{folder}/query_batch.parquet"
    if not os.path.exists(path):
        return None
    import pyarrow.parquet as pq

    live = boolq.numbered(pq.read_table(path).column("line").to_pylist())
    arms = " UNION ALL ".join(f"SELECT {i} AS query_no, doc_id FROM st GROUP BY doc_id HAVING {boolq.sql_search(q)}" for i, q in enumerate(live, 1))
    names = ", ".join(f"({i}, {L._q(q)})" for i, q in enumerate(live, 1))
    return ST + f", h AS ({arms}), r AS (SELECT query_no, doc_id, row_number() OVER (PARTITION BY query_no ORDER BY doc_id) AS k FROM h) SELECT n.query_no::INTEGER AS query_no, n.query, count(r.doc_id) AS found, coalesce(string_agg(r.doc_id::VARCHAR, ' ' ORDER BY r.doc_id) FILTER (WHERE k <= 100), '') AS ids FROM (VALUES {names}) n(query_no, query) LEFT JOIN r ON r.query_no = n.query_no GROUP BY ALL"


@query(ST + f", h AS (SELECT doc_id FROM st GROUP BY doc_id HAVING {boolq.sql_search('пилот && штраф')}) SELECT row_number() OVER (ORDER BY h.doc_id) AS hit_no, h.doc_id, d.url, (SELECT greatest(count(*) - 50, 0) FROM h) AS remaining FROM (SELECT doc_id FROM h ORDER BY doc_id LIMIT 50) h JOIN documents d USING (doc_id)")
def bool_top50_display(s, d):
    post, docs = _index(s, d)
    return boolq.display(boolq.search(post, docs, "пилот && штраф"), docs.select("doc_id", "url"))


# --- pages

_DROP = "regexp_replace(html_content, '<!--.*?-->', '', 'gs')"
for _n in H.GENERIC_DROP:
    _DROP = f"regexp_replace({_DROP}, '<{_n}\\b[^>]*>.*?</{_n}\\s*>', '', 'gis')"
_DROP_R = "regexp_replace(html_content, '<!--.*?-->', '', 'gs')"
for _n in H.REPORT_DROP:
    _DROP_R = f"regexp_replace({_DROP_R}, '<{_n}\\b[^>]*>.*?</{_n}\\s*>', '', 'gis')"


_REF = L._q(H.REFERENCE)
_NAMES, _CHARS = (f"[{', '.join(map(L._q, x))}]" for x in zip(*((f"&{k};", v) for k, v in H.NAMED.items())))


def _sql_decode(t: str) -> str:
    """Character references of an SQL expression decoded once, '&amp;' last."""
    code = "(CASE WHEN regexp_matches(r, '^&#[xX]') THEN list_reduce(list_prepend(0, list_transform(string_split(substr(r, 4, length(r) - 4), ''), lambda c: strpos('0123456789abcdef', lower(c)) - 1)), lambda x, y: x * 16 + y) WHEN starts_with(r, '&#') THEN CAST(substr(r, 3, length(r) - 3) AS BIGINT) END)"
    of_bytes = " ".join(f"WHEN {k} THEN {L._q(v)}" for k, v in H.BYTES.items())
    one = f"CASE WHEN {code} IS NULL THEN coalesce({_CHARS}[list_position({_NAMES}, r)], r) WHEN {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343 THEN '\ufffd' ELSE CASE {code} {of_bytes} ELSE chr({code}::INTEGER) END END"
    refs = f"list_filter(list_distinct(regexp_extract_all({t}, {_REF})), lambda r: r <> '&amp;')"
    return f"(CASE WHEN contains({t}, '&') THEN replace(list_reduce(list_prepend({t}, {refs}), lambda a, r: replace(a, r, {one})), '&amp;', '&') ELSE {t} END)"


def _sql_text(found: str) -> str:
    t = _sql_decode(f"regexp_replace({found}, '<[^>]*>', chr(10), 'gs')")
    return _CLEAN.replace("regexp_replace(text,", f"regexp_replace({t},")


def _sql_cut(name: str, source: str, html: str, selectors, keep: str = "text") -> str:
    """CTEs that end in ``name(id, tag, box)``: inside of the first selector's element in ``source(id, <html>)``."""
    tag = "coalesce(" + ", ".join(f"nullif(regexp_extract({html}, {L._q(H.opening(x))}, 0), '')" for x in selectors) + ", '')"
    kept = "CASE WHEN list_position(depths, 0) > 0 THEN parts[1:greatest(list_position(depths, 0) - 1, 1)] ELSE parts END"
    if keep == "source":
        kept = f"list_transform({kept}, lambda p, i: p || CASE WHEN i < len({kept}) THEN coalesce(tags[i], '') ELSE '' END)"
    elif keep == "own":
        kept = f"list_filter(list_transform({kept}, lambda p, i: CASE WHEN depths[i] = 1 THEN p END), lambda p: p IS NOT NULL)"
    return (
        f"{name}_t AS (SELECT id, {html} AS h, {tag} AS tag FROM {source}), "
        f"{name}_r AS (SELECT id, tag, substr(h, strpos(h, tag) + length(tag)) AS rest, '(?is)</?' || lower(regexp_extract(tag, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) || '(?:\\s[^>]*)?>' AS same FROM {name}_t), "
        f"{name}_s AS (SELECT id, tag, string_split_regex(rest, same) AS parts, regexp_extract_all(rest, same) AS tags, list_transform(regexp_extract_all(rest, same), lambda x: CASE WHEN starts_with(x, '</') THEN -1 WHEN ends_with(x, '/>') THEN 0 ELSE 1 END) AS steps FROM {name}_r), "
        f"{name}_d AS (SELECT id, tag, tags, parts, list_transform(range(1, len(parts) + 1), lambda i: 1 + coalesce(list_sum(steps[1:i - 1]), 0)) AS depths FROM {name}_s), "
        f"{name} AS (SELECT id, tag, CASE WHEN tag = '' THEN '' ELSE array_to_string({kept}, {"''" if keep == "source" else "chr(10)"}) END AS box FROM {name}_d)"
    )


_GENERIC = f"k AS (SELECT id, {_DROP} AS k FROM articles), " + _sql_cut("g", "k", "k", H.GENERIC_BOXES)
_REPORT = "regexp_extract(k, '<body\\b[^>]*>(.*?)</body\\s*>', 1, 'is')"


@query(f"WITH {_GENERIC} SELECT id, {_sql_text('box')} AS text FROM g")
def page_clean_text(s, d):
    return table(s, d, "articles").select("id", H.page_text(F.col("html_content"), F.col("url")).alias("text"))


@query(f"WITH {_GENERIC}, t AS (SELECT id, {_sql_text('box')} AS text FROM g) SELECT id, length(text)::BIGINT AS char_count, len(string_split(text, ' '))::BIGINT AS word_count FROM t WHERE text <> ''")
def page_text_stats(s, d):
    t = page_clean_text(s, d).where("text <> ''")
    return t.select("id", H.char_count(F.col("text")).cast("bigint").alias("char_count"), H.word_count(F.col("text")).cast("bigint").alias("word_count"))


@query(f"WITH k AS (SELECT source_name, html_content, {_DROP_R} AS k FROM articles), t AS (SELECT source_name, octet_length(encode(html_content)) AS r, octet_length(encode({_sql_text(_REPORT)})) AS x FROM k) SELECT source_name, count(*) AS n_docs, sum(r)::BIGINT AS raw_bytes, sum(x)::BIGINT AS text_bytes, round(sum(x) / count(*) / 1024.0, 6) AS mean_text_kb FROM t GROUP BY source_name")
def page_size_report(s, d):
    t = table(s, d, "articles").select("source_name", F.octet_length("html_content").cast("bigint").alias("r"), F.octet_length(H.report_text(F.col("html_content"))).cast("bigint").alias("x"))
    return t.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("r").alias("raw_bytes"), F.sum("x").alias("text_bytes"), F.round(F.sum("x") / F.count(F.lit(1)) / 1024.0, 6).alias("mean_text_kb"))


def _sql_strings(html: str, joint: str) -> str:
    """Stripped strings between tags of an SQL expression, joined."""
    clean = _CLEAN.replace("regexp_replace(text,", f"regexp_replace({_sql_decode('s')},")
    return f"array_to_string(list_filter(list_transform(string_split_regex({html}, '(?s)<[^>]*>'), lambda s: {clean}), lambda s: s <> ''), {L._q(joint)})"


def _sql_drop(html: str, names) -> str:
    out = f"regexp_replace({html}, '<!--.*?-->', '', 'gs')"
    for n in names:
        out = f"regexp_replace({out}, '<{n}\\b[^>]*>.*?</{n}\\s*>', '', 'gis')"
    return out


_BARE = "c AS (SELECT id, regexp_replace(html_content, '<!--.*?-->', '', 'gs') AS h FROM articles), "


@query(f"WITH {_BARE}{_sql_cut('a', 'c', 'h', H.SITE_A_BOXES, 'own')}, q AS (SELECT id, regexp_extract_all({_sql_drop('box', H.SITE_A_DROP)}, '(?is)<p(?:\\s[^>]*)?>(.*?)</p\\s*>', 1) AS ps FROM a) SELECT id, array_to_string(list_filter(list_transform(ps, lambda x: {_sql_strings('x', '')}), lambda x: x <> ''), ' ') AS text FROM q")
def page_site_a_text(s, d):
    """Layout A on every page (crawls pick it by host)."""
    return table(s, d, "articles").select("id", H.site_a_text(F.col("html_content")).alias("text"))


@query(f"WITH {_BARE}{_sql_cut('b', 'c', 'h', H.SITE_B_BOX, 'source')}, n AS (SELECT id, {_sql_drop('box', ('h1',))} AS h FROM b), {_sql_cut('t', 'n', 'h', H.SITE_B_TEXT, 'own')}, w AS (SELECT id, '<div>' || h AS h FROM n), {_sql_cut('o', 'w', 'h', ('div',), 'own')}, z AS (SELECT id, CASE WHEN t.tag = '' THEN o.box ELSE t.box END AS box FROM o JOIN t USING (id)) SELECT id, {_sql_strings('box', ' ')} AS text FROM z")
def page_site_b_text(s, d):
    """Layout B on every page."""
    return table(s, d, "articles").select("id", H.site_b_text(F.col("html_content")).alias("text"))


@query("SELECT id, md5(html_content) AS content_hash FROM articles")
def page_content_hash(s, d):
    return table(s, d, "articles").select("id", crawlstate.content_hash(F.col("html_content")).alias("content_hash"))


@query("SELECT DISTINCT id, h AS href FROM (SELECT id, unnest(regexp_extract_all(html_content, '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1, 'i')) AS h FROM articles)")
def page_link_extract(s, d):
    return table(s, d, "articles").select("id", F.explode(H.links(F.col("html_content"))).alias("href")).distinct()


def _sql_absolute(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
    whole = f"regexp_replace({base}, '#.*$', '')"
    page = f"regexp_replace({whole}, '\\?.*$', '')"
    folder = f"coalesce(nullif(regexp_replace(substr({page}, length({origin}) + 1), '[^/]*$', ''), ''), '/')"
    path, rest = f"regexp_extract({href}, '^([^?#]*)', 1)", f"regexp_extract({href}, '^[^?#]*(.*)$', 1)"

    def dots(p: str) -> str:
        done = f"list_reduce(list_prepend('', string_split(substr({p}, 2), '/')), lambda a, x: CASE WHEN x = '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN x = '.' THEN a ELSE a || '/' || x END)"
        return f"(CASE WHEN regexp_matches({p}, '/\\.\\.?$') THEN {done} || '/' ELSE coalesce(nullif({done}, ''), '/') END)"

    return (
        f"CASE WHEN {href} = '' THEN {base} WHEN regexp_matches({href}, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '#') THEN {whole} || {href} WHEN starts_with({href}, '?') THEN {page} || {href} "
        f"WHEN starts_with({href}, '//') THEN regexp_extract({base}, '^([^/]*)', 1) || {href} WHEN starts_with({href}, '/') THEN {origin} || {dots(path)} || {rest} ELSE {origin} || {dots(f'({folder} || {path})')} || {rest} END"
    )


@query(f"SELECT DISTINCT id, {_sql_absolute('url', 'h')} AS link FROM (SELECT id, url, unnest(regexp_extract_all(html_content, '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1, 'i')) AS h FROM articles)")
def page_links_absolute(s, d):
    rows = table(s, d, "articles").select("id", "url", F.explode(H.links(F.col("html_content"))).alias("h"))
    return rows.select("id", U.absolute(F.col("url"), F.col("h")).alias("link")).distinct()


_TAGS = "unnest(regexp_extract_all(regexp_replace(html_content, '<!--.*?-->', '', 'gs'), '</?(?:div|article|li)(?:\\s[^>]*)?>|<a\\s[^>]*>', 0, 'i')) AS t"
# What the test sites' story links hold.
STORY_MARK = "/s/"
_DAY = "nullif(coalesce(nullif(regexp_extract(url, 'news/(\\d{4}/\\d{2}/\\d{2})/', 1), ''), ''), '')"


@query(
    f"""WITH g AS (SELECT id, url, {_TAGS}, generate_subscripts(regexp_extract_all(regexp_replace(html_content, '<!--.*?-->', '', 'gs'), '</?(?:div|article|li)(?:\\s[^>]*)?>|<a\\s[^>]*>', 0, 'i'), 1) AS k FROM (SELECT id, url, replace(html_content, '<div class="c', '<div class="item c') AS html_content FROM articles)),
    n AS (SELECT *, lower(regexp_extract(t, '^</?([a-zA-Z]+)', 1)) AS name, CASE WHEN starts_with(t, '</') THEN -1 WHEN ends_with(t, '/>') THEN 0 ELSE 1 END AS step FROM g),
    p AS (SELECT *, sum(step) OVER (PARTITION BY id, name ORDER BY k) AS depth FROM n WHERE name <> 'a'),
    i AS (SELECT id, name, k, depth, coalesce((SELECT min(c.k) FROM p c WHERE c.id = o.id AND c.name = o.name AND c.k > o.k AND c.depth < o.depth), 1000000000) AS till FROM p o WHERE step = 1 AND regexp_matches(t, {L._q(H.ITEM_CLASS)})),
    l AS (SELECT id, url, k, regexp_extract(t, {L._q(H.HREF)}, 1) AS h FROM n WHERE name = 'a')
    SELECT DISTINCT id, {_sql_absolute('url', 'h')} AS link FROM l WHERE contains(h, '{STORY_MARK}') AND (coalesce(contains(h, {_DAY}), FALSE) OR EXISTS (SELECT 1 FROM i WHERE i.id = l.id AND i.k < l.k AND l.k < i.till))"""
)
def page_listing_links(s, d):
    """Story links of every page as a listing of its address's day: by date, and inside items.

    The test sites' listings have no links, so boxes of hashed class are made items.
    """
    day = F.nullif(U.publication_date(F.col("url")), F.lit(U.UNKNOWN))
    html = F.replace(F.col("html_content"), F.lit('<div class="c'), F.lit('<div class="item c'))
    rows = table(s, d, "articles").select("id", "url", F.explode(H.listing_links(html, day, STORY_MARK)).alias("h"))
    return rows.select("id", U.absolute(F.col("url"), F.col("h")).alias("link")).distinct()


_PATH = "coalesce(nullif(trim(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/'), ''), 'article_' || id)"
_FLAT = f"regexp_replace(replace({_PATH}, '/', '_') || CASE WHEN ends_with(replace({_PATH}, '/', '_'), '.html') THEN '' ELSE '.html' END, '[<>:\"|?*\\\\]', '_', 'g')"
_LAST = "CASE WHEN ends_with(url, '/') THEN 'article_' || id || '.html' ELSE list_last(string_split(url, '/')) END"


@query(f"SELECT id, {_FLAT} AS flat, CASE WHEN length({_FLAT}) > 100 THEN substr({_FLAT}, 1, 95) || '.html' ELSE {_FLAT} END AS capped, {_LAST} AS last_segment FROM articles")
def page_filename(s, d):
    u = F.col("url")
    return table(s, d, "articles").select("id", U.file_name_flat(u, F.col("id")).alias("flat"), U.file_name_capped(u, F.col("id")).alias("capped"), U.file_name_last(u, F.col("id")).alias("last_segment"))


@query("SELECT id, coalesce(nullif(regexp_extract(url, 'news/(\\d{4}/\\d{2}/\\d{2})/', 1), ''), 'unknown') AS published FROM articles")
def url_pub_date(s, d):
    return table(s, d, "articles").select("id", U.publication_date(F.col("url")).alias("published"))


_FORMS = {"yyyy/MM/dd": "%Y/%m/%d", "yyyy-MM-dd": "%Y-%m-%d", "yyyy.MM.dd": "%Y.%m.%d", "dd/MM/yyyy": "%d/%m/%Y", "dd.MM.yyyy": "%d.%m.%Y"}


@query("SELECT DISTINCT date_published, strftime(p, '%Y-%m-%d') AS parsed, strftime(p - INTERVAL 1 DAY, '%Y-%m-%d') AS day_before FROM (SELECT date_published, coalesce(" + ", ".join(f"try_strptime(date_published, '{f}')" for f in _FORMS.values()) + ") AS p FROM crawl_metadata)")
def date_parse_multi(s, d):
    p = U.parse_date(F.col("date_published"))
    return table(s, d, "crawl_metadata").select("date_published", F.date_format(p, "yyyy-MM-dd").alias("parsed"), F.date_format(U.day_before(p), "yyyy-MM-dd").alias("day_before")).distinct()


@query("SELECT date_published FROM crawl_metadata ORDER BY id DESC, coalesce(date_downloaded, '') DESC, coalesce(date_published, '') DESC LIMIT 1")
def last_processed_date(s, d):
    return last_published(table(s, d, "crawl_metadata"))


@query("SELECT url FROM articles WHERE starts_with(url, 'http')")
def sitemap_links(s, d):
    """The sitemap reader over lines made of the articles' addresses."""
    lines = table(s, d, "articles").select(F.explode(F.array(F.concat(F.lit(" <loc>"), "url", F.lit("</loc>\r")), F.lit("<url>"), F.lit("<loc>ftp://x</loc>"))).alias("value"))
    return sitemap_urls(lines)


@query("SELECT doc_id, replace(replace(substr(text, 1, 100), chr(10), ' '), '  ', ' ') AS preview FROM documents")
def text_preview(s, d):
    return table(s, d, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query(f"WITH t AS (SELECT doc_id, source, url, {_CLEAN} AS text FROM documents) SELECT doc_id AS id, source, url, '<![CDATA[' || chr(10) || text || chr(10) || ']]>' AS content, length(text)::BIGINT AS character_count, len(string_split(text, ' '))::BIGINT AS word_count FROM t WHERE text <> ''")
def article_xml_rows(s, d):
    clean = table(s, d, "documents").select("doc_id", "source", "url", H.normalize_space(F.col("text")).alias("text"))
    return xml_rows(clean).select(F.col("_id").alias("id"), F.col("_source").alias("source"), "url", "content", "statistics.character_count", "statistics.word_count")


@query(f"WITH t AS (SELECT doc_id, source, url, {_CLEAN} AS text FROM documents) SELECT doc_id, source, url, md5(text) AS text_md5, length(text)::BIGINT AS character_count, len(string_split(text, ' '))::BIGINT AS word_count FROM t WHERE text <> ''")
def xml_round_trip(s, d):
    """All documents written as article XML and read again."""
    path = new_path(s, "xml")
    writers.articles_xml(table(s, d, "documents").select("doc_id", "source", "url", H.normalize_space(F.col("text")).alias("text")), path)
    return readers.articles_xml(s, path).select("doc_id", "source", "url", F.md5("content").alias("text_md5"), "statistics.character_count", "statistics.word_count")


@query("SELECT id, url, filename, date_downloaded, date_published, count(*) AS n FROM crawl_metadata GROUP BY ALL")
def metadata_round_trip(s, d):
    """The crawl's metadata appended to CSV and read again; repeated rows are counted."""
    path = new_path(s, "metadata")
    meta = table(s, d, "crawl_metadata")
    writers.metadata_csv(meta, path)
    return readers.metadata_csv(s, path).groupBy(*meta.columns).agg(F.count(F.lit(1)).alias("n"))


@query(TOK + " SELECT doc_id, t AS token, count(*) AS n FROM tok GROUP BY ALL")
def tokens_round_trip(s, d):
    """All tokens written as CSV and read again."""
    path = new_path(s, "tokens")
    writers.token_rows(_tokens(s, d).select("doc_id", "token"), path)
    return readers.tokens_csv(s, path).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query(FR + " SELECT token FROM fr")
def vocabulary_round_trip(s, d):
    """The token list written as text and read again."""
    path = new_path(s, "vocabulary")
    writers.token_list(_freq(s, d), path)
    return s.read.text(path).select(F.col("value").alias("token"))


@query("SELECT DISTINCT filename, source_name, md5(html_content) AS h FROM articles WHERE filename IS NOT NULL")
def pages_round_trip(s, d):
    """Named pages landed in a store partitioned by source, twice; the second landing adds none."""
    path = new_path(s, "pages")
    named = table(s, d, "articles").where("filename IS NOT NULL").select("filename", "source_name", F.md5("html_content").alias("h")).distinct()
    writers.pages_parquet(named, path)
    writers.pages_parquet(named, path, readers.landed_pages(s, path))
    return readers.landed_pages(s, path).select("filename", "source_name", "h")


# --- crawl state

_LATEST = "lh AS (SELECT url, content_hash, last_checked FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY coalesce(last_checked, -4611686018427387904) DESC, coalesce(content_hash, '') DESC) AS k FROM article_hashes) WHERE k = 1)"


@query(f"WITH {_LATEST} SELECT * FROM lh")
def latest_hashes(s, d):
    return crawlstate.latest_hashes(table(s, d, "article_hashes"))


@query(f"WITH {_LATEST} SELECT a.url FROM articles a LEFT JOIN lh USING (url) WHERE source_name = '{HOT_SOURCE}' AND (last_checked IS NULL OR last_checked < {NOW - 4 * WEEK}) ORDER BY url LIMIT 100")
def recrawl_due(s, d):
    return crawlstate.recrawl_due(table(s, d, "articles"), table(s, d, "article_hashes"), HOT_SOURCE, NOW, 4 * WEEK, 100)


@query(f"WITH {_LATEST}, kn AS (SELECT DISTINCT url FROM crawl_metadata) SELECT a.url, CASE WHEN kn.url IS NULL THEN 'new' WHEN content_hash IS NOT NULL AND lower(content_hash) <> md5(html_content) THEN 'changed' ELSE 'unchanged' END AS status FROM articles a LEFT JOIN kn USING (url) LEFT JOIN lh USING (url)")
def change_detection(s, d):
    """All pages against the addresses that crawls have named before."""
    return crawlstate.change_status(table(s, d, "articles"), table(s, d, "crawl_metadata"), table(s, d, "article_hashes"))


_OLD = f"o AS (SELECT * FROM articles WHERE crawl_timestamp < {BATCH_START}), n AS (SELECT id, url, html_content || '<!-- v2 -->' AS html_content, source_name, crawl_timestamp + 86400 AS crawl_timestamp, crawl_date, filename, article_number FROM articles WHERE url IN (SELECT url FROM crawl_metadata))"


@query(f"WITH {_OLD} SELECT coalesce(o.id, n.id) AS id, coalesce(o.url, n.url) AS url, md5(coalesce(n.html_content, o.html_content)) AS content_hash, CASE WHEN o.url IS NULL THEN n.source_name ELSE o.source_name END AS source_name, coalesce(n.crawl_timestamp, o.crawl_timestamp) AS crawl_timestamp, CASE WHEN o.url IS NULL THEN n.filename ELSE o.filename END AS filename FROM o FULL JOIN n ON o.url = n.url")
def upsert_articles(s, d):
    a = table(s, d, "articles")
    old = a.where(F.col("crawl_timestamp") < BATCH_START)
    new = a.join(table(s, d, "crawl_metadata").select("url"), "url", "left_semi").select(*a.columns).withColumn("html_content", F.concat("html_content", F.lit("<!-- v2 -->"))).withColumn("crawl_timestamp", F.col("crawl_timestamp") + 86400)
    return crawlstate.upsert_articles(old, new).select("id", "url", crawlstate.content_hash(F.col("html_content")).alias("content_hash"), "source_name", "crawl_timestamp", "filename")


@query(f"WITH {_LATEST}, n AS (SELECT url, md5(html_content) AS h FROM articles WHERE crawl_timestamp >= {BATCH_START}) SELECT coalesce(lh.url, n.url) AS url, coalesce(n.h, lh.content_hash) AS content_hash, CASE WHEN n.url IS NOT NULL THEN {NOW} ELSE lh.last_checked END AS last_checked FROM lh FULL JOIN n ON lh.url = n.url")
def upsert_hashes(s, d):
    new = table(s, d, "articles").where(F.col("crawl_timestamp") >= BATCH_START).select("url", crawlstate.content_hash(F.col("html_content")).alias("content_hash"), F.lit(NOW).cast("bigint").alias("last_checked"))
    return crawlstate.upsert_hashes(table(s, d, "article_hashes"), new)


_COUNTS = f"c AS (SELECT source_name, count(*)::INTEGER AS articles_count, max(url) AS position FROM articles WHERE source_name IS NOT NULL GROUP BY source_name)"


@query(f"WITH {_COUNTS} SELECT coalesce(p.source_name, c.source_name) AS source_name, CASE WHEN c.source_name IS NULL THEN p.position ELSE c.position END AS position, CASE WHEN c.source_name IS NULL THEN p.articles_count ELSE c.articles_count END AS articles_count, CASE WHEN c.source_name IS NULL THEN p.last_update ELSE {NOW} END AS last_update FROM parser_state p FULL JOIN c ON p.source_name = c.source_name")
def upsert_parser_state(s, d):
    g = table(s, d, "articles").where("source_name IS NOT NULL").groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.max("url").alias("position"))
    new = g.select("source_name", "position", F.col("n").cast("int").alias("articles_count"), F.lit(NOW).cast("bigint").alias("last_update"))
    return crawlstate.upsert_state(table(s, d, "parser_state"), new)


@query("SELECT url FROM articles WHERE id > coalesce((SELECT min(a.id) FROM articles a JOIN parser_state p ON a.url = p.position), -1)")
def resume_from_checkpoint(s, d):
    """Pages by id after the first one that a stored position names; all where none does."""
    a = table(s, d, "articles")
    named = a.join(table(s, d, "parser_state").select(F.col("position").alias("url")), "url", "left_semi")
    at = named.orderBy("id").select("url").first()
    return crawlstate.resume_after(a.select("url", F.col("id").alias("pos")), at["url"] if at else None).select("url")


@query("SELECT strftime(d, '%Y/%m/%d') AS day FROM (SELECT unnest(generate_series(DATE '2025-09-20', DATE '2025-12-01', INTERVAL 1 DAY)) AS d)")
def resume_day_list(s, d):
    return crawlstate.resume_days(s, "2025/12/01", "2025/09/20").select(F.date_format("day", "yyyy/MM/dd").alias("day"))


_DAYS = "SELECT d::DATE AS day, count(a.id) AS n FROM (SELECT unnest(generate_series((SELECT min(to_timestamp(crawl_timestamp)::DATE) FROM articles), (SELECT max(to_timestamp(crawl_timestamp)::DATE) FROM articles), INTERVAL 1 DAY)) AS d) c LEFT JOIN articles a ON to_timestamp(a.crawl_timestamp)::DATE = d AND a.source_name = '{HOT_SOURCE}' GROUP BY d".replace("{HOT_SOURCE}", HOT_SOURCE)


@query(
    f"""WITH c AS ({_DAYS}), k AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS k FROM c),
    f AS (SELECT *, k - 1 - coalesce((SELECT max(p.k) FROM k p WHERE p.k < o.k AND p.n > 0), 0) AS run, coalesce((SELECT sum(p.n) FROM k p WHERE p.k < o.k), 0) AS s FROM k o)
    SELECT strftime(day, '%Y/%m/%d') AS day, n FROM f o WHERE s < 50 AND NOT EXISTS (SELECT 1 FROM f p WHERE p.k <= o.k AND p.run >= 3)"""
)
def crawl_days(s, d):
    """Days of one source, newest first, until 3 empty ones in a row or 50 pages."""
    pages = table(s, d, "articles").select(F.to_date(F.timestamp_seconds("crawl_timestamp")).alias("day"), "source_name")
    ends = pages.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    counts = calendar.join(pages.where(F.col("source_name") == HOT_SOURCE).groupBy("day").agg(F.count(F.lit(1)).alias("_n")), "day", "left")
    days = crawlstate.days_until(counts.select("day", F.coalesce("_n", F.lit(0)).alias("n")), 3, 50)
    return days.select(F.date_format("day", "yyyy/MM/dd").alias("day"), "n")


@query("SELECT source_name, count(*) AS n FROM articles GROUP BY source_name")
def articles_by_source(s, d):
    return table(s, d, "articles").groupBy("source_name").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH j AS (SELECT a.html_content, k.url IS NOT NULL AS known FROM articles a LEFT JOIN (SELECT DISTINCT url FROM article_hashes) k USING (url) WHERE crawl_timestamp >= {BATCH_START}), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE NOT known AND html_content <> '') AS saved, count(*) FILTER (WHERE known) AS skipped FROM j) SELECT n AS processed, saved, skipped, round(saved * 100.0 / n, 6) AS success_pct FROM c")
def crawl_summary(s, d):
    """Counters of the new pages against the store's addresses."""
    return crawlstate.crawl_summary(table(s, d, "articles").where(F.col("crawl_timestamp") >= BATCH_START), table(s, d, "article_hashes"))


@query("SELECT id, article_number FROM articles WHERE article_number % 50 = 0 AND article_number > 0")
def recrawl_points(s, d):
    """Pages after which a crawl of their source checks old ones again."""
    return crawlstate.recrawl_points(table(s, d, "articles"), "article_number").select("id", "article_number")


@query(f"SELECT count(*) AS n FROM articles WHERE source_name = '{HOT_SOURCE}'")
def stored_count(s, d):
    return crawlstate.stored_count(table(s, d, "articles"), HOT_SOURCE)


@query("SELECT m.id, m.url FROM (SELECT DISTINCT id, url FROM crawl_metadata) m WHERE NOT EXISTS (SELECT 1 FROM articles a WHERE a.url = m.url AND a.crawl_timestamp < " + str(BATCH_START) + ")")
def not_yet_stored(s, d):
    meta = table(s, d, "crawl_metadata").select("id", "url").distinct()
    return crawlstate.missing(meta, table(s, d, "articles").where(F.col("crawl_timestamp") < BATCH_START)).select("id", "url")


@query("SELECT DISTINCT m.id, m.url FROM crawl_metadata m WHERE EXISTS (SELECT 1 FROM articles a WHERE a.url = m.url AND a.crawl_timestamp < " + str(BATCH_START) + ")")
def already_stored(s, d):
    meta = table(s, d, "crawl_metadata").select("id", "url").distinct()
    return crawlstate.existing(meta, table(s, d, "articles").where(F.col("crawl_timestamp") < BATCH_START)).select("id", "url")


def flagship(s, d):
    """Pages to text, tokens, postings, and a boolean query joined to addresses."""
    pages = table(s, d, "articles").select(F.col("id").alias("doc_id"), "url", H.page_text(F.col("html_content"), F.col("url")).alias("text"))
    hits = boolq.search(index.stems(pages, "doc_id", "text"), None, "(пилот || driver) && !дождь")
    return boolq.display(hits, pages.select("doc_id", "url"))


def oracle(folder: str = "/root/testdata/sf0.01") -> dict[str, str]:
    batch = _batch_sql(folder)
    return SQL | ({"bool_batch": batch} if batch else {})
