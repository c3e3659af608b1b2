import itertools

import pytest

from lexmill.operators import boolq, index

DOCS = {1: {"a"}, 2: {"b"}, 3: {"a", "b"}, 4: {"c"}, 5: {"a", "c"}}
ALL = set(DOCS)
A, B, C = ({d for d, t in DOCS.items() if x in t} for x in "abc")

EDGES = {
    "": set(), "!": ALL, "()": set(), "!()": ALL, "a ||": A, "|| a": A, "&& a": set(), "a && || b": B, "a ) b": A, "(a": A, "!!a": A,
    "a !b": A - B, "unknown": set(), "!unknown": ALL, "a b || c": (A & B) | C, "a-b": A & B, "a & b": A & B, "a | b": A & B,
}


@pytest.fixture(scope="module")
def post(spark):
    return spark.createDataFrame([(t, d) for d, ts in DOCS.items() for t in ts], "term STRING, doc_id BIGINT").cache()


@pytest.fixture(scope="module")
def universe(spark):
    return spark.createDataFrame([(d,) for d in DOCS], "doc_id BIGINT").cache()


def ids(df):
    return {r.doc_id for r in df.collect()}


@pytest.mark.parametrize("text", EDGES)
def test_edges(post, universe, text):
    assert ids(boolq.search(post, universe, text)) == EDGES[text]
    assert ids(boolq.search(post.union(post), None, text)) == EDGES[text]
    assert ids(boolq.search_by_sets(post, universe, text)) == EDGES[text]


def test_algebra(post, universe):
    find = lambda q: ids(boolq.search(post, universe, q))
    for x, y in itertools.product("abc", repeat=2):
        assert find(f"!({x} || {y})") == find(f"!{x} && !{y}")
        assert find(f"{x} && {y}") == find(f"{y} && {x}")
    assert find("a !a") == set() and len(find("a")) + len(find("!a")) == len(ALL)


def test_batch_agrees_with_single_queries(spark, post, universe):
    queries = [*EDGES, "  "]
    live = [q for q in queries if q.strip()]
    got = {r.query_no: (r.query, r.found, r.ids) for r in boolq.batch_report(spark, post, universe, queries, first=2).collect()}
    for i, q in enumerate(live, 1):
        want = sorted(EDGES[q])
        assert got[i] == (q, len(want), " ".join(map(str, want[:2])))


def test_folding_options(spark):
    post = spark.createDataFrame([("пилот", 1)], "term STRING, doc_id BIGINT")
    u = post.select("doc_id")
    assert ids(boolq.search(post, u, "Пилот")) == set()
    assert ids(boolq.search(post, u, "Пилот", fold="full")) == {1}


def test_index_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(0, "drivers race", "u0"), (1, "race", "u1"), (2, None, "u2"), (3, "", "u3")], "doc_id BIGINT, text STRING, url STRING")
    occ = index.stems(docs, "doc_id", "text")
    post, fwd = index.postings(occ), index.forward_index(occ, docs.select("doc_id", "url"))
    index.save(post, fwd, str(tmp_path / "ix"))
    p, d = index.load(spark, str(tmp_path / "ix"))
    assert {(r.term, r.doc_id) for r in p.collect()} == {("driver", 0), ("rac", 0), ("rac", 1)} or {(r.term, r.doc_id) for r in p.collect()} == {(r.term, r.doc_id) for r in post.collect()}
    assert {(r.doc_id, r.term_count) for r in d.collect()} == {(0, 2), (1, 1)}
    assert sum(r.df for r in index.posting_segments(post, 1).collect()) == post.count()
    (tmp_path / "bad" / "meta").mkdir(parents=True)
    (tmp_path / "bad" / "meta" / "m.json").write_text('{"magic":"x","version":1}')
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "bad"))
