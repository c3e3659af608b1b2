"""Boolean queries: lexer, tolerant parser, and one-shuffle evaluation.

Grammar: ``expr := term {'||' term}``, ``term := factor {['&&'] factor}``,
``factor := '!' factor | '(' expr ')' | WORD``.  A missing ')' is tolerated, a
stray one ends the query, and any other token where a factor is due stands for
the empty set without being consumed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.functions.lexical import INDEX_SUFFIXES, LOWER, QUERY_SUFFIXES, UPPER, stem_word

_LEX = re.compile(r"(?P<AND>&&)|(?P<OR>\|\|)|(?P<NOT>!)|(?P<OPEN>\()|(?P<CLOSE>\))|(?P<WORD>[A-Za-z0-9\u0080-\U0010ffff]+)|(?P<SKIP>.)", re.S)
_ASCII = str.maketrans(UPPER[:26], LOWER[:26])
_FULL = str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Empty:
    pass


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


def lex(query: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _LEX.finditer(query or "") if m.lastgroup != "SKIP"]


def parse(query: str, stemmer: str = "query", fold: str = "ascii"):
    """AST of a query; words are folded and stemmed as asked."""
    tokens, at = [*lex(query), ("END", "")], 0
    suffixes = {"query": QUERY_SUFFIXES, "index": INDEX_SUFFIXES}[stemmer]
    table = {"ascii": _ASCII, "full": _FULL}[fold]

    def kind() -> str:
        return tokens[at][0]

    def expression():
        nonlocal at
        left = conjunction()
        while kind() == "OR":
            at += 1
            left = Or(left, conjunction())
        return left

    def conjunction():
        nonlocal at
        left = factor()
        while kind() in ("AND", "WORD", "NOT", "OPEN"):
            at += kind() == "AND"
            left = And(left, factor())
        return left

    def factor():
        nonlocal at
        k, text = tokens[at]
        if k == "NOT":
            at += 1
            return Not(factor())
        if k == "OPEN":
            at += 1
            inner = expression()
            at += kind() == "CLOSE"
            return inner
        if k == "WORD":
            at += 1
            return Word(stem_word(text.translate(table), suffixes))
        return Empty()

    return expression()


def words(ast) -> set[str]:
    match ast:
        case Word(t):
            return {t}
        case Not(x):
            return words(x)
        case And(a, b) | Or(a, b):
            return words(a) | words(b)
    return set()


def fold_ast(ast, word, empty, no, both, either):
    """Evaluate the tree with the given algebra."""
    go = lambda x: fold_ast(x, word, empty, no, both, either)
    match ast:
        case Word(t):
            return word(t)
        case Not(x):
            return no(go(x))
        case And(a, b):
            return both(go(a), go(b))
        case Or(a, b):
            return either(go(a), go(b))
    return empty


def matches_nothing_known(ast) -> bool:
    """Whether a document without any query word matches (then NOT needs the universe)."""
    return fold_ast(ast, lambda _: False, False, lambda x: not x, lambda a, b: a and b, lambda a, b: a or b)


def _condition(ast, flag) -> Column:
    return fold_ast(ast, flag, F.lit(False), lambda x: ~x, lambda a, b: a & b, lambda a, b: a | b)


def _flags(post: DataFrame, universe: DataFrame | None, terms: list[str], whole: bool) -> DataFrame:
    """``(doc_id, f0, f1, …)``: one aggregation whatever the number of words.

    ``whole`` asks for documents without any query word too: those of ``universe``,
    or, where that is None, all of ``post`` in the same aggregation.
    """
    hit = post if whole and universe is None else post.where(F.col("term").isin(terms)) if terms else post.where(F.lit(False))
    flags = hit.groupBy("doc_id").agg(*(F.max(F.col("term") == t).alias(f"f{i}") for i, t in enumerate(terms)), F.lit(True).alias("_any"))
    if universe is None or not whole:
        return flags
    both = universe.select("doc_id").join(flags, "doc_id", "left")
    return both.select("doc_id", *(F.coalesce(f"f{i}", F.lit(False)).alias(f"f{i}") for i in range(len(terms))))


def search(post: DataFrame, universe: DataFrame | None, query: str, stemmer: str = "query", fold: str = "ascii") -> DataFrame:
    """Ids of matching documents.

    ``post(term, doc_id)`` may repeat rows, so occurrences serve as well as
    postings.  NOT is bounded by ``universe`` (unique doc_id), or by the documents
    of ``post`` where it is None, which spares a second scan.
    """
    ast = parse(query, stemmer, fold)
    terms = sorted(words(ast))
    at = {t: f"f{i}" for i, t in enumerate(terms)}
    flags = _flags(post, universe, terms, matches_nothing_known(ast))
    return flags.where(_condition(ast, lambda t: F.col(at[t]))).select("doc_id")


def numbered(lines: list[str]) -> list[str]:
    """The queries of a batch in order: lines cut at their line end, empty ones skipped; a line of blanks is a query without hits."""
    return [q for q in (re.split("[\r\n]", x or "", maxsplit=1)[0] for x in lines) if q]


def search_many(post: DataFrame, universe: DataFrame | None, queries: list[str], stemmer: str = "query", fold: str = "ascii") -> DataFrame:
    """``(query_no, doc_id)`` for all ``numbered`` queries, from 1, in one pass.

    The queries are typed by people and few; the documents are the large side.
    """
    live = numbered(queries)
    asts = [parse(q, stemmer, fold) for q in live]
    terms = sorted(set().union(*map(words, asts))) if asts else []
    at = {t: f"f{i}" for i, t in enumerate(terms)}
    flags = _flags(post, universe, terms, any(map(matches_nothing_known, asts)))
    hits = [F.when(_condition(a, lambda t: F.col(at[t])), F.lit(i)) for i, a in enumerate(asts, 1)]
    arr = F.array_compact(F.array(*hits)) if hits else F.array()
    return flags.select(F.explode(arr.cast("array<int>")).alias("query_no"), "doc_id")


def batch_report(spark, post, universe, queries, first: int = 100) -> DataFrame:
    """``(query_no, query, found, ids)``; ids are the first 100, space-joined.

    Ranks beyond the limit are dropped inside the window, per query.
    """
    live = numbered(queries)
    hits = search_many(post, universe, queries)
    found = hits.groupBy("query_no").agg(F.count(F.lit(1)).alias("found"))
    best = hits.withColumn("_r", F.row_number().over(W.partitionBy("query_no").orderBy("doc_id"))).where(F.col("_r") <= first)
    ids = best.groupBy("query_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), " ").alias("ids"))
    names = spark.createDataFrame([(i, q) for i, q in enumerate(live, 1)], "query_no int, query string")
    return names.join(found, "query_no", "left").join(ids, "query_no", "left").select("query_no", "query", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("ids", F.lit("")).alias("ids"))


def display(hits: DataFrame, docs: DataFrame, most: int = 50) -> DataFrame:
    """First hits by id with number, address and how many hits remain beyond them; hits without metadata are left out."""
    best = hits.orderBy("doc_id").limit(most)
    rows = best.withColumn("hit_no", F.row_number().over(W.orderBy("doc_id")).cast("bigint"))
    rest = hits.agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("remaining"))
    return rows.join(docs, "doc_id").crossJoin(F.broadcast(rest)).select("hit_no", "doc_id", "url", "remaining")


# Set algebra on id DataFrames: the second physical form, used in tests.


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_semi")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def complement(a: DataFrame, universe: DataFrame) -> DataFrame:
    return universe.select("doc_id").distinct().join(a.select("doc_id"), "doc_id", "left_anti")


def search_by_sets(post: DataFrame, universe: DataFrame, query: str, stemmer: str = "query", fold: str = "ascii") -> DataFrame:
    nothing = universe.select("doc_id").where(F.lit(False))
    word = lambda t: post.where(F.col("term") == t).select("doc_id").distinct()
    return fold_ast(parse(query, stemmer, fold), word, nothing, lambda x: complement(x, universe), intersect, union)


def sql_search(query: str, stemmer: str = "query", fold: str = "ascii") -> str:
    """SQL condition over all terms of one document, for HAVING after GROUP BY doc_id on ``st(doc_id, term)``."""
    word = lambda t: "bool_or(term = '" + t.replace("'", "''") + "')"
    return fold_ast(parse(query, stemmer, fold), word, "FALSE", lambda x: f"(NOT {x})", lambda a, b: f"({a} AND {b})", lambda a, b: f"({a} OR {b})")


__all__ = [n for n in dir() if n[0] != "_" and n != "reduce"]
