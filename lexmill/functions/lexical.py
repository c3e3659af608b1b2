"""Token rules as Column expressions: split, fold, filter, stem.

All lengths are bytes of UTF-8.  A null text has no tokens; so has an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules' own alphabets, delimiters, word and suffix lists.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZАБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯЁ"
LOWER = "abcdefghijklmnopqrstuvwxyzабвгдежзийклмнопрстуфхцчшщъыьэюяё"
FREQUENCY_PATTERN = r"""[^ \n\t\r,.!?;:()\[\]"'\-_/\\]+"""
INDEX_PATTERN = r"""[^ \n\t\r,.!?;:()\[\]"'\-_/\\&<>]+"""
JUNK = (
    "http https www html xml url content statistics character_count word_count article source id meta "
    "total_articles generated_date cdata &lt &gt &amp &quot ]]&gt <![cdata[ f1news ru news f1"
).split()
JUNK_PREFIXES = ("http", "www")
INDEX_SUFFIXES = (
    "ами ями ов ев ах ях ом ем ой ей ый ий ая яя ое ее ые ие ть ет ит ют ят ал ел ил у ю а я ы и о е ing ed ly er s"
).split()
QUERY_SUFFIXES = "ами ями ов ев ах ях ом ем ой ей ый ий ая ое ее ые ие ть ет ит у а я ы и о е ing ed s".split()
BYTE_LIMIT = 50
STEM_FLOOR = 4
STEM_LEAST = 3

PATTERNS = {"frequency": FREQUENCY_PATTERN, "index": INDEX_PATTERN}


def fold(text: Column) -> Column:
    """Lower case of A-Z, А-Я and Ё only; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def split_tokens(text: Column, mode: str = "index") -> Column:
    """Folded maximal runs of non-delimiters, in order."""
    return F.regexp_extract_all(fold(text), F.lit(PATTERNS[mode]), F.lit(0))


def is_junk(token: Column) -> Column:
    single = (F.octet_length(token) == 1) & ~token.between("a", "z")
    return reduce(lambda a, b: a | b, (F.startswith(token, F.lit(p)) for p in JUNK_PREFIXES), token.isin(JUNK)) | single


def in_bounds(token: Column) -> Column:
    return F.octet_length(token) < BYTE_LIMIT


def stem(token: Column, suffixes=INDEX_SUFFIXES) -> Column:
    """Strip the first listed suffix that leaves at least three bytes, once."""
    size = F.octet_length(token)
    case = F.when(size < STEM_FLOOR, token)
    for s in suffixes:
        case = case.when(
            F.endswith(token, F.lit(s)) & (size - len(s.encode()) >= STEM_LEAST),
            F.substring(token, F.lit(1), F.length(token) - len(s)),
        )
    return case.otherwise(token)


def stem_word(word: str, suffixes=QUERY_SUFFIXES) -> str:
    """The same rule for one word on the driver (query words)."""
    size = len(word.encode())
    if size < STEM_FLOOR:
        return word
    for s in suffixes:
        if word.endswith(s) and size - len(s.encode()) >= STEM_LEAST:
            return word[: -len(s)]
    return word


def kept_tokens(df: DataFrame, id_col: str, text_col: str, mode: str = "index", position: bool = False) -> DataFrame:
    """``(id, [pos,] token)``: one row per token that passes the junk and length rules.

    Extra columns of ``df`` are ignored; repeated rows give repeated tokens.
    """
    arr = split_tokens(F.col(text_col), mode)
    if position:
        rows = df.select(F.col(id_col), F.posexplode(arr).alias("pos", "token"))
    else:
        rows = df.select(F.col(id_col), F.explode(arr).alias("token"))
    return rows.where(in_bounds(F.col("token")) & ~is_junk(F.col("token")))


# The same rules as DuckDB SQL text, built from the constants above.


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_tokens(table: str, id_col: str, text_col: str, mode: str = "index") -> str:
    junk = ", ".join(map(_q, JUNK))
    prefix = " AND ".join(f"NOT starts_with(t, {_q(p)})" for p in JUNK_PREFIXES)
    return (
        f"raw AS (SELECT {id_col}, unnest(regexp_extract_all(translate({text_col}, {_q(UPPER)}, {_q(LOWER)}), {_q(PATTERNS[mode])})) AS t FROM {table}), "
        f"tok AS (SELECT {id_col}, t FROM raw WHERE octet_length(encode(t)) < {BYTE_LIMIT} AND t NOT IN ({junk}) AND {prefix} "
        f"AND NOT (octet_length(encode(t)) = 1 AND NOT (t >= 'a' AND t <= 'z')))"
    )


def sql_stem(t: str, suffixes=INDEX_SUFFIXES) -> str:
    size = f"octet_length(encode({t}))"
    arms = " ".join(
        f"WHEN ends_with({t}, {_q(s)}) AND {size} - {len(s.encode())} >= {STEM_LEAST} THEN substr({t}, 1, length({t}) - {len(s)})"
        for s in suffixes
    )
    return f"(CASE WHEN {size} < {STEM_FLOOR} THEN {t} {arms} ELSE {t} END)"
