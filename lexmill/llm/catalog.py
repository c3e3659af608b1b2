"""Queries of the training-data problems; no SQL engine has these operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.llm import history, mixing, pages, reading, tokenizer
from lexmill.sources.readers import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Articles from here on are new; each UTC day is a batch.
BATCH_START = 1764374400

_samples: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _sample(s, d) -> pages.Sample:
    """One set of models per session and folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _samples:
        _samples.clear()
        _samples[key] = pages.sample(table(s, d, "articles"))
    return _samples[key]


@query
def p1_found(s, d):
    """Story blocks of every page."""
    return pages.main_blocks(s, table(s, d, "articles"), _sample(s, d)).select("id", "block_md5")


@query
def p2_found(s, d):
    """Pages of residue, filler and messages."""
    return pages.residue_cases(s, table(s, d, "articles"), _sample(s, d)).distinct()


@query
def p3_found(s, d):
    """Duplicates among new articles and why."""
    return history.duplicates(s, table(s, d, "articles"), table(s, d, "article_hashes"), _sample(s, d), BATCH_START)


@query
def p4_found(s, d):
    """Terms too rare or too common."""
    return pages.term_marks(table(s, d, "articles")).where("mark IS NOT NULL").select("term", "mark")


@query
def p4_terms(s, d):
    """Occurrences and records of every term."""
    return pages.term_marks(table(s, d, "articles"))


@query
def p5_found(s, d):
    """Lines repeated within a source."""
    return pages.repeated_lines(table(s, d, "articles")).select("source_name", "line_md5")


@query
def p5_text(s, d):
    """Records without their source's repeated lines."""
    return pages.without_lines(table(s, d, "articles"))


@query
def p6_found(s, d):
    """Markup shown in stories."""
    return pages.markup_constructs(s, table(s, d, "articles"), _sample(s, d)).distinct()


@query
def p6_text(s, d):
    """Stories as clean text."""
    return pages.clean_stories(s, table(s, d, "articles"), _sample(s, d))


@query
def p7_found(s, d):
    """Garbled blocks and their restored form."""
    return pages.garbled_blocks(s, table(s, d, "articles"), _sample(s, d)).select("id", "fixed_md5").distinct()


@query
def p7_text(s, d):
    """Every record with its garbled blocks restored."""
    return pages.restored_records(s, table(s, d, "articles"), _sample(s, d))


@query
def p8_ids(s, d):
    """Ids of every document."""
    return tokenizer.encode(table(s, d, "documents"))


@query
def p9_mix(s, d):
    """Documents chosen for each source and how often."""
    return mixing.mix(s, table(s, d, "documents"), table(s, d, "mix_targets"))[0]


@query
def p9_report(s, d):
    """Target and actual shares of the sources."""
    return mixing.mix(s, table(s, d, "documents"), table(s, d, "mix_targets"), name="p9_report")[1]


@query
def p10_found(s, d):
    """Easy and hard documents."""
    got = reading.levels(s, table(s, d, "documents"), table(s, d, "reading_labels")).where(F.col("level").isin(1, reading.LEVELS))
    return got.select("doc_id", F.when(F.col("level") == 1, "easy").otherwise("hard").alias("band")).distinct()


@query
def p10_levels(s, d):
    """Level of every document, null where it has none."""
    return reading.levels(s, table(s, d, "documents"), table(s, d, "reading_labels"))
