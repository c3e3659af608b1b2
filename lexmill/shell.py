"""Interactive search over a saved index: one query per line, ``exit`` ends.

    python -m lexmill.shell INDEX_FOLDER
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from lexmill.operators import boolq, index

END = "exit"


def answer(post: DataFrame, docs: DataFrame, query: str, most: int = 50) -> list[str]:
    """Lines of one answer: the hits' numbers, ids and addresses, how many remain, and the time."""
    began = time.time()
    hits = boolq.search(post, docs, query)
    rows = boolq.display(hits, docs.select("doc_id", "url"), most).orderBy("hit_no").collect()
    lines = [f"{r.hit_no}. [{r.doc_id}] {r.url}" for r in rows] or ["no documents"]
    if rows and rows[0].remaining:
        lines.append(f"... {rows[0].remaining} more")
    return [*lines, f"{1000 * (time.time() - began):.0f} ms"]


def run(post: DataFrame, docs: DataFrame, lines: Iterable[str], say: Callable[[str], None] = print) -> None:
    for line in lines:
        query = line.rstrip("\r\n")
        if query == END:
            return
        if query:
            for x in answer(post, docs, query):
                say(x)


def main() -> None:
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    run(*index.load(spark, sys.argv[1]), sys.stdin)


if __name__ == "__main__":
    main()
