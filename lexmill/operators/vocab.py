"""Vocabulary statistics over token rows ``(…, token)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def frequencies(tokens: DataFrame, col: str = "token") -> DataFrame:
    """``(token, freq)``; an empty input gives no rows."""
    return tokens.groupBy(F.col(col).alias("token")).agg(F.count(F.lit(1)).alias("freq"))


def ranked(freq: DataFrame) -> DataFrame:
    """1-based position by descending frequency, ties by token.

    No single task sorts the whole vocabulary: rows are ranked within small
    buckets (frequency, first two characters), and only the bucket sizes, whose
    number is bounded by the distinct frequencies times prefixes, pass through
    one ordered window.
    """
    rows = freq.withColumn("_p", F.substring("token", 1, 2))
    sizes = rows.groupBy(F.col("freq").alias("_f"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy(F.desc("_f"), F.asc("_q")).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("_f", "_q", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy("freq", "_p").orderBy("token"))
    return (
        rows.withColumn("_r", own)
        .join(sizes, (F.col("freq") == F.col("_f")) & (F.col("_p") == F.col("_q")))
        .select((F.col("_before") + F.col("_r")).cast("bigint").alias("rank"), "token", "freq")
    )


def top(freq: DataFrame, k: int) -> DataFrame:
    """First k by frequency with rank and share of all occurrences in percent."""
    total = freq.agg(F.sum("freq").alias("_total"))
    best = freq.orderBy(F.desc("freq"), F.asc("token")).limit(k)
    rank = F.row_number().over(W.orderBy(F.desc("freq"), F.asc("token"))).cast("bigint")
    return best.withColumn("rank", rank).crossJoin(F.broadcast(total)).select("rank", "token", "freq", F.round(F.col("freq") * 100.0 / F.col("_total"), 6).alias("pct"))


def summary(freq: DataFrame) -> DataFrame:
    """One row of totals from the aggregated vocabulary (no distinct over tokens)."""
    n, v = F.sum("freq"), F.count(F.lit(1))
    size = F.sum(F.octet_length("token") * F.col("freq"))
    return freq.agg(
        F.coalesce(n, F.lit(0)).alias("total_tokens"),
        v.alias("types"),
        F.round(v * 100.0 / n, 6).alias("type_token_pct"),
        F.round(size / n, 6).alias("mean_bytes"),
    )


def frequency_of_frequencies(freq: DataFrame, most: int = 30) -> DataFrame:
    return freq.where(F.col("freq") <= most).groupBy("freq").agg(F.count(F.lit(1)).alias("n"))


def hapax(freq: DataFrame) -> DataFrame:
    n = F.count(F.when(F.col("freq") == 1, 1))
    return freq.agg(n.alias("hapax"), F.round(n * 100.0 / F.count(F.lit(1)), 6).alias("pct"))


def coverage(freq: DataFrame, ks=(10, 100)) -> DataFrame:
    """Share of occurrences in the k most frequent types; null below k types for k > first."""
    best = freq.orderBy(F.desc("freq"), F.asc("token")).limit(max(ks))
    r = F.row_number().over(W.orderBy(F.desc("freq"), F.asc("token")))
    sums = best.withColumn("_r", r).agg(*(F.sum(F.when(F.col("_r") <= k, F.col("freq"))).alias(f"_s{k}") for k in ks))
    tot = freq.agg(F.sum("freq").alias("_n"), F.count(F.lit(1)).alias("_v"))
    return sums.crossJoin(tot).select(
        *(F.round(F.when((F.col("_v") >= k) | F.lit(k == ks[0]), F.col(f"_s{k}") * 100.0 / F.col("_n")), 6).alias(f"top{k}_pct") for k in ks)
    )


def zipf_constant(freq: DataFrame) -> DataFrame:
    """C = N / H(V), H summed over the ranks 1..V without ranking anything."""
    t = freq.agg(F.sum("freq").alias("n"), F.count(F.lit(1)).alias("v"))
    step = 10_000
    starts = t.select("n", "v", F.explode(F.sequence(F.lit(0), F.greatest(F.col("v") - 1, F.lit(0)), F.lit(step))).alias("s"))
    ranks = starts.select("n", "v", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + step, F.col("v")))).alias("r"))
    return ranks.groupBy("n", "v").agg(F.sum(1.0 / F.col("r")).alias("h")).select(
        F.col("n").alias("total_tokens"), F.col("v").alias("types"), F.round(F.col("n") / F.col("h"), 4).alias("zipf_c")
    )


def zipf_table(freq: DataFrame, k: int = 50) -> DataFrame:
    """rank, token, real and predicted frequency, deviation %, and natural logs."""
    c = zipf_constant(freq).select(F.col("zipf_c").alias("_c"))
    z = F.col("_c") / F.col("rank")
    return top(freq, k).crossJoin(F.broadcast(c)).select(
        "rank", "token", "freq",
        F.round(z, 6).alias("zipf_freq"),
        F.round((F.col("freq") - z) / z * 100.0, 6).alias("deviation_pct"),
        F.round(F.ln("rank"), 6).alias("log_rank"),
        F.round(F.ln("freq"), 6).alias("log_freq"),
        F.round(F.ln(z), 6).alias("log_zipf"),
    )


def zipf_fit(freq: DataFrame, k: int, bounds: tuple[float, ...], words: tuple[str, ...]) -> DataFrame:
    """Mean absolute deviation over the first k ranks and its verdict."""
    mean = zipf_table(freq, k).agg(F.round(F.avg(F.abs("deviation_pct")), 4).alias("mean_abs_dev"))
    verdict = F.when(F.col("mean_abs_dev") < bounds[0], words[0])
    for b, w in zip(bounds[1:], words[1:]):
        verdict = verdict.when(F.col("mean_abs_dev") < b, w)
    return mean.select(F.lit(k).cast("bigint").alias("k"), "mean_abs_dev", verdict.otherwise(words[-1]).alias("verdict"))


def log_series(x, terms: int = 20):
    """The truncated atanh series for ln(x), kept for parity; it saturates."""
    y = (x - 1.0) / (x + 1.0)
    return 2.0 * F.aggregate(F.sequence(F.lit(0), F.lit(terms - 1)), F.lit(0.0), lambda a, i: a + F.pow(y, 2 * i + 1) / (2 * i + 1))
