"""Problem 9: mixing sources to target shares of the total tokens.

A text may stand in several sources (exact repeats), so sources overlap.  Rows
are aggregated by their text's membership pattern, the set of target sources that
hold it; every row of a repeated text counts, towards the quotas as in the patterns;
a min-cost flow routes the patterns' token capacity to the sources' quotas, the
k-th use of a pattern costing k - 1, so that repetition is spread and used last.
Within a pattern the rows lie on a circle in seeded hash order, those of one source
beside each other, and each source's flow is an arc: a row is used as often as the arcs
cover its start.  A row that is taken tells all target sources that hold its text.

The flow's graph has the patterns that occur and the sources of the target
table, both few; all sums over documents are distributed.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.llm import tokenizer
from lexmill.store import stored

SEED = 20_251
#: Buckets of the seeded hash within a pattern: positions are summed by bucket first.
BUCKETS = 1 << 14


class _Flow:
    """Successive shortest paths on a small graph with integer capacities and costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> None:
        far = 1 << 60
        while True:
            best = [far] * len(self.out)
            via = [-1] * len(self.out)
            best[source] = 0
            queue, waiting = deque([source]), {source}
            while queue:
                a = queue.popleft()
                waiting.discard(a)
                for e in self.out[a]:
                    b = self.to[e]
                    if self.room[e] > 0 and best[a] + self.cost[e] < best[b]:
                        best[b], via[b] = best[a] + self.cost[e], e
                        if b not in waiting:
                            queue.append(b)
                            waiting.add(b)
            if best[sink] == far:
                return
            push, b = far, sink
            while b != source:
                push, b = min(push, self.room[via[b]]), self.to[via[b] ^ 1]
            b = sink
            while b != source:
                self.room[via[b]] -= push
                self.room[via[b] ^ 1] += push
                b = self.to[via[b] ^ 1]


def solve(capacity: dict[tuple[str, ...], int], quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens routed from each pattern to each source.

    No pattern gives a source more than ``repeats`` times its tokens, nor all its
    sources together more than the largest of their caps.
    """
    patterns = sorted(p for p, c in capacity.items() if c > 0 and p)
    sources = sorted(quota)
    at = {s: 1 + len(patterns) + i for i, s in enumerate(sources)}
    end = 1 + len(patterns) + len(sources)
    f = _Flow(end + 1)
    routed = {}
    for i, p in enumerate(patterns, 1):
        # No pattern is asked for more rounds than its sources' quotas fill.
        rounds = min(max((repeats[s] for s in p), default=0), -(-sum(quota[s] for s in p) // capacity[p]))
        for k in range(rounds):
            f.arc(0, i, capacity[p], k)
        for s in p:
            routed[p, s] = f.arc(i, at[s], capacity[p] * repeats[s], 0)
    for s in sources:
        f.arc(at[s], end, quota[s], 0)
    f.run(0, end)
    return {k: f.room[e ^ 1] for k, e in routed.items() if f.room[e ^ 1] > 0}


def targets(rows) -> tuple[dict[str, float], dict[str, int]]:
    """Shares scaled to the sum of 1 and repetition caps; a source's later line replaces an earlier one.

    Lines without a source, with a share that is null or not above 0, or with a
    cap below 1 are left out; a null cap is 1.
    """
    share, cap = {}, {}
    for r in rows:
        m = 1 if r["max_repeats"] is None else r["max_repeats"]
        if r["source"] is None or r["target_share"] is None or not r["target_share"] > 0 or m < 1:
            continue
        share[r["source"]], cap[r["source"]] = float(r["target_share"]), int(m)
    total = sum(share.values())
    return {s: v / total for s, v in share.items()}, cap


def _units(spark: SparkSession, docs: DataFrame, wanted: list[str], path: str, name: str) -> tuple[DataFrame, int]:
    """``(units, total)``: (k, pattern, home, n_tokens, doc_id), one per row of the target sources; the tokens of all rows.

    Rows without tokens are left out.
    """
    key = F.xxhash64("text", F.lit(1))
    rows = docs.select("doc_id", "source", "text").where("text IS NOT NULL AND text <> ''")
    counted = tokenizer.count(rows.select(F.struct("doc_id", "source", key.alias("k")).alias("r"), "text"), path, "r", "text")
    flat = stored(spark, counted.select("r.doc_id", "r.source", "r.k", "n_tokens"), f"{name}_rows")
    total = flat.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n")).first()["n"]
    mine = flat.where(F.col("source").isin(wanted))
    shared = mine.groupBy("k").agg(F.sort_array(F.collect_set("source")).alias("several")).where(F.size("several") > 1)
    pattern = F.coalesce("several", F.array("source")).alias("pattern")
    return stored(spark, mine.join(shared, "k", "left").select("k", pattern, F.col("source").alias("home"), "n_tokens", "doc_id"), name), total


def mix(spark: SparkSession, docs: DataFrame, target: DataFrame, path: str = tokenizer.RANKS, seed: int = SEED, name: str = "p9") -> tuple[DataFrame, DataFrame]:
    """``(chosen, report)``.

    chosen (doc_id, source, home, members, n_tokens, repeats): documents taken for a
    source and how often; home is the row's own source, members are all target sources
    that hold its text, ``source`` among them.
    report (source, target_share, available, quota, tokens, share_of_quota_total,
    actual_share): the quotas add up to the tokens of all texts, and a source that can't
    be met has a smaller share of that total; actual_share is of what was mixed.  Null and empty texts have no tokens and are never taken.
    """
    share, cap = targets(sorted(target.select("source", "target_share", "max_repeats").collect(), key=lambda r: (str(r["source"]), str(r["target_share"]), str(r["max_repeats"]))))
    units, total = _units(spark, docs, sorted(share), path, f"{name}_units")
    capacity = {tuple(r["pattern"]): r["n"] for r in units.groupBy("pattern").agg(F.sum("n_tokens").alias("n")).collect()}
    quota = {s: round(v * total) for s, v in share.items()}
    flow = solve(capacity, quota, cap)
    # Arcs of every pattern's circle, one after another: (start, length) per source.
    arcs, ends = [], {}
    for (p, s), f in sorted(flow.items()):
        start = ends.get(p, 0)
        arcs.append((list(p), s, start, f, capacity[p]))
        ends[p] = start + f
    arc = spark.createDataFrame(arcs, "pattern ARRAY<STRING>, source STRING, start BIGINT, length BIGINT, round BIGINT")
    # Positions on the circle: sums before the bucket, then within it.
    h = F.xxhash64("k", "doc_id", F.lit(seed))
    live = units.withColumn("h", h).withColumn("b", F.pmod(F.shiftright("h", 20), F.lit(BUCKETS)))
    sums = live.groupBy("pattern", "home", "b").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("pattern", "home", "b", F.coalesce(F.sum("n").over(W.partitionBy("pattern").orderBy("home", "b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(W.partitionBy("pattern", "home", "b").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = live.withColumn("w", within).join(before, ["pattern", "home", "b"]).withColumn("x", F.col("before") + F.col("w"))
    # Uses: whole rounds k with start <= x + k * round < start + length.
    uses = F.ceil((F.col("start") + F.col("length") - F.col("x")) / F.col("round")) - F.ceil((F.col("start") - F.col("x")) / F.col("round"))
    chosen = placed.join(arc, "pattern").withColumn("repeats", uses.cast("int")).where("repeats > 0").select("doc_id", "source", "home", F.col("pattern").alias("members"), "n_tokens", "repeats")
    available = {s: sum(c for p, c in capacity.items() if s in p) for s in share}
    lines = spark.createDataFrame([(s, share[s], int(available[s]), int(quota[s])) for s in sorted(share)], "source STRING, target_share DOUBLE, available BIGINT, quota BIGINT")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    report = lines.join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    whole = F.sum("tokens").over(W.partitionBy())
    report = report.withColumn("share_of_quota_total", F.col("tokens") / F.lit(float(max(total, 1))))
    return chosen, report.withColumn("actual_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0))
