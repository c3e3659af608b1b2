"""Spark side of the page problems (1, 2, 4, 5, 6, 7): fitting, mapping.

``articles`` may repeat rows and have nulls in any column: a null html_content
is an empty page, rows with a null id give no result rows, and repeated rows give
their results once.  Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from hashlib import md5
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from lexmill.llm import encoding, lines, mainbody, markup, residue, terms
from lexmill.llm.blocks import blocks, clean, raw_blocks, raw_blocks_with_paths
from lexmill.store import stored

#: No model is of a sample; the bounds of the one there was are left for tests that set them.
SHORT_SAMPLE, LONG_SAMPLE = 2_500, 1_200
#: Rounds in which the block labeller is trained at least; each goes through a part of the pages, and then the tasks' weights are averaged.
ROUNDS = 6
#: Pages that training looks at in all at least, by going through a small table up to ``mainbody.EPOCHS`` times.
VISITS = 20_000
#: Pages of the table for each task that learns, at least.
LEARNT = 5_000
#: How often a story with markup shown in it, or a page that only lists stories, counts in training.
RARE = 3
#: Parts of the weights that are averaged by themselves.
WEIGHT_PARTS = 16
#: Pages that one step of a task works on together.
CHUNK = 400
#: Distinct blocks that a task counts before it hands them on.
REMEMBERED = 50_000


@dataclass
class Sample:
    """The whole table that models are of, and the models fitted so far."""

    articles: DataFrame
    fitted: dict = field(default_factory=dict)


def sample(articles: DataFrame) -> Sample:
    return Sample(articles)


def _sources(htmls: list[str]) -> list[list[str]]:
    return [[b for b in raw_blocks(h) if b and not b.isspace()] for h in htmls]


def training_blocks(articles: DataFrame) -> DataFrame:
    """(block, n, held): blocks of all pages whose blocks all look clean, and how often they occur; a fifth of them is held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["block", "n"])
            counts.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                counts.update(encoding.training_blocks(_sources(batch.slice(at, CHUNK).column(0).to_pylist())))
                if len(counts) > REMEMBERED:
                    yield rows()
        yield rows()

    found = articles.select("html_content").where("html_content <> ''").mapInArrow(run, "block STRING, n BIGINT").groupBy("block").agg(F.sum("n").alias("n"))
    return found.withColumn("held", F.crc32(F.col("block").cast("binary")) % encoding.HELD == 0)


def _summed(texts: DataFrame, count: Callable, size: int) -> np.ndarray:
    """``count(texts, times) -> array of size`` added up over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_pylist(), batch.column(1).to_numpy())
        k = np.flatnonzero(total)
        for at in range(0, len(k), 100_000):
            part = k[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["k", "n"])

    got = texts.select("block", "n").mapInArrow(run, "k BIGINT, n BIGINT").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got.column("k").to_numpy()] = got.column("n").to_numpy()
    return out


def fit_encoding(s: Sample) -> encoding.Model:
    """``encoding.fit`` over all pages: counts are added up, thresholds taken of all held-out blocks."""
    if "encoding" not in s.fitted:
        spark = s.articles.sparkSession
        every = stored(spark, training_blocks(s.articles), "spelt")
        taught, held = every.where("NOT held"), every.where("held")
        counts = _summed(taught, encoding.character_counts, 65536)
        if not counts.any():
            taught = held if held.head(1) else spark.createDataFrame([("abc abc", 1)], "block STRING, n BIGINT")
            counts = _summed(taught, encoding.character_counts, 65536)
        classes, size = encoding.alphabet(counts)
        model = encoding.smoothed(classes, size, _summed(taught, lambda texts, times: encoding.trigram_counts(texts, times, classes, size), size**3))
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                gains, spoilt = encoding.odds(batch.column(0).to_pylist(), shared.value)
                gains, n = np.unique(gains, return_counts=True)
                top = [float(spoilt.max()) if len(spoilt) else None] * len(n)
                yield pa.RecordBatch.from_arrays([pa.array(gains, pa.float64()), pa.array(n, pa.int64()), pa.array(top, pa.float64())], ["gain", "n", "spoilt"])

        def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.means(batch.column(0).to_pylist()), pa.float64())], ["mean"])

        def usual() -> float:
            some = held if held.head(1) else taught
            return some.select("block").mapInArrow(means, "mean DOUBLE").agg(F.expr("percentile(mean, 0.05)")).first()[0]

        got = held.select("block").mapInArrow(run, "gain DOUBLE, n BIGINT, spoilt DOUBLE").agg(F.expr(f"percentile(gain, {encoding.MARGIN_QUANTILE}, n)"), F.max("spoilt")).first()
        s.fitted["encoding"] = encoding.bounded(model, got[0], got[1], usual)
        shared.unpersist()
    return s.fitted["encoding"]


def passages(articles: DataFrame) -> DataFrame:
    """(passage, neg, other, seed, beside): all passages of all pages with the counts of ``residue.passages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def rows():
            counts = np.array(list(found.values()), np.int64).reshape(-1, 4)
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *map(pa.array, counts.T.copy())], ["passage", "neg", "other", "seed", "beside"])
            found.clear()
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                residue.passages(list(map(blocks, batch.slice(at, CHUNK).column(0).to_pylist())), found)
                if len(found) > REMEMBERED:
                    yield rows()
        yield rows()

    got = articles.select("html_content").where("html_content <> ''").mapInArrow(run, "passage STRING, neg BIGINT, other BIGINT, seed BIGINT, beside BIGINT")
    return got.groupBy("passage").agg(*(F.sum(c).alias(c) for c in ("neg", "other", "seed", "beside")))


#: Parts of one occurrence that the expected counts are added up in, so that the sums are the same in any order.
PARTS = 1 << 30


def fit_residue(s: Sample) -> residue.Model:
    """``residue.fit`` over all pages: features are counted, every round of EM is run, and the bound is taken, over all distinct passages."""
    if "residue" not in s.fitted:
        s.fitted["residue"] = _fit_residue(s.articles)
    return s.fitted["residue"]


def _fit_residue(articles: DataFrame) -> residue.Model:
    spark = articles.sparkSession
    every = stored(spark, passages(articles), "passages")
    totals = every.agg(F.sum("seed").alias("seed"), F.sum(F.expr("IF(seed = 0 AND neg > 0, neg + other, 0)")).alias("neg")).first()
    if not totals["seed"]:
        return residue.Model({}, -1e9)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def rows():
            counts = np.array(list(found.values()), np.int64).reshape(-1, 3)
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *map(pa.array, counts.T.copy())], ["feature", "neg", "open", "seed"])
            found.clear()
            return out

        for batch in batches:
            for text, neg, other, seed in zip(*(c.to_pylist() for c in batch.columns)):
                k, n = residue.class_of(neg, seed), seed or neg + other
                for x in residue.features(text):
                    if x not in found:
                        found[x] = [0, 0, 0]
                    found[x][k] += n
            if len(found) > 4 * REMEMBERED:
                yield rows()
        yield rows()

    parts = every.select("passage", "neg", "other", "seed").mapInArrow(count, "feature STRING, neg BIGINT, open BIGINT, seed BIGINT")
    got = parts.groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("neg", "open", "seed"))).toArrow().sort_by("feature")
    known, (neg, open_, pos) = got.column("feature").to_pylist(), (got.column(c).to_numpy() for c in ("neg", "open", "seed"))
    more = sorted({x for p in residue.EXAMPLES for x in residue.features(p)}.difference(known))
    size, known = len(known) + len(more), known + more
    neg, pos = (np.concatenate([x, np.zeros(len(more))]) for x in (neg, pos))
    places = spark.sparkContext.broadcast({known[k]: k for k in np.flatnonzero(open_).tolist()})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = places.value.__getitem__
        for batch in batches:
            ids = [list(map(of, residue.features(p))) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["ids", "n", "beside"])

    unlabelled = every.where("neg = 0 AND seed = 0").select("passage", F.col("other").alias("n"), (F.col("beside") > 0).alias("beside"))
    unlabelled = stored(spark, unlabelled.mapInArrow(number, "ids ARRAY<INT>, n BIGINT, beside BOOLEAN"), "unlabelled")
    places.unpersist()

    def spread(now):
        shared = spark.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, size + 1), np.int64)
            for batch in batches:
                ids, sizes = batch.column(0).flatten().to_numpy(), batch.column(0).value_lengths().to_numpy()
                both = residue.spread(ids, sizes, batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), shared.value, size)
                for row, (sums, every_) in zip(total, both):
                    row += np.rint(np.append(sums, every_) * PARTS).astype(np.int64)
            k = np.flatnonzero(total.any(0))
            for at in range(0, len(k), 100_000):
                part = k[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], ["k", "up", "un"])

        got = unlabelled.mapInArrow(run, "k BIGINT, up BIGINT, un BIGINT").groupBy("k").agg(F.sum("up").alias("up"), F.sum("un").alias("un")).toArrow()
        shared.unpersist()
        out = []
        for c in ("up", "un"):
            sums = np.zeros(size + 1)
            sums[got.column("k").to_numpy()] = got.column(c).to_numpy() / PARTS
            out.append((sums[:-1], float(sums[-1])))
        return out

    model = residue.settle(known, neg, float(totals["neg"]), pos, float(totals["seed"]), spread)
    final = spark.sparkContext.broadcast(model)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = final.value.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(map(score, batch.column(0).to_pylist())), pa.float64())], ["score"])

    least = every.where("seed > 0").select("passage").mapInArrow(lowest, "score DOUBLE").agg(F.min("score")).first()[0]
    final.unpersist()
    return residue.bounded(model, least)


def fit_mainbody(s: Sample) -> mainbody.Tagger:
    """The block labeller, trained on all pages that hold no residue.

    A round's pages are told by a hash of the id.  Tasks learn from theirs where these
    are read, beginning with the same weights, and hand on weights only.
    """
    if "mainbody" not in s.fitted:
        s.fitted["mainbody"] = _fit_mainbody(s)
    return s.fitted["mainbody"]


def _fit_mainbody(s: Sample) -> mainbody.Tagger:
    spark, known = s.articles.sparkSession, s.articles.count()
    visits = min(mainbody.EPOCHS, max(1, -(-VISITS // max(known, 1))))
    rounds = max(ROUNDS, visits)
    res = spark.sparkContext.broadcast(fit_residue(s))
    tasks = max(1, known // LEARNT)
    row, taught = mainbody.flat(mainbody.start()), False
    for k in range(rounds):
        here = s.articles.where("html_content <> ''").where(F.pmod(F.xxhash64("id", F.lit("round")) - F.lit(k), F.lit(rounds)) < visits)
        shared = spark.sparkContext.broadcast(row)
        # Small tables, of which each page is seen several times, give enough steps only in smaller batches.
        got = _learnt(here.select("html_content").coalesce(tasks), res, shared, k, k / rounds, mainbody.BATCH // (2 if visits > 1 else 1))
        if got is not None:
            row, taught = got, True
        shared.unpersist()
    res.unpersist()
    return mainbody.Tagger(mainbody.unflat(row)) if taught else mainbody.untaught()


def _learnt(htmls: DataFrame, res, weights, number: int, done: float, size: int) -> np.ndarray | None:
    """Weights after one round: those that the tasks end with, averaged by the pages they learned from; None where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        judge, rng = residue.Judge(res.value), np.random.default_rng((mainbody.SEED, number, task))
        learner, data, n, rate = mainbody.Learner(mainbody.unflat(weights.value)), [], 0, mainbody.rate_at(done)
        for batch in batches:
            for h in batch.column(0).to_pylist():
                page = [(c, p) for r, p in raw_blocks_with_paths(h) if (c := clean(r))]
                found = mainbody.examples(page, rng)
                if not found or judge([t for t, _ in page]):
                    continue
                rare = any("div.item" in p for _, p in page) or any(markup.constructs(t) for t, _ in page)
                data.append((found, RARE if rare else 1))
                n += 1
                if len(data) >= mainbody.BATCH * 4:
                    learner.learn(data, size, rate, rng)
                    data.clear()
        if data:
            learner.learn(data, size, rate, rng)
        if n:
            parts = np.array_split(mainbody.flat(learner.m.w), WEIGHT_PARTS)
            cols = [pa.array(range(WEIGHT_PARTS), pa.int32()), pa.array([task] * WEIGHT_PARTS, pa.int32()), pa.array([n] * WEIGHT_PARTS, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "task", "n", "row"])

    def average(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        n, total = rows.column("n").to_numpy(), 0.0
        for times, x in zip(n, rows.column("row")):
            total = total + times * np.frombuffer(x.as_py(), np.float32).astype(np.float64)
        return pa.table({"part": rows.column("part").slice(0, 1), "row": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())})

    schema = "part INT, row BINARY"
    got = htmls.mapInArrow(run, "part INT, task INT, n BIGINT, row BINARY").groupBy("part").applyInArrow(average, schema).collect()
    return np.concatenate([np.frombuffer(r["row"], np.float32) for r in sorted(got)]) if got else None


def fit_markup(s: Sample) -> markup.Weights:
    """``markup.fit`` over all pages that hold no residue."""
    if "markup" not in s.fitted:
        shared = s.articles.sparkSession.sparkContext.broadcast(fit_residue(s))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge, counts = residue.Judge(shared.value), markup.Counts()

            def rows():
                got = [(side, w, n) for side, found in enumerate(counts.drain()) for w, n in found.items()]
                return pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["side", "w", "n"])

            for batch in batches:
                for h in batch.column(0).to_pylist():
                    page = [(c, p) for r, p in raw_blocks_with_paths(h) if (c := clean(r))]
                    if (y := mainbody.teach(page)) is not None and not judge([t for t, _ in page]):
                        counts.add(page, y)
                if sum(map(len, counts.texts)) > REMEMBERED:
                    yield rows()
            yield rows()

        parts = s.articles.select("html_content").where("html_content <> ''").mapInArrow(run, "side INT, w STRING, n BIGINT")
        got = parts.groupBy("side", "w").agg(F.sum("n").alias("n")).toArrow()
        found: list[dict[str, int]] = [{}, {}, {}, {}]
        for side, w, n in zip(*(got.column(c).to_pylist() for c in ("side", "w", "n"))):
            found[side][w] = n
        s.fitted["markup"] = markup.weighed(*found)
        shared.unpersist()
    return s.fitted["markup"]


def map_pages(articles: DataFrame, columns: list[str], schema: str, step: Callable, setup: Callable) -> DataFrame:
    """Run ``step(state, columns as lists) -> columns of rows`` over chunks of pages.

    ``setup()`` makes the task's state once; it may hold models (broadcast).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                out = step(state, *(part.column(i).to_pylist() for i in range(part.num_columns)))
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"BIGINT": pa.int64(), "INT": pa.int32(), "STRING": pa.string(), "BINARY": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    return articles.select(*columns).mapInArrow(run, schema)


def hex_md5(text: str) -> str:
    return md5(text.encode("utf-8", "surrogatepass")).hexdigest()


class Reader:
    """Pages to blocks, with the repair of encodings and the residue decision.

    The decision is the same for every problem: pages with body enough are judged as
    they stand, others after repair.  ``repair_all`` asks for the repair of the former
    too, ``paths`` for the blocks' open elements.
    """

    def __init__(self, enc: encoding.Model, res: residue.Model, repair_all: bool, paths: bool = True):
        self.repair, self.judge = encoding.Repairer(enc), residue.Judge(res)
        self.repair_all, self.split = repair_all, raw_blocks_with_paths if paths else lambda h: [(r, ()) for r in raw_blocks(h)]
        self.sources: list[list[str]] = []

    def __call__(self, htmls: list[str | None]):
        """Per page: (source, path, text) of its blocks, texts after repair, residue or not; ``sources`` has the sources after repair."""
        pages = [[(r, p, c) for r, p in self.split(h) if (c := clean(r))] for h in htmls]
        stands = [[c for _, _, c in page] for page in pages]
        rich = [residue._rich(texts) for texts in stands]
        fixed, self.sources = [list(texts) for texts in stands], [[r for r, _, _ in page] for page in pages]
        at = [(i, k) for i, page in enumerate(pages) if self.repair_all or not rich[i] for k in range(len(page))]
        for j, source in self.repair([pages[i][k][0] for i, k in at]).items():
            i, k = at[j]
            if source is not None and (text := clean(source)):
                fixed[i][k], self.sources[i][k] = text, source
        return pages, fixed, [self.judge(s if r else f) for s, r, f in zip(stands, rich, fixed)]


def main_blocks(spark: SparkSession, articles: DataFrame, s: Sample) -> DataFrame:
    """(id, block_md5, text): story blocks of every page that is no case of problem 2."""
    models = spark.sparkContext.broadcast((fit_encoding(s), fit_residue(s), fit_mainbody(s)))

    def setup():
        enc, res, tag = models.value
        return Reader(enc, res, True), tag

    def step(state, ids, htmls):
        reader, tag = state
        pages, fixed, cases = reader(htmls)
        live = [i for i, c in enumerate(cases) if not c and pages[i] and ids[i] is not None]
        marks = tag.label([[(f, p) for f, (_, p, _) in zip(fixed[i], pages[i])] for i in live])
        rows = {}
        for i, mask in zip(live, marks):
            for k in np.flatnonzero(mask).tolist():
                rows.setdefault((ids[i], pages[i][k][2]))
        return [r[0] for r in rows], [hex_md5(r[1]) for r in rows], [r[1] for r in rows]

    return map_pages(articles, ["id", "html_content"], "id BIGINT, block_md5 STRING, text STRING", step, setup)


def residue_cases(spark: SparkSession, articles: DataFrame, s: Sample) -> DataFrame:
    """(id) of pages that hold residue, filler or messages in place of content."""
    models = spark.sparkContext.broadcast((fit_encoding(s), fit_residue(s)))

    def step(reader, ids, htmls):
        return ([i for i, case in zip(ids, reader(htmls)[2]) if case and i is not None],)

    return map_pages(articles, ["id", "html_content"], "id BIGINT", step, lambda: Reader(*models.value, False, paths=False))


def garbled_blocks(spark: SparkSession, articles: DataFrame, s: Sample) -> DataFrame:
    """(id, fixed_md5, block, fixed): garbled blocks and their restored text; '' where characters are lost."""
    models = spark.sparkContext.broadcast(fit_encoding(s))

    def step(repair, ids, htmls):
        raws, of = [], []
        for i, h in zip(ids, htmls):
            if i is not None:
                x = [r for r in raw_blocks(h) if r and not r.isspace()]
                raws += x
                of += [i] * len(x)
        rows = {}
        for j, text in repair(raws).items():
            fixed = clean(text) if text is not None else ""
            if text is None or fixed:
                rows.setdefault((of[j], fixed), raws[j])
        return [k[0] for k in rows], [hex_md5(k[1]) if k[1] else "" for k in rows], [clean(v) for v in rows.values()], [k[1] for k in rows]

    return map_pages(articles, ["id", "html_content"], "id BIGINT, fixed_md5 STRING, block STRING, fixed STRING", step, lambda: encoding.Repairer(models.value))


def restored_records(spark: SparkSession, articles: DataFrame, s: Sample) -> DataFrame:
    """(id, text, restored, lost): every record's blocks, one per line, garbled ones restored, with their numbers.

    Blocks whose characters are lost stay as they are.
    """
    models = spark.sparkContext.broadcast(fit_encoding(s))

    def step(repair, ids, htmls):
        raws = [[r for r in raw_blocks(h) if r and not r.isspace()] for h in htmls]
        at = [(i, k) for i, x in enumerate(raws) for k in range(len(x))]
        restored, lost = [0] * len(ids), [0] * len(ids)
        for j, text in repair([raws[i][k] for i, k in at]).items():
            i, k = at[j]
            if text is None:
                lost[i] += 1
            elif clean(text):
                raws[i][k] = text
                restored[i] += 1
        return ids, ["\n".join(c for c in map(clean, x) if c) for x in raws], restored, lost

    return map_pages(articles, ["id", "html_content"], "id BIGINT, text STRING, restored INT, lost INT", step, lambda: encoding.Repairer(models.value))


class Regions:
    """Sources of the story's region of every page; none for cases of problem 2."""

    def __init__(self, enc: encoding.Model, res: residue.Model, weights: markup.Weights, repair_all: bool):
        self.reader, self.weights = Reader(enc, res, repair_all), weights

    def __call__(self, htmls: list[str | None]) -> list[list[str]]:
        """Lines of a bare record are joined to one source; lines the site adds as list items are left out."""
        pages, fixed, cases = self.reader(htmls)
        out = []
        for page, texts, sources, case in zip(pages, fixed, self.reader.sources, cases):
            if case or not page:
                out.append([])
                continue
            dashes = [k for k, (r, _, _) in enumerate(page) if r.lstrip()[:2] == "- "]
            for j, t in self.reader.repair([page[k][0] for k in dashes]).items() if dashes else ():
                if t is not None:
                    texts[dashes[j]] = clean(t)
            added = {k for k in dashes if mainbody.added(texts[k])}
            lo, hi = self.weights.region([(f, p) for f, (_, p, _) in zip(texts, page)])
            keep = [unescape(r) if "&" in r else r for k, r in enumerate(sources[lo:hi], lo) if k not in added]
            out.append((["\n".join(keep)] if page[lo][1] == ("#text",) else [r.strip() for r in keep]) if lo < hi else [])
        return out


def markup_constructs(spark: SparkSession, articles: DataFrame, s: Sample) -> DataFrame:
    """(id, markup, construct) seen in the stories of pages that are no cases of problem 2."""
    models = spark.sparkContext.broadcast((fit_encoding(s), fit_residue(s), fit_markup(s)))

    def step(regions, ids, htmls):
        rows = sorted({(i, *c) for i, sources in zip(ids, regions(htmls)) if i is not None for source in sources for c in markup.constructs(source)})
        return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    return map_pages(articles, ["id", "html_content"], "id BIGINT, markup STRING, construct STRING", step, lambda: Regions(*models.value, False))


def clean_stories(spark: SparkSession, articles: DataFrame, s: Sample) -> DataFrame:
    """(id, text): the region of every page as clean text, encodings repaired; '' for pages without one."""
    models = spark.sparkContext.broadcast((fit_encoding(s), fit_residue(s), fit_markup(s)))

    def step(regions, ids, htmls):
        return ids, ["\n\n".join(t for t in map(markup.clean_text, sources) if t) for sources in regions(htmls)]

    return map_pages(articles, ["id", "html_content"], "id BIGINT, text STRING", step, lambda: Regions(*models.value, True))


def term_counts(articles: DataFrame) -> DataFrame:
    """(term, occurrences, records) over all pages; every row of ``articles`` is a record."""

    def run(batches):
        counter = terms.LastSeen()

        def rows():
            t, o, r = counter.drain()
            return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(o, pa.int64()), pa.array(r, pa.int64())], ["term", "occurrences", "records"])

        for batch in batches:
            for h in batch.column(0).to_pylist():
                counter.add(terms.terms(blocks(h)))
                if len(counter.of) > terms.HELD:
                    yield rows()
        yield rows()

    parts = articles.select("html_content").mapInArrow(run, "term STRING, occurrences BIGINT, records BIGINT")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_marks(articles: DataFrame, common: float = 0.3) -> DataFrame:
    """(term, occurrences, records, mark): 'rare' in one record, 'common' in the given share of rows, else null."""
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") >= common * articles.count(), "common")
    return term_counts(articles).select("term", "occurrences", "records", mark.alias("mark"))


#: Rows (line, record) that a task holds before it packs them, at 28 bytes each; pages that it reads and rows that it hands on at a time.
LINES_HELD, LINE_PAGES, LINE_ROWS = 400_000, 100, 20_000
#: Bytes of bitmaps up to which every task looks lines up in all of them.
LOOKED_UP = 24 << 20


def line_bitmaps(articles: DataFrame, least: int = 5, share: float = 0.02, name: str = "p5") -> tuple[DataFrame, DataFrame]:
    """``(cases, bitmaps)``.

    cases (source_name, line, records): lines in at least ``least`` records and ``share``
    of the source's; bitmaps (source_name, line, hi, bits): united containers of all
    lines that may be cases.  Tasks hand on bitmaps of their own records, and only
    containers of one span of ids are ever united in one place.
    """
    known = articles.where(F.col("source_name").isNotNull() & F.col("id").isNotNull())

    def run(batches):
        held, key_of = lines.Occurrences(), lines.Keys()

        def rows():
            names, source, keys, span, bits = held.drain()
            names = pa.array(names, pa.string())
            for k in range(0, len(keys), LINE_ROWS):
                part = slice(k, k + LINE_ROWS)
                cols = [names.take(pa.array(source[part])), pa.array(keys[part], pa.binary()), pa.array(span[part]), pa.array(bits[part], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["source_name", "line", "hi", "bits"])

        for batch in batches:
            for at in range(0, batch.num_rows, LINE_PAGES):
                part = batch.slice(at, LINE_PAGES)
                held.add((i, source, set(map(key_of.__getitem__, blocks(h))) - {b""}) for i, source, h in zip(*(part.column(c).to_pylist() for c in range(3))))
                if held.size > LINES_HELD:
                    yield from rows()
        yield from rows()

    parts = known.select("id", "source_name", "html_content").mapInArrow(run, "source_name STRING, line BINARY, hi BIGINT, bits BINARY")
    parts = stored(articles.sparkSession, parts, name)
    # A container's array form tells its cardinality by its length; the bit form counts in full.
    most = F.when(F.octet_length("bits") < 8193, (F.octet_length("bits") - 1) / 2).otherwise(F.lit(lines.SPAN))
    often = parts.groupBy("source_name", "line").agg(F.sum(most).alias("most")).where(F.col("most") >= least)

    @F.udf(LongType(), useArrow=True)
    def size(blob: bytes) -> int:
        return lines.cardinality(blob)

    @F.udf(BinaryType(), useArrow=True)
    def union(blobs: list) -> bytes:
        return lines.unite(list(blobs))

    held = parts.join(often, ["source_name", "line"], "left_semi").groupBy("source_name", "line", "hi").agg(union(F.collect_list("bits")).alias("bits")).withColumn("n", size("bits"))
    totals = known.groupBy("source_name").agg(F.countDistinct("id").alias("_all"))
    sums = held.groupBy("source_name", "line").agg(F.sum("n").alias("records"))
    cases = sums.join(totals, "source_name").where((F.col("records") >= least) & (F.col("records") >= share * F.col("_all")))
    return cases.select("source_name", "line", "records"), held.select("source_name", "line", "hi", "bits")


def repeated_lines(articles: DataFrame, least: int = 5, share: float = 0.02, name: str = "p5") -> DataFrame:
    """(source_name, line_md5, records): lines repeated within a source."""
    cases, _ = line_bitmaps(articles, least, share, name)
    return cases.select("source_name", F.lower(F.hex("line")).alias("line_md5"), "records")


def without_lines(articles: DataFrame, least: int = 5, share: float = 0.02, name: str = "p5_text") -> DataFrame:
    """(id, text): each record's blocks without its source's repeated lines, one per line.

    A line is deleted where its bitmap has the record.  Bitmaps of up to ``LOOKED_UP``
    bytes go to every task, so that pages are read in place; larger ones are joined to
    the pages by span of ids and source.  A record without a source or an id keeps all
    its blocks.
    """
    spark = articles.sparkSession
    cases, bitmaps = line_bitmaps(articles, least, share, name)
    gone = stored(spark, bitmaps.join(cases.select("source_name", "line"), ["source_name", "line"], "left_semi"), f"{name}_gone")
    size = gone.agg(F.sum(F.octet_length("bits") + F.octet_length("source_name") + 64).alias("n")).first()["n"] or 0
    pages = articles.select("id", "source_name", "html_content")
    if size <= LOOKED_UP:
        table: dict[tuple[str, int], dict[bytes, bytes]] = {}
        for r in gone.toLocalIterator():
            table.setdefault((r["source_name"], r["hi"]), {})[bytes(r["line"])] = bytes(r["bits"])
        shared = spark.sparkContext.broadcast(table)
    else:
        here = gone.groupBy("source_name", "hi").agg(F.collect_list(F.struct("line", "bits")).alias("here"))
        pages, shared = pages.withColumn("hi", F.shiftright("id", 16)).join(here, ["source_name", "hi"], "left").select("id", "source_name", "html_content", "here"), None

    def run(batches):
        key_of = lines.Keys()
        for batch in batches:
            for at in range(0, batch.num_rows, LINE_PAGES):
                part = batch.slice(at, LINE_PAGES)
                ids, sources, htmls = (part.column(c).to_pylist() for c in range(3))
                texts = []
                for k, (i, source, h) in enumerate(zip(ids, sources, htmls)):
                    if i is None or source is None:
                        found = None
                    elif shared:
                        found = shared.value.get((source, i >> 16))
                    else:
                        found = {x["line"]: x["bits"] for x in part.column(3)[k].as_py() or ()}
                    keep = blocks(h)
                    if found:
                        keep = [b for b in keep if (bits := found.get(key_of[b])) is None or not lines.contains(bits, i & 0xFFFF)]
                    texts.append("\n".join(keep))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return pages.mapInArrow(run, "id BIGINT, text STRING")
