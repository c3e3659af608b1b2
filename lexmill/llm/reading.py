"""Problem 10: reading level of a document.

Every sentence gets a distribution over the levels from a regularised softmax
model of words and of the character trigrams inside words; a document's
distributions are aggregated and a second regularised softmax, fitted on
predictions for documents that the first did not see, gives its level.

Null, blank and short texts and bare result tables have no level.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 5
#: Texts below this many characters have no level.
LEAST_CHARS = 300
#: Most labelled documents that training reads, chosen by a hash of the id.
LABELLED_SAMPLE = 1_500
BUCKETS = 1 << 15
EPOCHS, FOLDS, RATE, DECAY = 6, 2, 0.08, 1e-5
LENGTHS = 10
BATCH = 512

_SENTENCE = re.compile(r"(?<=[.!?…])[\s»”“\"]+|\n+")
_TABLE_LINE = re.compile(r"^\s*(?:\d+[.)]\s|\|).*\d|^\s*\S+(?:\s\S+){0,4}\s[—–-]?\s*\d+:\d+[\d.,:\s()]*$")
_WORD = re.compile(r"[^\W\d_]+")


def has_level(text: str | None) -> bool:
    """Whether a text is long enough and more than a table of results."""
    if text is None or len(text) < LEAST_CHARS or text.isspace():
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    rows = sum(_TABLE_LINE.match(x) is not None for x in lines)
    return rows * 2 < len(lines) or rows < 3


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, in lower case; table rows and sentences without words are left out."""
    out = []
    for s in _SENTENCE.split(text):
        words = _WORD.findall(s.lower())
        if words and not (len(words) < 6 and _TABLE_LINE.match(s)):
            out.append(words)
    return out


def _features(word: str) -> list[int]:
    """Buckets of a word and of its character trigrams."""
    w = f"<{word}>"
    keys = ["\x00" + word, *(w[i : i + 3] for i in range(len(w) - 2)), "\x01" + w[-4:]]
    return [crc32(k.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for k in keys]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _length(n: int) -> int:
    return min(LENGTHS - 1, int(2 * np.log2(n + 1)) - 1 if n < 3 else int(1.7 * np.log2(n)))


class Vocabulary:
    """Words numbered as they come, with their feature buckets."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.features: list[list[int]] = []

    def number(self, words: list[str]) -> list[int]:
        out = []
        for w in words:
            i = self.index.get(w)
            if i is None:
                i = self.index[w] = len(self.features)
                self.features.append(_features(w))
            out.append(i)
        return out


@dataclass
class SentenceModel:
    w: np.ndarray  # BUCKETS x LEVELS
    length: np.ndarray  # LENGTHS x LEVELS


@dataclass
class Model:
    sentence: SentenceModel
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    fitted: bool = True


def _rows(docs: list[list[list[str]]], vocabulary: Vocabulary):
    """Words and sentences of documents laid end to end."""
    ids, starts, lengths, sizes = [], [], [], []
    for d in docs:
        sizes.append(len(d))
        for s in d:
            starts.append(len(ids))
            ids += vocabulary.number(s)
            lengths.append(_length(len(s)))
    return np.array(ids, np.int64), np.array(starts, np.int64), np.array(lengths, np.int64), np.array(sizes, np.int64)


def _word_vectors(vocabulary: Vocabulary, w: np.ndarray, start: int = 0) -> np.ndarray:
    """Sum of the weights of each word's features, over the root of their number."""
    f = vocabulary.features[start:]
    if not f:
        return np.zeros((0, LEVELS), np.float32)
    n = np.array([len(x) for x in f], np.int64)
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    return np.add.reduceat(w[np.concatenate([np.array(x) for x in f])], at) / np.sqrt(n)[:, None]


def fit_sentences(docs: list[list[list[str]]], levels: np.ndarray) -> SentenceModel:
    """Softmax on sentences with their document's level, by averaged gradient steps."""
    rng = np.random.default_rng(11)
    v = Vocabulary()
    ids, starts, lengths, sizes = _rows(docs, v)
    target = np.repeat(levels - 1, sizes)
    # A document's sentences share its weight, damped so that long texts tell more.
    weight = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
    weight = (weight / weight.mean()).astype(np.float32) if len(weight) else weight
    # Features of every sentence, laid end to end, with their values.
    per_word = np.array([len(x) for x in v.features], np.int64)
    of_word = np.concatenate([np.array(x) for x in v.features]) if v.features else np.zeros(0, np.int64)
    words = np.diff(np.append(starts, len(ids)))
    m = per_word[ids]
    flat_all = of_word[np.repeat(np.cumsum(per_word)[ids] - np.cumsum(m), m) + np.arange(m.sum())]
    unit_all = np.repeat(1 / (np.sqrt(m) * np.repeat(np.sqrt(words), words)), m).astype(np.float32)
    size_all = np.add.reduceat(m, starts) if len(starts) else m
    end_all = np.cumsum(size_all)
    w = np.zeros((BUCKETS, LEVELS), np.float32)
    b = np.zeros((LENGTHS, LEVELS), np.float32)
    g2w, g2b = np.full_like(w, 1e-4), np.full_like(b, 1e-4)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(starts))
        rate = RATE * (1 - 0.8 * epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            size = size_all[rows]
            ends = np.cumsum(size)
            at_all = np.repeat(end_all[rows] - ends, size) + np.arange(ends[-1])
            flat, unit = flat_all[at_all], unit_all[at_all]
            per = np.add.reduceat(w[flat] * unit[:, None], ends - size)
            p = _softmax(per + b[lengths[rows]])
            p[np.arange(len(rows)), target[rows]] -= 1
            p *= weight[rows][:, None] / len(rows)
            owner = np.repeat(np.arange(len(rows)), size)
            gf = p[owner] * unit[:, None]
            o = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.diff(flat[o], prepend=-1))
            which = flat[o][first]
            g = np.add.reduceat(gf[o], first) + DECAY * w[which]
            g2w[which] += g * g
            w[which] -= rate * g / np.sqrt(g2w[which])
            gb = np.zeros_like(b)
            np.add.at(gb, lengths[rows], p)
            g2b += gb * gb
            b -= rate * gb / np.sqrt(g2b)
    return SentenceModel(w, b)


def aggregate(probabilities: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Document features: mean distribution, shares of likeliest levels, mean length class."""
    out = np.zeros((len(sizes), 2 * LEVELS + 2), np.float64)
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    have = sizes > 0
    if have.any():
        n = sizes[have][:, None]
        out[have, :LEVELS] = np.add.reduceat(probabilities, at[have]) / n
        top = np.eye(LEVELS)[probabilities.argmax(1)] if len(probabilities) else np.zeros((0, LEVELS))
        out[have, LEVELS : 2 * LEVELS] = np.add.reduceat(top, at[have]) / n
        out[have, -2] = np.add.reduceat(lengths.astype(np.float64), at[have]) / n[:, 0]
        out[have, -1] = 1 / np.sqrt(n[:, 0])
    return out


class Scorer:
    """Documents to levels; words' vectors are looked up."""

    def __init__(self, model: Model, memory: int = 400_000):
        self.model, self.memory = model, memory
        self._reset()

    def _reset(self):
        self.v, self.vectors = Vocabulary(), np.zeros((0, LEVELS), np.float32)

    def features(self, docs: list[list[list[str]]]) -> np.ndarray:
        if len(self.v.features) > self.memory:
            self._reset()
        ids, starts, lengths, sizes = _rows(docs, self.v)
        if len(self.v.features) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, _word_vectors(self.v, self.model.sentence.w, len(self.vectors))])
        if not len(starts):
            return aggregate(np.zeros((0, LEVELS)), lengths, sizes)
        n = np.diff(np.append(starts, len(ids)))
        logits = np.add.reduceat(self.vectors[ids], starts) / np.sqrt(n)[:, None] + self.model.sentence.length[lengths]
        return aggregate(_softmax(logits), lengths, sizes)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Level 1 to 5 of each text, 0 where it has none."""
        out = np.zeros(len(texts), np.int64)
        at = [i for i, t in enumerate(texts) if has_level(t)]
        if not at or not self.model.fitted:
            return out
        docs = [sentences(texts[i]) for i in at]
        x = self.features(docs)
        p = _predict(self.model, x)
        out[at] = np.where([len(d) > 0 for d in docs], p.argmax(1) + 1, 0)
        return out


def _predict(m: Model, x: np.ndarray) -> np.ndarray:
    z = np.concatenate([(x - m.mean) / m.scale, np.ones((len(x), 1))], 1)
    return _softmax(z @ m.weights)


def fit(texts: list[str], levels: list[float]) -> Model:
    """Sentence model, and the document model on out-of-fold sentence predictions."""
    pairs = [(sentences(t), y) for t, y in zip(texts, levels) if has_level(t)]
    pairs = [(d, y) for d, y in pairs if d]
    if len(pairs) < 2 * FOLDS:
        empty = SentenceModel(np.zeros((1, 1), np.float32), np.zeros((1, 1), np.float32))
        return Model(empty, np.zeros(1), np.ones(1), np.zeros((1, 1)), False)
    docs = [d for d, _ in pairs]
    y = np.array([v for _, v in pairs], np.float64)
    hard = np.clip(np.floor(y + 0.5), 1, LEVELS).astype(np.int64)
    fold = np.arange(len(docs)) % FOLDS
    x = np.zeros((len(docs), 2 * LEVELS + 2))
    for k in range(FOLDS):
        part = fit_sentences([d for d, f in zip(docs, fold) if f != k], hard[fold != k])
        x[fold == k] = Scorer(Model(part, np.zeros(1), np.ones(1), np.zeros((1, 1)))).features([d for d, f in zip(docs, fold) if f == k])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    # Raters differ by one: a label between two levels is split over them.
    low = np.clip(np.floor(y), 1, LEVELS).astype(int)
    t = np.zeros((len(y), LEVELS))
    t[np.arange(len(y)), low - 1] += 1 - (y - low)
    t[np.arange(len(y)), np.minimum(low, LEVELS - 1)] += np.where(low < LEVELS, y - low, 0)
    w = np.zeros((z.shape[1], LEVELS))
    lam = np.full(z.shape[1], 0.003)
    lam[-1] = 0
    for step in range(1500):
        g = z.T @ (_softmax(z @ w) - t) / len(z) + lam[:, None] * w
        w -= 0.5 * g
    return Model(fit_sentences(docs, hard), mean, scale, w)


def training(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[float]]:
    """Bounded sample of labelled texts; a document's labels are averaged, null ones left out."""
    given = labels.where(F.col("level").isNotNull()).groupBy("doc_id").agg(F.avg("level").alias("level"))
    n = given.count()
    part = 1 << 30
    key = F.pmod(F.xxhash64("doc_id", F.lit("reading")), F.lit(part))
    share = min(part, int(part * LABELLED_SAMPLE / max(n, 1)) + 1)
    picked = given.where(key < share).limit(2 * LABELLED_SAMPLE)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(picked, "doc_id").select("doc_id", "text", "level").collect()
    rows = sorted({(r["doc_id"], r["text"], r["level"]) for r in rows})
    return [r[1] for r in rows], [r[2] for r in rows]


def levels(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, level): one row per row of ``docs``; level is null where a text has none."""
    model = spark.sparkContext.broadcast(fit(*training(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                got = score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.int32(), mask=got == 0)], ["doc_id", "level"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id BIGINT, level INT")
