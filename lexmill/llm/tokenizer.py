"""Problem 8: byte-level BPE of a public rank file, in batched numpy merge rounds.

A text is split by the tokenizer's pattern; the distinct words that a task has
not met yet are encoded together: the symbols of all of them lie in one flat
array, pairs are ranked by binary search over the sorted keys of all mergeable
pairs, and each round merges every word's pair of lowest rank.  Strings of special
tokens are ordinary text.

Null and empty texts have the empty list of ids; ids are those of the rank file.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Rank file; a parameter everywhere, never copied into the repository.
RANKS = os.environ.get("LEXMILL_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a task remembers.
REMEMBERED = 500_000
_NONE = np.int64(1) << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Encoder:
    """Text to ids under one rank file."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        ranks = load_ranks(path)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = max(ranks.values()) + 1
        keys, merged = [], []
        for token, r in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a * self.base + b)
                    merged.append(r)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.split = regex.compile(pattern).findall
        self.known: dict[str, np.ndarray] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a * self.base + b
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.merged[at], _NONE)

    def words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words, all merged together.

        A round merges, in every word, the pair of lowest rank wherever it stands, from
        the left, as far as no pair that this makes ranks lower still (that one is the
        next round's).  So the rounds of a word are as many as the kinds of pairs that
        are merged in it, and a very long word takes no round per symbol.
        """
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [np.zeros(0, np.int32)] * len(words)
        live = np.flatnonzero(np.fromiter(map(len, raw), np.int64, len(raw)))
        flat = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        sizes = np.array([len(raw[i]) for i in live.tolist()], np.int64)
        ends = np.cumsum(sizes)
        # Rank of the pair that begins at each symbol; a word's last symbol begins none.
        rank = np.full(len(flat), _NONE)
        rank[:-1] = self._rank(flat[:-1], flat[1:])
        rank[ends - 1] = _NONE
        while len(live):
            starts = ends - sizes
            best = np.minimum.reduceat(rank, starts)
            done = best == _NONE
            if done.any():
                for i in np.flatnonzero(done).tolist():
                    out[live[i]] = flat[starts[i] : ends[i]].astype(np.int32)
                keep = np.repeat(~done, sizes)
                flat, rank = flat[keep], rank[keep]
                live, sizes, best = live[~done], sizes[~done], best[~done]
                ends = np.cumsum(sizes)
                if not len(live):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            # In a run of pairs that overlap every second one is merged.
            follows = np.concatenate([[False], np.diff(hit) == 1])
            lead = np.maximum.accumulate(np.where(follows, 0, np.arange(len(hit))))
            hit = hit[(np.arange(len(hit)) - lead) % 2 == 0]
            word = np.searchsorted(ends, hit, side="right")
            made = best[word]
            # Pairs made with the neighbours: the left one may be merged itself by then, the right one is not yet.
            first, last = hit == (ends - sizes)[word], hit + 2 >= ends[word]
            left = np.where(np.concatenate([[False], hit[1:] - hit[:-1] == 2]) & ~first, made, flat[np.maximum(hit - 1, 0)])
            lower = (~last & (self._rank(made, flat[np.minimum(hit + 2, len(flat) - 1)]) < made)) | (~first & (self._rank(left, made) < made))
            if lower.any():
                # Up to and with the first such merge of a word; what follows waits.
                before = np.cumsum(lower) - lower
                opens = np.concatenate([[True], word[1:] != word[:-1]])
                base = before[np.maximum.accumulate(np.where(opens, np.arange(len(hit)), 0))]
                ok = before == base
                hit, word, made = hit[ok], word[ok], made[ok]
            flat[hit] = made
            keep = np.ones(len(flat), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # places of the merged symbols in what is kept
            flat, rank = flat[keep], rank[keep]
            sizes = sizes - np.bincount(word, minlength=len(sizes))
            ends = np.cumsum(sizes)
            touched = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[touched] = _NONE
            touched = touched[touched + 1 < len(flat)]
            rank[touched] = self._rank(flat[touched], flat[touched + 1])
            rank[ends - 1] = _NONE
        return out

    def _look_up(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of the distinct words, every word's index among them, and words of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        index: dict[str, int] = {}
        number = index.setdefault
        seq: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                parts = self.split(t)
                counts[i] = len(parts)
                seq += [number(w, len(index)) for w in parts]
        fresh = [w for w in index if w not in self.known]
        for at in range(0, len(fresh), 50_000):
            part = fresh[at : at + 50_000]
            self.known.update(zip(part, self.words(part)))
        return [self.known[w] for w in index], np.array(seq, np.int64), counts

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of texts laid end to end."""
        per, seq, counts = self._look_up(texts)
        lengths = np.array([len(x) for x in per], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if per else np.zeros(0, np.int64)
        pool = np.concatenate(per) if per else np.zeros(0, np.int32)
        n = lengths[seq]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(starts[seq] - (ends - n), n) + np.arange(total)
        return np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]).astype(np.int64), pool[where]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        per, seq, counts = self._look_up(texts)
        n = np.array([len(x) for x in per], np.int64)[seq] if len(seq) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        return np.diff(ends, prepend=0)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and rank file; a worker serves many tasks."""
    return Encoder(path)


#: Characters of one step: bounds the working arrays whatever the texts' lengths.
STEP_CHARS = 2_000_000


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size > STEP_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of every document, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _steps(texts):
                offsets, ids = enc.texts(texts[lo:hi])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} BIGINT, ids ARRAY<INT>")


def count(docs: DataFrame, path: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens): only the numbers of ids leave the workers; ``id_col`` may be of any type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in _steps(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(enc.counts(texts[lo:hi]))], [id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens BIGINT")
