"""Problem 5: lines repeated within a source, counted by compressed bitmaps.

A line is a block reduced to its letters in lower case; its records are held as
bitmaps over record ids, cut into containers of 65,536 ids: a sorted array of
16-bit offsets while small, a bit vector beyond.  Variants of a line share its
reduced form, and their bitmaps are united.  Whether a record has a line is looked up
in the bitmap again when the line is deleted.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from hashlib import md5

import numpy as np

from lexmill.llm.terms import letter_runs

SPAN = 1 << 16
#: Offsets up to which a container is an array.
ARRAY_MOST = 4096


def reduced(block: str) -> str:
    return "".join(letter_runs(block)).lower()


def line_key(line: str) -> bytes:
    return md5(line.encode("utf-8", "surrogatepass")).digest()


class Keys(dict):
    """Line key of a block, b'' without letters; short blocks, which repeat, are remembered within a bound."""

    SHORT, MOST = 100, 50_000

    def __missing__(self, block: str) -> bytes:
        line = reduced(block)
        key = line_key(line) if line else b""
        if len(block) <= self.SHORT:
            if len(self) >= self.MOST:
                self.clear()
            self[block] = key
        return key


def pack(offsets: np.ndarray) -> bytes:
    """Container of sorted, distinct 16-bit offsets."""
    if len(offsets) <= ARRAY_MOST:
        return b"a" + offsets.astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[offsets] = 1
    return b"b" + np.packbits(bits, bitorder="little").tobytes()


def unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"a":
        return np.frombuffer(blob, "<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, offset=1), bitorder="little")).astype("<u2")


def unite(blobs: list[bytes]) -> bytes:
    """Union of containers; a single one comes back as it is."""
    if len(blobs) == 1:
        return blobs[0]
    if any(b[:1] == b"b" for b in blobs) or sum(map(len, blobs)) > 4 * ARRAY_MOST:
        bits = np.zeros(SPAN, bool)
        for b in blobs:
            bits[unpack(b)] = True
        return pack(np.flatnonzero(bits))
    return pack(np.unique(np.concatenate([unpack(b) for b in blobs])))


def cardinality(blob: bytes) -> int:
    return (len(blob) - 1) // 2 if blob[:1] == b"a" else int(np.unpackbits(np.frombuffer(blob, np.uint8, offset=1)).sum())


def contains(blob: bytes, offset: int) -> bool:
    if blob[:1] == b"a":
        offsets = memoryview(blob)[1:].cast("H")
        at = bisect_left(offsets, offset)
        return at < len(offsets) and offsets[at] == offset
    return bool(blob[1 + (offset >> 3)] >> (offset & 7) & 1)


class Occurrences:
    """(source, line, record) rows of a task as numbers, 28 bytes each, until they are packed into containers."""

    def __init__(self):
        self.sources: dict[str, int] = {}
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, rows: Iterable[tuple[int, str, set[bytes]]]) -> None:
        """Rows (record, source, line keys) of one chunk."""
        ids, sources, sizes, keys = [], [], [], []
        for i, source, lines in rows:
            ids.append(i)
            sources.append(self.sources.setdefault(source, len(self.sources)))
            sizes.append(len(lines))
            keys += lines
        if keys:
            self.held.append((np.repeat(np.array(sources, np.int32), sizes), np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2), np.repeat(np.array(ids, np.int64), sizes)))
            self.size += len(keys)

    def drain(self) -> tuple[list[str], np.ndarray, list[bytes], np.ndarray, list[bytes]]:
        """(names, source numbers, lines, spans of ids, containers), one row per line and span; everything held is gone then."""
        names = list(self.sources)
        if not self.held:
            return names, np.zeros(0, np.int32), [], np.zeros(0, np.int64), []
        source, key, ids = (np.concatenate(c) for c in zip(*self.held))
        self.held, self.size, self.sources = [], 0, {}
        order = np.lexsort((ids, key[:, 1], key[:, 0], source))
        source, key, ids = source[order], key[order], ids[order]
        span, low = ids >> 16, (ids & 0xFFFF).astype("<u2")
        same = (source[1:] == source[:-1]) & (key[1:] == key[:-1]).all(1) & (span[1:] == span[:-1])
        keep = np.concatenate([[True], ~(same & (low[1:] == low[:-1]))])  # a record's second row
        starts = np.flatnonzero(np.concatenate([[True], ~same])[keep])
        source, key, span, low = source[keep][starts], key[keep][starts], span[keep][starts], low[keep]
        ends = np.append(starts[1:], len(low))
        raw, flat = key.astype(">u8").tobytes(), low.tobytes()
        bits = [b"a" + flat[2 * a : 2 * b] if b - a <= ARRAY_MOST else pack(low[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        return names, source, [raw[k : k + 16] for k in range(0, len(raw), 16)], span, bits
