"""Problem 7: text read in a wrong encoding.

A smoothed character trigram model is fitted on clean records (blocks
that pass a screen of scripts, case and stray signs).  Every block that the model finds odd
is tried against all chains of one or two encode-decode steps; the likeliest
result is accepted where it beats the block as it stands by a margin that was
validated on held-out clean blocks.

Blocks are restored in source form, before references are decoded and
whitespace is treated, because garbling happened to the page's bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np

from lexmill.llm.blocks import clean

#: Most characters that get a class of their own; rarer ones share by script.
ALPHABET = 120
SMOOTHING = 0.02
#: One distinct block in so many is held out, by a checksum of its text.
HELD = 5
#: Least margin; share of the held-out gains that it lies above, and by which factor.
MARGIN_LEAST, MARGIN_QUANTILE, MARGIN_FACTOR = 5.0, 0.997, 1.2
#: How far above the likeliest garbled text the gate lies, in nats a character.
GATE_ABOVE = 0.5
#: Prices of a rare code page in a chain and of a second step, in nats.
RARE, SECOND = 5.0, 1.0
#: Share, and least number, of a text's trigrams that are looked at before the others.
HEAD, HEAD_LEAST = 0.3, 12
LOST = "�"

# Encodings a page may have been read in, and written in.
READ_AS = ("cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac-roman", "mac-cyrillic", "iso8859-5", "cp1250", "iso8859-2", "cp437", "cp850")
COMMON = ("utf-8", "cp1252", "latin-1", "cp1251", "koi8-r", "cp866", "mac-roman")
WRITTEN_IN = ("utf-8", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic", "cp1252")
# Fixed values: (written in, read as) of the artificial garbling that sets the gate.
SPOILERS = (("utf-8", "cp1252"), ("utf-8", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("utf-8", "mac-roman"))


def _encode_table(name: str) -> dict[int, int]:
    """Character to byte; bytes the code page leaves out map to the C1 control."""
    table = {}
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            table[b] = b
    for b in range(128, 160):
        table.setdefault(b, b)
    return table


_TABLES = {name: _encode_table(name) for name in READ_AS}
#: Byte of every UTF-16 unit in every code page, 256 where it has none.
_BYTE_OF = np.full((len(READ_AS), 1 << 16), 256, np.uint16)
_BYTE_OF[:, :128] = np.arange(128)
for _k, _name in enumerate(READ_AS):
    for _c, _b in _TABLES[_name].items():
        _BYTE_OF[_k, _c] = _b
_FROM_BYTES = {name: {b: chr(b) for b in range(256)} | {b: chr(c) for c, b in t.items()} for name, t in _TABLES.items()}


def _units(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16)


def _as_bytes(text: str, name: str) -> bytes | None:
    row = _BYTE_OF[READ_AS.index(name), _units(text)]
    return None if (row > 255).any() else row.astype(np.uint8).tobytes()


def steps(text: str) -> dict[str, tuple[str, str]]:
    """Results of every single encode-decode step that loses nothing."""
    out: dict[str, tuple[str, str]] = {}
    rows = _BYTE_OF[:, _units(text)]
    for k in np.flatnonzero((rows < 256).all(1)).tolist():
        a, raw = READ_AS[k], rows[k].astype(np.uint8).tobytes()
        for b in WRITTEN_IN:
            if a == b:
                continue
            try:
                got = raw.decode(b)
            except UnicodeDecodeError:
                continue
            if got != text:
                out.setdefault(got, (a, b))
    return out


def chains(text: str) -> dict[str, tuple]:
    """Results of chains of one or two steps; a second step follows UTF-8 only."""
    first = steps(text)
    out: dict[str, tuple] = {t: (c,) for t, c in first.items()}
    for t, c in first.items():
        if c[1] == "utf-8" and not t.isascii():
            for t2, c2 in steps(t).items():
                out.setdefault(t2, (c, c2))
    return out


@lru_cache(8192)
def price(chain: tuple) -> float:
    """Nats that a chain must make up for: rare code pages and second steps."""
    return sum(RARE * (a not in COMMON) + RARE * (b not in COMMON) for a, b in chain) + SECOND * (len(chain) - 1)


def _script(cp: int) -> int:
    """Class of a character without one of its own."""
    if cp < 0xA0:
        return 0 if cp < 0x80 else 1
    if cp < 0xC0:
        return 2
    if cp < 0x250:
        return 3
    if 0x400 <= cp < 0x530:
        return 4
    if 0x2500 <= cp < 0x25A0:
        return 5
    if cp == 0xFFFD:
        return 6
    return 7


SHARED = 8
#: About how many characters each shared class stands for.
SHARED_SIZES = np.array([96, 32, 32, 400, 200, 160, 1, 5000], np.float64)


@dataclass
class Model:
    classes: np.ndarray  # code point to class, BMP
    table: np.ndarray  # log p(c | a, b), flattened
    size: int
    gate: float = -1e9
    margin: float = 0.0

    def totals(self, texts: list[str]) -> np.ndarray:
        """Log likelihoods, both ends of every text padded by spaces; all in one pass."""
        c = self.classes[_units("".join([f"  {t} " for t in texts]))]
        p = self.table[(c[:-2] * self.size + c[1:-1]) * self.size + c[2:]]
        sizes = np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
        sums = np.concatenate([[0.0], np.cumsum(p, dtype=np.float64)])
        return sums[starts + sizes + 1] - sums[starts]

    def means(self, texts: list[str]) -> np.ndarray:
        """Mean log likelihood over the non-ASCII characters and their followers.

        Many texts in one pass; 0 for a text that is all ASCII.
        """
        if not texts:
            return np.zeros(0)
        joined = "  " + " \x00  ".join(texts) + " "
        cp = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        c = self.classes[cp]
        wide = cp > 127
        wide[1:] |= wide[:-1].copy()
        p = self.table[(c[:-2] * self.size + c[1:-1]) * self.size + c[2:]] * wide[2:]
        lengths = np.array([len(t) if t.isascii() else len(t.encode("utf-16-le", "surrogatepass")) // 2 for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths + 4)[:-1]])
        ends = starts + lengths + 1
        sums = np.concatenate([[0.0], np.cumsum(p, dtype=np.float64)])
        many = np.concatenate([[0], np.cumsum(wide[2:])])
        return (sums[ends] - sums[starts]) / np.maximum(many[ends] - many[starts], 1)


def _padded(texts: list[str]) -> np.ndarray:
    return _units("".join([f"  {t} " for t in texts]))


def _sizes(texts: list[str]) -> np.ndarray:
    """Units of every padded text."""
    return np.array([len(t.encode("utf-16-le", "surrogatepass")) // 2 + 3 for t in texts], np.int64)


def character_counts(texts: list[str], times: np.ndarray) -> np.ndarray:
    """Counts of every character of texts that occur so many times."""
    return np.bincount(_padded(texts), np.repeat(times, _sizes(texts)), 65536).astype(np.int64)


def alphabet(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """Class of every character and the number of classes, from the counts of all texts."""
    best = np.argsort(-counts, kind="stable")[:ALPHABET]
    best = np.sort(best[counts[best] > 0])
    classes = np.fromiter((_script(c) for c in range(65536)), np.int32, 65536)
    classes[best] = SHARED + np.arange(len(best))
    return classes, SHARED + len(best)


def trigram_counts(texts: list[str], times: np.ndarray, classes: np.ndarray, size: int) -> np.ndarray:
    """Counts of every trigram of classes, flattened; the same however the texts are dealt out."""
    c = classes[np.append(_padded(texts), [32, 32])].astype(np.int64)
    return np.bincount((c[:-2] * size + c[1:-1]) * size + c[2:], np.repeat(times, _sizes(texts)), size**3).astype(np.int64)


def smoothed(classes: np.ndarray, size: int, tri: np.ndarray) -> Model:
    tri = tri.reshape(size, size, size).astype(np.float64)
    bi = tri.sum(0)
    uni = bi.sum(0)
    p1 = (uni + 0.5) / (uni + 0.5).sum()
    p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
    p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
    table = np.log((1 - SMOOTHING) * p3 + SMOOTHING * p1)
    table[:, :, :SHARED] -= np.log(SHARED_SIZES)  # a class's share is spread over its characters
    table = table.astype(np.float32)
    return Model(classes, table.ravel(), size)


def best_chain(raw: str, model: Model) -> tuple[float, str | None]:
    """Gain in log likelihood of the likeliest chain, and its result."""
    found = chains(raw)
    if not found:
        return 0.0, None
    texts = list(found)
    got = model.totals([raw, *texts])
    own, got = float(got[0]), got[1:] - np.fromiter(map(price, found.values()), np.float64, len(texts))
    mixed = len(_MIXED.findall(raw))
    for k in np.argsort(-got, kind="stable").tolist():
        if got[k] <= own:
            break
        if len(_MIXED.findall(texts[k])) <= mixed:  # no reading makes words of two scripts
            return float(got[k]) - own, texts[k]
    return 0.0, None


def _utf8(raw: np.ndarray, starts: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Those of the texts ``among`` whose bytes are UTF-8; each starts at ``starts``, has a byte above 127 and ends before the next."""
    wide = np.flatnonzero(raw > 127)
    first = wide[np.searchsorted(wide, starts[among])]
    among = among[(raw[first] >= 0xC2) & (raw[first] <= 0xF4) & (raw[first + 1] & 0xC0 == 0x80)]
    ends = np.append(starts, len(raw))
    good = []
    for i in among.tolist():
        try:
            raw[starts[i] : ends[i + 1]].astype(np.uint8).tobytes().decode("utf-8")
            good.append(i)
        except UnicodeDecodeError:
            pass
    return np.array(good, np.int64)


#: Character of every byte in every single-byte encoding that a page may be written in, -1 where it has none.
_CHARACTER_OF = {
    name: np.array([ord(c) if (c := bytes([b]).decode(name, "replace")) != LOST else -1 for b in range(256)], np.int32) for name in WRITTEN_IN if name != "utf-8"
}


def may_gain(texts: list[str], model: Model) -> np.ndarray:
    """Mask of texts that a chain may make likelier; for the others ``best_chain`` is sure to gain nothing.

    All texts are tried at once with single steps between single-byte encodings, whose
    prices are left out; readings as UTF-8, and with them all chains of two steps, count
    as possible gains.  Log likelihoods only fall from character to character, so the
    beginnings of texts sort out most.  Texts are not ASCII.
    """
    out = np.zeros(len(texts), bool)
    if not texts:
        return out
    own, units = model.totals(texts), _padded(texts)
    sizes = _sizes(texts)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for k, a in enumerate(READ_AS):
        raw = _BYTE_OF[k, units]
        fits = np.flatnonzero(np.add.reduceat(raw > 255, starts, dtype=np.int64) == 0)
        if len(fits):
            out[_utf8(raw, starts, fits)] = True
            for b in _CHARACTER_OF:
                left = fits[~out[fits]]
                if a != b and len(left):
                    lengths = sizes[left] - 2
                    heads = np.minimum(lengths, np.maximum(HEAD_LEAST, (lengths * HEAD).astype(np.int64)))
                    near = _read(raw, b, starts[left], heads, model) > own[left] - 0.01
                    left, lengths = left[near], lengths[near]
                    if len(left):
                        at, firsts = _spans(starts[left], lengths + 1)
                        other = np.logical_or.reduceat(_CHARACTER_OF[b][np.minimum(raw[at], 255)] != units[at], firsts)
                        left, lengths = left[other], lengths[other]
                    if len(left):
                        out[left[_read(raw, b, starts[left], lengths, model) > own[left] - 0.01]] = True
    return out


def _spans(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all units of spans, and where each span begins among them."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths), ends - lengths


def _read(raw: np.ndarray, written: str, starts: np.ndarray, lengths: np.ndarray, model: Model) -> np.ndarray:
    """Log likelihoods of the first so many trigrams of texts, given by their bytes, if those are read as ``written``."""
    at, firsts = _spans(starts, lengths)
    characters = _CHARACTER_OF[written]
    c = model.classes[np.maximum(characters, 0)]
    x, y, z = raw[at], raw[at + 1], raw[at + 2]
    p = model.table[(c * model.size**2)[x] + (c * model.size)[y] + c[z]]
    gone = (characters < 0)[z]
    if gone.any():
        p[gone] = -1e4
    return np.add.reduceat(p, firsts, dtype=np.float64)


def gains(texts: list[str], model: Model) -> np.ndarray:
    """Gain of ``best_chain`` for every text; texts are not ASCII."""
    out = np.zeros(len(texts))
    for i in np.flatnonzero(may_gain(texts, model)).tolist():
        out[i] = best_chain(texts[i], model)[0]
    return out


_MIXED = re.compile("[A-Za-z\u00c0-\u024f][\u0400-\u052f]|[\u0400-\u052f][A-Za-z\u00c0-\u024f]")
_LETTER = re.compile(r"[^\W\d_]")
_ACCENTED = re.compile("[\u00aa-\u024f]")
_RUSSIAN = re.compile("[А-Яа-яЁё]")
_CYRILLIC = re.compile("[\u0400-\u052f]")
_CAPITAL = re.compile("[\u0400-\u042f]")
_ODD_CASE = re.compile(r"[a-zа-яё][A-ZА-ЯЁ]")
_INVERTED = re.compile(r"(?<![^\W\d_])[a-zа-яё][A-ZА-ЯЁ]{2,}")
_ODD_SIGN = re.compile("[\x80-\x9f\u00a1-\u00a8\u00aa\u00ac-\u00af\u00b1-\u00ba\u00bc-\u00bf\u02c0-\u02df\u2020-\u2022\u2200-\u23ff\u2500-\u25ff\ufffd]")


def looks_clean(text: str) -> bool:
    """Screen for training text: scripts and case as in any written language.

    At most 30 % accented among the letters, at most 20 % of the Cyrillic ones
    outside the Russian alphabet, no words of two scripts or of inverted case, few
    capitals inside words, few stray signs, and no reading of the text as UTF-8 bytes.
    """
    if text.isascii():
        return True
    letters = len(_LETTER.findall(text))
    cyrillic = len(_CYRILLIC.findall(text))
    if (
        len(_ACCENTED.findall(text)) > 0.3 * letters
        or cyrillic - len(_RUSSIAN.findall(text)) > 0.2 * cyrillic
        or len(_ODD_CASE.findall(text)) > 0.03 * letters
        or _INVERTED.search(text)
        or _MIXED.search(text)
        or len(_ODD_SIGN.findall(text)) > 0.02 * len(text)
    ):
        return False
    for a in ("cp1252", "cp1251", "mac-roman"):
        raw = _as_bytes(text, a)
        if raw is not None:
            try:
                raw.decode("utf-8")
                return False
            except UnicodeDecodeError:
                pass
    return True


@lru_cache(1)
def _signs() -> dict[str, np.ndarray]:
    """Flags of every UTF-16 unit for the screen."""
    every = "".join(map(chr, range(65536)))
    out = {}
    for name, pattern in (("letter", _LETTER), ("accented", _ACCENTED), ("russian", _RUSSIAN), ("cyrillic", _CYRILLIC), ("odd", _ODD_SIGN), ("latin", re.compile("[A-Za-z\u00c0-\u024f]")), ("low", re.compile("[a-zа-яё]")), ("high", re.compile("[A-ZА-ЯЁ]"))):
        out[name] = np.zeros(65536, bool)
        out[name][[ord(c) for c in pattern.findall(every)]] = True
    return out


def clean_mask(texts: list[str]) -> np.ndarray:
    """``looks_clean`` of many texts in one pass."""
    out = np.ones(len(texts), bool)
    at = np.array([i for i, t in enumerate(texts) if not t.isascii()], np.int64)
    if not len(at):
        return out
    units, flags = _padded([texts[i] for i in at.tolist()]), _signs()
    lengths = _sizes([texts[i] for i in at.tolist()]) - 3
    starts = np.concatenate([[0], np.cumsum(lengths + 3)[:-1]])
    count = lambda mask: np.add.reduceat(mask, starts, dtype=np.int64)
    letter, low, high = (flags[n][units] for n in ("letter", "low", "high"))
    latin, cyrillic_ = flags["latin"][units], flags["cyrillic"][units]
    letters, cyrillic = count(letter), count(cyrillic_)
    mixed = np.zeros(len(units), bool)
    mixed[:-1] = (latin[:-1] & cyrillic_[1:]) | (cyrillic_[:-1] & latin[1:])
    odd_case = np.zeros(len(units), bool)
    odd_case[:-1] = low[:-1] & high[1:]
    inverted = np.zeros(len(units), bool)
    inverted[1:-2] = odd_case[1:-2] & high[3:] & ~letter[:-3]
    bad = (
        (count(flags["accented"][units]) > 0.3 * letters)
        | (cyrillic - count(flags["russian"][units]) > 0.2 * cyrillic)
        | (count(odd_case) > 0.03 * letters)
        | (count(inverted) > 0)
        | (count(mixed) > 0)
        | (count(flags["odd"][units]) > 0.02 * lengths)
    )
    for a in ("cp1252", "cp1251", "mac-roman"):
        raw = _BYTE_OF[READ_AS.index(a), units]
        bad[_utf8(raw, starts, np.flatnonzero(~bad & (count(raw > 255) == 0)))] = True
    out[at] = ~bad
    for i in at[count((units >= 0xD800) & (units < 0xE000)) > 0].tolist():  # characters of two units
        out[i] = looks_clean(texts[i])
    return out


def _cased(record: list[str]) -> bool:
    """Whether a record with Cyrillic letters has a capital among them; capitals read in a wrong encoding become small letters."""
    text = "\n".join(record)
    return _CYRILLIC.search(text) is None or _CAPITAL.search(text) is not None


def training_blocks(records: list[list[str]]) -> Counter[str]:
    """Blocks, and how often they occur, of the records (block sources each) all of whose blocks look clean and that have capitals."""
    every = list(dict.fromkeys(t for r in records for t in r))
    good = {t for t, ok in zip(every, clean_mask(every)) if ok}
    return Counter(t for r in records if good.issuperset(r) and _cased(r) for t in r if len(t) >= 3)


def held_out(text: str) -> bool:
    return crc32(text.encode("utf-8", "surrogatepass")) % HELD == 0


def odds(held: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Gains of held-out blocks that are not ASCII, and mean log likelihoods of their artificially garbled forms."""
    wide = [t for t in held if not t.isascii()]
    spoilt = [g for t in wide for g in [_spoil(t, crc32(t.encode("utf-8", "surrogatepass")) // HELD)] if g and g != t]
    return gains(wide, model), model.means(spoilt)


def bounded(model: Model, gain: float | None, spoilt: float | None, usual: Callable[[], float]) -> Model:
    """The model with its margin, by the held-out gains' quantile, and its gate above all garbled forms (``usual()`` where there are none)."""
    model.margin = MARGIN_LEAST if gain is None else max(MARGIN_LEAST, MARGIN_FACTOR * gain)
    model.gate = spoilt + GATE_ABOVE if spoilt is not None else usual()
    return model


def fit(records: list[list[str]]) -> Model:
    """Fit on records (block sources each) all of whose blocks look clean.

    Every occurrence counts.  A fifth of the distinct blocks is held out: the margin lies above all their gains but the uppermost
    0.3 %, the gate above all their artificially garbled forms.  ``pages.fit_encoding``
    does the same over a table.
    """
    good = training_blocks(records) or Counter(["abc abc"])
    held = [t for t in good if held_out(t)]
    taught = [t for t in good if not held_out(t)] or held
    times = np.array([good[t] for t in taught])
    classes, size = alphabet(character_counts(taught, times))
    model = smoothed(classes, size, trigram_counts(taught, times, classes, size))
    got, spoilt = odds(held, model)
    return bounded(model, float(np.quantile(got, MARGIN_QUANTILE)) if len(got) else None, float(spoilt.max()) if len(spoilt) else None, lambda: float(np.quantile(model.means(held or taught), 0.05)))


def _spoil(text: str, k: int) -> str | None:
    """The text garbled by the k-th of some usual chains; None where it can't be."""
    written, read = SPOILERS[k % len(SPOILERS)]
    try:
        raw = text.encode(written)
        return "".join(_FROM_BYTES[read][b] for b in raw)
    except UnicodeEncodeError:
        return None


def restore(raw: str, model: Model) -> str | None:
    """The restored source, or None where no chain wins by the margin."""
    gain, text = best_chain(raw, model)
    return text if text is not None and gain >= model.margin else None


def lost(raw: str) -> bool:
    """Whether characters of the block are gone: U+FFFD, or words that are all question marks."""
    if LOST in raw:
        return True
    if "??" not in raw:
        return False
    words = raw.split()
    gone = sum(w.strip(".,:;!\"'()«»-|").strip("?") == "" and w.count("?") >= 2 for w in words)
    return raw.count("?") >= 3 and gone * 2 >= len(words)


def suspicious(raws: list[str], model: Model) -> np.ndarray:
    """Mask of non-ASCII sources that the model finds odd."""
    out = np.zeros(len(raws), bool)
    at = np.flatnonzero(np.fromiter((not r.isascii() for r in raws), bool, len(raws)))
    if len(at):
        out[at] = model.means([raws[i] for i in at]) < model.gate
    return out


class Repairer:
    """Restores block sources with one model; repeated sources are looked up."""

    def __init__(self, model: Model, memory: int = 50_000):
        self.model, self.memory, self.seen, self.usual = model, memory, {}, set()

    def __call__(self, raws: list[str]) -> dict[int, str | None]:
        """Index to restored source; None where characters are lost."""
        out: dict[int, str | None] = {}
        for i, raw in enumerate(raws):
            if ("??" in raw or LOST in raw) and lost(raw):
                out[i] = None
        wide = [i for i, raw in enumerate(raws) if not raw.isascii() and raw not in self.usual and i not in out]
        other = list(dict.fromkeys(raws[i] for i in wide if raws[i] not in self.seen))
        usual = {raw for raw, odd in zip(other, suspicious(other, self.model).tolist()) if not odd}
        odd = [i for i in wide if raws[i] not in usual]
        if len(self.usual) + len(usual) > self.memory:
            self.usual.clear()
        self.usual |= usual
        fresh = list(dict.fromkeys(raws[i] for i in odd if raws[i] not in self.seen))
        found = {raw: restore(raw, self.model) if clean(raw) else None for raw in fresh}
        for i in odd:
            text = found[raws[i]] if raws[i] in found else self.seen[raws[i]]
            if text is not None:
                out[i] = text
        if len(self.seen) + len(found) > self.memory:
            self.seen.clear()
        self.seen |= found
        return out
