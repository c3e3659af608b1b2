"""Problem 1: the story's blocks among a page's boilerplate.

A numpy bidirectional LSTM reads the page's blocks in order, each as hashed tag
path steps, hashed words and a few measures, and labels every block with the
whole page as context.  It is trained on pages of known layout, which a teacher
labels by container and by the phrases sites add; each of them is also used with
its tags taken away, so that records without tags are read by text alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np

# Containers of stories and of site furniture, and what sites add to stories.
_STORY_BOX = re.compile(r"^(?:div\.(?:content|post_content|textblock|c[0-9a-f]{4})|article(?:\.full)?|main(?:\.main-content)?|td)$")
_SITE_BOX = re.compile(r"^(?:nav|header|footer|aside|form|h1|article\.teaser|div\.(?:sidebar|right|left|consent-bar|cookie|popup|adv|banner|item|menu|footer|comments|c[0-9a-f]{4}[a-z]))$")
_ADDED_FIRST = r"""^(?:[—–-]\s*)?(?:
    (?:автор|фото|источник):|(?:ранее|по\ теме|читайте\ также):|поделиться\b|обсудить\b|время\ чтения|мнение\ автора|текст\ обновл|все\ новости\ этапа|материал\ подготовлен|нашли\ опечатку|подпишитесь|следите\ за\ нами
    |(?:photo|earlier|related|read\ also|see\ also):|share\ this|join\ the\ talk|reading\ time|views\ are\ the\ author|updated\ at|all\ the\ news\ of|prepared\ for|spotted\ a\ typo|sign\ up\ for|follow\ us|more\ on\ this
    |(?:foto|zuvor|mehr\ dazu|lesen\ sie\ auch|siehe\ auch|zum\ thema):|zuletzt\ geändert|mehr\ davon|lesezeit|mitreden|teilen\b|für\ \S+\.\w+\ erstellt|(?:tipp)?fehler\ gefunden|alle\ meldungen|abonnieren|meinung\ des
    |(?:by|von)\s+\S+\s+\S+[!»\s]*$
    )"""
_ADDRESS = r"\b[a-z-]{1,63}\.[a-z]{2,}\b(?!\()"
_ADDED = re.compile(f"{_ADDED_FIRST}|{_ADDRESS}", re.I | re.X)
_added_first, _address, _may_be_address = re.compile(_ADDED_FIRST, re.I | re.X).match, re.compile(_ADDRESS, re.I).search, re.compile(r"\.[a-z]{2}", re.I).search

WORD_BUCKETS, PATH_BUCKETS = 1 << 13, 1 << 10
WORD_DIM, PATH_DIM, DENSE, HIDDEN = 20, 12, 8, 20
EPOCHS, BATCH, RATE, SEED = 10, 48, 4e-3, 7

_DIGITS = re.compile(r"[0-8]")
_EDGE = ",.!?;«»„“”\"'’()…*#`=[]{}|_—–-"
_DIGIT = re.compile(r"\d")
_DOMAIN = re.compile(r"\.(?<=[a-zA-Z]\.)[a-zA-Z]{2}")
_HEX = re.compile(r"[0-9a-f]{4,}")
_may_mark = re.compile(r"[<\[$\\|]").search
_SIGNS = frozenset("<[]$\\|{}>")
_MARK = re.compile(r"(</?[a-z0-9]+|\[\[|\]\]|\$+|\\[a-z]+|\\[\[\]]|[|{}>])")
_SENTENCE_END = (".", "!", "?", "…", "»", "”", "“", '"')


def added(text: str) -> bool:
    """``_ADDED.search``, faster."""
    return _added_first(text) is not None or (_may_be_address(text) is not None and _address(text) is not None)


@lru_cache(50_000)
def _places(path: tuple[str, ...]) -> tuple[bool, bool]:
    """Whether a path lies in a story's container, and in the site's furniture."""
    return any(map(_STORY_BOX.match, path)), any(map(_SITE_BOX.match, path))


def teach(blocks: list[tuple[str, tuple[str, ...]]]) -> list[int] | None:
    """Labels of a page of known layout, None where no story container is found."""
    labels, found = [], False
    for text, path in blocks:
        box, site = _places(path)
        found |= box and not site
        labels.append(int(box and not site and not added(text)))
    return labels if found and any(labels) else None


def without_tags(blocks, labels, rng):
    """The page as a record of lines; a run of menu items may become one line."""
    texts, marks, menu = [], [], []
    join = rng.random() < 0.4

    def flush():
        if menu:
            texts.append(" | ".join(menu))
            marks.append(0)
            menu.clear()

    for (text, path), y in zip(blocks, labels):
        if join and not y and len(text) < 24 and ("nav" in path or any(p[-1] == "m" for p in path if p.startswith("div.c"))):
            menu.append(text)
            continue
        flush()
        texts.append(text)
        marks.append(y)
    flush()
    if rng.random() < 0.2:
        texts.append(f"id {rng.integers(1, 10**6)}")
        marks.append(0)
    return [(t, ("#text",)) for t in texts], marks


class _Buckets(dict):
    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, key: str) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[key] = crc32(key.encode("utf-8", "surrogatepass")) & (self.size - 1)
        return v


_WORDS, _PATHS = _Buckets(WORD_BUCKETS), _Buckets(PATH_BUCKETS)


def _bare(token: str) -> str:
    w = _DIGITS.sub("9", token)
    return w.strip(_EDGE) or (w if w[0] in _SIGNS else "")


class _Tokens(dict):
    """Bucket of a token's bare form, remembered within a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        v = self[token] = _WORDS[_bare(token)]
        return v


class _Bare(dict):
    """Bare forms of tokens, remembered within a bound."""

    def __missing__(self, token: str) -> str:
        if len(self) > 100_000:
            self.clear()
        v = self[token] = _bare(token)
        return v


_bucket, _bared = _Tokens().__getitem__, _Bare().__getitem__
_path_memory: dict[tuple, np.ndarray] = {}


def _path_ids(path: tuple[str, ...]) -> np.ndarray:
    got = _path_memory.get(path)
    if got is None:
        if len(_path_memory) > 20_000:
            _path_memory.clear()
        steps = [_HEX.sub("*", p) for p in path if p not in ("html", "body")]
        keys = [*steps, "^" + (steps[-1] if steps else ""), "<" + "/".join(steps[-2:])]
        got = _path_memory[path] = np.array([_PATHS[k] for k in keys], np.int32)
    return got


def _dense(text: str, n: int) -> tuple:
    k = len(text)
    return (min(k, 600) / 200, k < 30, text.isupper(), _DIGIT.search(text) is not None, text.endswith(_SENTENCE_END), _DOMAIN.search(text) is not None, ":" in text[:25], min(n, 80) / 40)


@dataclass
class Sequences:
    """Features of a batch of pages, blocks flattened in page order."""

    lengths: np.ndarray
    word_ids: np.ndarray
    word_starts: np.ndarray
    text_of: np.ndarray
    path_ids: np.ndarray
    path_starts: np.ndarray
    path_of: np.ndarray
    dense: np.ndarray


def encode(pages: list[list[tuple[str, tuple[str, ...]]]]) -> Sequences:
    texts: dict[str, int] = {}
    paths: dict[tuple, int] = {}
    text_of, path_of = [], []
    for page in pages:
        for text, path in page:
            text_of.append(texts.setdefault(text, len(texts)))
            path_of.append(paths.setdefault(path, len(paths)))
    ids, starts, dense = [], [], []
    get = _WORDS.__getitem__
    for text in texts:
        low = text.lower()
        if _may_mark(low):
            low = _MARK.sub(r" \1 ", low)
        words = low.split()
        starts.append(len(ids))
        ids += map(_bucket, words)
        if words:
            first = _bared(words[0])
            ids += get("^" + first), get(f"^^{first} {_bared(words[1])}" if len(words) > 1 else "^^" + first), get("$" + _bared(words[-1]))
        else:
            ids += 0, get("^^"), 0
        dense += _dense(text, len(words))
    p = [_path_ids(x) for x in paths]
    return Sequences(
        np.array([len(x) for x in pages], np.int64),
        np.fromiter(ids, np.int32, len(ids)), np.array(starts, np.int64), np.array(text_of, np.int64),
        np.concatenate(p) if p else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum([len(x) for x in p])[:-1]]).astype(np.int64) if p else np.zeros(0, np.int64), np.array(path_of, np.int64),
        np.fromiter(dense, np.float32, len(dense)).reshape(-1, DENSE),
    )


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Tagger:
    """Weights and the forward pass."""

    w: dict[str, np.ndarray]

    def inputs(self, s: Sequences) -> np.ndarray:
        """One row per block: word mean, path sum and measures."""
        words = np.add.reduceat(self.w["words"][s.word_ids], s.word_starts) if len(s.word_starts) else np.zeros((0, WORD_DIM), np.float32)
        counts = np.diff(np.append(s.word_starts, len(s.word_ids)))
        words = words / np.sqrt(counts)[:, None]
        paths = np.add.reduceat(self.w["paths"][s.path_ids], s.path_starts) if len(s.path_starts) else np.zeros((0, PATH_DIM), np.float32)
        return np.concatenate([words[s.text_of], paths[s.path_of], s.dense[s.text_of]], 1).astype(np.float32)

    def run(self, x: np.ndarray, lengths: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Scores per block; pages are packed by length so that no step works on padding."""
        order = np.argsort(-lengths, kind="stable")
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        sizes = lengths[order]
        top = int(sizes[0]) if len(sizes) else 0
        live = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(top)]
        out = np.zeros((len(x), 2 * HIDDEN), np.float32)
        half = np.concatenate([np.full(3 * HIDDEN, 0.5), np.ones(HIDDEN)]).astype(np.float32)  # sigmoid(x) = (tanh(x / 2) + 1) / 2
        firsts = np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
        for d, name in ((0, "f"), (1, "b")):
            # Rows are laid out step by step, so that each step's, and the last one's of the same pages, lie together.
            at = np.concatenate([starts[:n] + t if d == 0 else starts[:n] + sizes[:n] - 1 - t for t, n in enumerate(live)]) if top else np.zeros(0, np.int64)
            g = (x @ (self.w[f"wx{name}"] * half) + self.w[f"bias{name}"] * half)[at]
            u = self.w[f"wh{name}"] * half
            h, c, tc = (np.empty((len(at), HIDDEN), np.float32) for _ in range(3))
            for t, n in enumerate(live):
                lo = firsts[t]
                now, last = slice(lo, lo + n), slice(firsts[t - 1], firsts[t - 1] + n)
                gates = g[now]
                if t:
                    gates += h[last] @ u
                np.tanh(gates, out=gates)
                ifo = gates[:, : 3 * HIDDEN]
                ifo += 1
                ifo *= 0.5
                np.multiply(gates[:, :HIDDEN], gates[:, 3 * HIDDEN :], out=c[now])
                if t:
                    c[now] += gates[:, HIDDEN : 2 * HIDDEN] * c[last]
                np.tanh(c[now], out=tc[now])
                np.multiply(gates[:, 2 * HIDDEN : 3 * HIDDEN], tc[now], out=h[now])
            out[at, d * HIDDEN : (d + 1) * HIDDEN] = h
            if keep is not None:
                keep.append((live, firsts, at, g, h, c, tc))
        return out

    def scores(self, s: Sequences) -> np.ndarray:
        if not len(s.text_of):
            return np.zeros(0, np.float32)
        x = self.inputs(s)
        h = self.run(x, s.lengths)
        return h @ self.w["out"][: 2 * HIDDEN] + x @ self.w["out"][2 * HIDDEN :] + self.w["out_bias"]

    def label(self, pages: list[list[tuple[str, tuple[str, ...]]]]) -> list[np.ndarray]:
        """Mask of story blocks of every page."""
        if not pages:
            return []
        s = encode(pages)
        return np.split(self.scores(s) > 0, np.cumsum(s.lengths)[:-1])


def _start(rng) -> dict[str, np.ndarray]:
    d = WORD_DIM + PATH_DIM + DENSE
    w = {"words": rng.normal(0, 0.1, (WORD_BUCKETS, WORD_DIM)), "paths": rng.normal(0, 0.1, (PATH_BUCKETS, PATH_DIM)), "out": rng.normal(0, 0.1, 2 * HIDDEN + d), "out_bias": np.zeros(1)}
    for n in "fb":
        w[f"wx{n}"] = rng.normal(0, 1 / np.sqrt(d), (d, 4 * HIDDEN))
        w[f"wh{n}"] = rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
        w[f"bias{n}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
    return {k: v.astype(np.float32) for k, v in w.items()}


def _sum_rows(ids: np.ndarray, rows: np.ndarray, size: int, of: np.ndarray | None = None) -> np.ndarray:
    """Sums of rows by id; ``of`` tells every id's row where they are not in order."""
    order = np.argsort(ids, kind="stable")
    at = np.flatnonzero(np.diff(ids[order], prepend=-1))
    out = np.zeros((size, rows.shape[1]), np.float32)
    out[ids[order][at]] = np.add.reduceat(rows[order if of is None else of[order]], at)
    return out


def _gradients(m: Tagger, s: Sequences, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and its gradients; a block of weight n counts n times."""
    x = m.inputs(s)
    tapes: list = []
    h = m.run(x, s.lengths, tapes)
    wo = m.w["out"]
    p = _sigmoid(h @ wo[: 2 * HIDDEN] + x @ wo[2 * HIDDEN :] + m.w["out_bias"])
    loss = float(-np.average(np.log(np.where(y > 0, p, 1 - p) + 1e-7), weights=weight))
    ds = ((p - y) / len(y) if weight is None else (p - y) * weight / weight.sum()).astype(np.float32)
    g = {"out": np.concatenate([h.T @ ds, x.T @ ds]), "out_bias": ds.sum(keepdims=True)}
    dh_out = ds[:, None] * wo[: 2 * HIDDEN]
    dx = ds[:, None] * wo[2 * HIDDEN :]
    for d, name in ((0, "f"), (1, "b")):
        u = m.w[f"wh{name}"]
        live, firsts, at, gates, h, c, tc = tapes[d]
        i, f, o, z = (gates[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        # State before each row's step; none before the first.
        hp, cp = np.zeros_like(h), np.zeros_like(c)
        last = np.concatenate([np.arange(lo, lo + n) for lo, n in zip(firsts, live[1:])]) if len(live) > 1 else np.zeros(0, np.int64)
        hp[len(h) - len(last) :], cp[len(c) - len(last) :] = h[last], c[last]
        # All that does not depend on later steps, for all rows at once.
        dg = np.concatenate([z * i * (1 - i), cp * f * (1 - f), tc * o * (1 - o), i * (1 - z * z)], 1).reshape(-1, 4, HIDDEN)
        through, above = o * (1 - tc * tc), dh_out[at, d * HIDDEN : (d + 1) * HIDDEN]
        pages = len(s.lengths)
        dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        for lo, n in zip(firsts[-2::-1], live[::-1]):
            now = slice(lo, lo + n)
            a = dh[:n] + above[now]
            e = dc[:n] + a * through[now]
            rows = dg[now]
            rows[:, :2] *= e[:, None]
            rows[:, 2] *= a
            rows[:, 3] *= e
            np.matmul(rows.reshape(n, 4 * HIDDEN), u.T, out=dh[:n])
            np.multiply(e, f[now], out=dc[:n])
        dg = dg.reshape(-1, 4 * HIDDEN)
        du = hp.T @ dg
        dgx = np.empty_like(dg)
        dgx[at] = dg
        g[f"wh{name}"], g[f"wx{name}"], g[f"bias{name}"] = du, x.T @ dgx, dgx.sum(0)
        dx += dgx @ m.w[f"wx{name}"].T
    texts = len(s.word_starts)
    counts = np.diff(np.append(s.word_starts, len(s.word_ids)))
    dt = _sum_rows(s.text_of, dx[:, :WORD_DIM], texts) / np.sqrt(counts).astype(dx.dtype)[:, None]
    g["words"] = _sum_rows(s.word_ids.astype(np.uint16), dt, WORD_BUCKETS, np.repeat(np.arange(texts), counts))
    plen = np.diff(np.append(s.path_starts, len(s.path_ids)))
    dp = _sum_rows(s.path_of, dx[:, WORD_DIM : WORD_DIM + PATH_DIM], len(s.path_starts))
    g["paths"] = _sum_rows(s.path_ids, np.repeat(dp, plen, 0), PATH_BUCKETS)
    return loss, g


def examples(page: list[tuple[str, tuple[str, ...]]], rng) -> list[tuple]:
    """The page with its labels, with and without its tags; a page that only lists stories has none, other pages that the teacher can't label give nothing."""
    y = teach(page)
    if y is not None:
        return [(page, y), without_tags(page, y, rng)]
    if page and any("div.item" in p for _, p in page):
        return [(page, [0] * len(page)), ([(t, ("#text",)) for t, _ in page], [0] * len(page))]
    return []


class Learner:
    """Adam from given weights, a batch at a time."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.m = Tagger({k: v.copy() for k, v in w.items()})
        self.mean = {k: np.zeros_like(v) for k, v in w.items()}
        self.var = {k: np.zeros_like(v) for k, v in w.items()}
        self.t = 0

    def step(self, s: Sequences, y: np.ndarray, rate: float, rng, weight: np.ndarray | None = None) -> None:
        self.t += 1
        # Words are dropped at random so that context and other words learn to do without them.
        s = Sequences(**{**s.__dict__, "word_ids": np.where(rng.random(len(s.word_ids)) < 0.15, 0, s.word_ids)})
        _, g = _gradients(self.m, s, y, weight)
        for n, v in g.items():
            self.mean[n] = 0.9 * self.mean[n] + 0.1 * v
            self.var[n] = 0.99 * self.var[n] + 0.01 * v * v
            self.m.w[n] -= rate * (self.mean[n] / (1 - 0.9**self.t)) / (np.sqrt(self.var[n] / (1 - 0.99**self.t)) + 1e-6)

    def learn(self, data: list[tuple[list[tuple], int]], size: int, rate: float, rng) -> None:
        """One pass over pages, each as its ``examples`` and how often it counts.

        ``size`` pages of like length make a batch, with and without their tags, so that
        their texts are read once; batches come in random order.
        """
        order = np.argsort([len(found[0][0]) for found, _ in data], kind="stable")
        batches = [order[j : j + size] for j in range(0, len(order), size)]
        for k in rng.permutation(len(batches)):
            some = [(page, y, n) for i in batches[k] for found, n in [data[i]] for page, y in found]
            y = np.concatenate([y for _, y, _ in some]).astype(np.float32)
            self.step(encode([p for p, _, _ in some]), y, rate, rng, np.repeat([n for _, _, n in some], [len(p) for p, _, _ in some]).astype(np.float32))


def rate_at(done: float) -> float:
    """Rate of learning after a share of the training."""
    return RATE * (1 - 0.85 * done)


def start() -> dict[str, np.ndarray]:
    """Weights before any training, the same each time."""
    return _start(np.random.default_rng(SEED))


def untaught() -> Tagger:
    """The labeller of tables without any page to learn from; it finds no story."""
    m = Tagger(start())
    m.w["out_bias"][:] = -9
    return m


def flat(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)])


def unflat(row: np.ndarray) -> dict[str, np.ndarray]:
    out, at = start(), 0
    for k in sorted(out):
        out[k] = row[at : at + out[k].size].astype(np.float32).reshape(out[k].shape)
        at += out[k].size
    return out


def fit(pages: list[list[tuple[str, tuple[str, ...]]]], epochs: int = EPOCHS) -> Tagger:
    """Train on the pages that the teacher can label, with and without tags; ``pages.fit_mainbody`` trains on a table."""
    rng = np.random.default_rng(SEED)
    data = [x for page in pages for x in examples(page, rng)]
    if not data:
        return untaught()
    sizes = np.array([len(p) for p, _ in data])
    batches = []
    for i in range(0, len(data), BATCH * 8):
        chunk = np.arange(i, min(i + BATCH * 8, len(data)))
        chunk = chunk[np.argsort(sizes[chunk], kind="stable")]
        batches += [chunk[j : j + BATCH] for j in range(0, len(chunk), BATCH)]
    ready = [(encode([data[k][0] for k in b]), np.concatenate([data[k][1] for k in b]).astype(np.float32)) for b in batches]
    learner = Learner(_start(rng))
    for epoch in range(epochs):
        for k in rng.permutation(len(ready)):
            learner.step(*ready[k], rate_at(epoch / epochs), rng)
    return learner.m
