"""Problem 2: template residue, filler, leftover values, error and access pages.

A positive-unlabelled naive Bayes classifier over passages (blocks), fitted by
expectation-maximization: passages of trusted records, which match the seeds
below, stay positive; all others carry a probability that each round re-estimates.
A record is a case if one of its passages is.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

# What trusted passages look like.
_PLACEHOLDER = (
    r"\{\{\s*[#/]?[\w .]+\}\}", r"\$\{[\w .]+\}", r"\$\[[\w .]+\]", r"<%=?\s*[\w .]+%>", r"<\?php\b", r"\{%\s*[\w .]+%\}",
    r"%%[\w .]+%%", r"(?<!\w)__\w[\w .]*__(?!\w)", r"::\w[\w .]*::", r"(?<![\w#])#[a-zA-Z_]\w*#(?![\w#])", r"@Model\.\w+", r"^\[[a-zA-Z_]+\]$", r"^\{[a-zA-Z_.]+\}$",
)
_EMPTY = r"(?:null|None|NaN|undefined|N/A|XXX|TODO|TBD|Array\(\)|\[object Object\]|#REF!)"
# Leftover values and forms of placeholders as they stand on pages.  With the
# filler they are learned from besides the trusted passages of the table, which may lack some.
_FORMS = ("{{ %s }}", "{{%s}}", "${%s}", "$[%s]", "<%%= %s %%>", "{%% %s %%}", "%%%%%s%%%%", "__%s__", "::%s::", "#%s#", "@Model.%s", "[%s]", "{%s}")
_NAMES = ("name", "title", "author.name", "body")
_LEFTOVERS = ("null", "None", "NaN", "undefined", "N/A", "XXX", "TODO", "TBD", "Array()", "[object Object]", "#REF!")
_FILLER = ("рыба-текст", "blindtext", "текст текст текст", "text text text", "здесь будет текст", "hier steht später", "text goes here", "insert text here", "тест тест", "test test")
_ERROR = (
    r"^(?:error |ошибка |fehler )?[45]\d\d(?!\w| км| km| круг| laps| runden)", r"^internal server error", r"^bad gateway", r"^service (?:temporarily )?unavailable", r"^сервис временно недоступен", r"^page not found", r"^страница не найдена", r"^seite nicht gefunden",
    r"^access denied", r"^доступ (?:ограничен|запрещ[её]н)", r"^zugriff verweigert", r"^javascript is required", r"^включите (?:поддержку скриптов|javascript)", r"^bitte .*javascript", r"^checking your browser", r"^технические работы", r"^сайт на обслуживании", r"^down for maintenance", r"^wartungsarbeiten",
    r"^sign in to continue", r"^требуется вход", r"^anmeldung erforderlich", r"^too many requests", r"^слишком много запросов", r"^zu viele anfragen", r"^ваш браузер устарел", r"^your browser is out of date", r"^oops", r"^упс", r"^hoppla", r"^the owner has not", r"^this domain", r"^diese domain", r"^домен ", r"^under construction",
)
_SEED_SIGNS = re.compile("|".join(f"(?:{p})" for p in _PLACEHOLDER))
_SEED_EMPTY = re.compile(rf"{_EMPTY}(?: {_EMPTY})*")
_SEED_ERROR = re.compile("|".join(f"(?:{p.removeprefix('^')})" for p in _ERROR))
_MAY_HOLD = re.compile(r"[{$<%_:#@\[]")
#: A seed phrase counts in a passage up to this length (talk about errors is longer).
SEED_LENGTH = 80

ROUNDS = 6
#: First guess for passages of trusted records that no rich record has.
BESIDE = 0.5
PSEUDO = 0.5
#: Weight of an example of a leftover value, placeholder or filler beside the passages found.
EXAMPLE = 0.25
#: No feature decides alone.
WEIGHT_MOST = 5.0
#: Weight of unlabelled passages as positives.
LAMBDA = 0.5
#: A rich record has so many passages of at least so many characters.
RICH_PASSAGES, RICH_LENGTH = 3, 120
#: Most log odds that a passage needs; fewer, down to even odds, where a trusted passage has fewer.
THRESHOLD = 2.0

def trusted(text: str) -> bool:
    """Whether a passage is a sure positive: placeholder, leftover value, filler or message."""
    if _MAY_HOLD.search(text) and _SEED_SIGNS.search(text):
        return True
    low = text.lower()
    if "lorem" in low and "ipsum" in low:
        return True
    if len(text) > SEED_LENGTH:
        return False
    return _SEED_EMPTY.fullmatch(text) is not None or _SEED_ERROR.match(low) is not None or any(f in low for f in _FILLER)


_DIGITS = re.compile(r"[0-8]")
_EDGE = ",.!?:;«»„“”\"'’()…—–-"
_SIGN = re.compile(r"[{}\[\]<>%#$@_\\|=/]")
_WORD = re.compile(r"[^\W\d_]+")


class _Bare(dict):
    """Words with digits levelled and edges stripped, remembered within a bound."""

    def __missing__(self, w: str) -> str:
        if len(self) > 300_000:
            self.clear()
        v = self[w] = _DIGITS.sub("9", w).strip(_EDGE)
        return v


_bare = _Bare().__getitem__


def features(text: str) -> list[str]:
    """Distinct words, shapes of words with signs in them, the first word, its shape and the length class."""
    words = text.lower().split()
    out = set(map(_bare, words))
    out.discard("")
    if _SIGN.search(text):
        out.update(["\x02" + _WORD.sub("w", w) for w in out if _SIGN.search(w)])
    if words:
        first = _DIGITS.sub("9", words[0])
        out.add("\x03" + first)
        if _SIGN.search(first):
            out.add("\x04" + _WORD.sub("w", first))
    out.add(f"\x01{min(len(words), 40).bit_length()}")
    return list(out)


@dataclass
class Model:
    weights: dict[str, float]
    prior: float
    bound: float = THRESHOLD

    def score(self, text: str) -> float:
        return self.score_features(features(text))

    def scorer(self):
        """``score`` with the known features held as a set, for many passages."""
        known, weight, prior = frozenset(self.weights), self.weights.__getitem__, self.prior

        def score(text: str) -> float:
            f = features(text)
            return prior + sum(map(weight, known.intersection(f))) * min(1.0, 24 / len(f))

        return score

    def score_features(self, f: list[str]) -> float:
        """Log odds, averaged over features beyond the 24th so that long texts don't saturate."""
        get = self.weights.get
        s = sum([get(x, 0.0) for x in f])
        return self.prior + s * min(1.0, 24 / len(f))


def _rich(record: list[str]) -> bool:
    """Whether a record has body enough to be taken as a page with content."""
    return sum(len(p) >= RICH_LENGTH for p in record) >= RICH_PASSAGES


#: What passages are learned from besides those found, each in a weight of ``EXAMPLE``.
EXAMPLES = tuple(dict.fromkeys((*_LEFTOVERS, *(f"{v} {v}" for v in _LEFTOVERS), *_FILLER, *(f % n for f in _FORMS for n in _NAMES))))


class _Trusted(dict):
    """``trusted`` of passages, remembered within a bound; None for examples that are not, which count as no passage found."""

    def __missing__(self, p: str) -> bool | None:
        if len(self) > 100_000:
            self.clear()
        v = self[p] = trusted(p) or (None if p in _EXAMPLES else False)
        return v


_EXAMPLES = frozenset(EXAMPLES)
_trusted = _Trusted().__getitem__


def passages(records: list[list[str]], out: dict[str, list[int]]) -> None:
    """Add to ``out``, for every passage, its occurrences as a sure negative, as unlabelled, as trusted and beside a trusted one.

    Passages of rich records without a trusted one are sure negatives.
    """
    for r in records:
        marks = list(map(_trusted, r))
        rich, any_ = _rich(r), True in marks
        k = 0 if rich and not any_ else 1
        for p, mark in zip(r, marks):
            if mark is not None:
                row = out.get(p)
                if row is None:
                    row = out[p] = [0, 0, 0, 0]
                row[2 if mark else k] += 1
                row[3] += any_ and not rich


def counted(ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Sum of the passages' weights at each of their features, and of all; those of next to nothing are left out."""
    weights = np.where(weights > 1e-4, weights, 0.0)
    return np.bincount(ids, np.repeat(weights, sizes), size), float(weights.sum())


def spread(ids: np.ndarray, sizes: np.ndarray, n: np.ndarray, beside: np.ndarray, now: tuple[np.ndarray, float] | None, size: int):
    """Counts of unlabelled passages, given by their features' ids, as positives and as negatives under the model so far."""
    if now is None:
        # What stands beside a trusted passage on a page without body may be of its kind.
        q = np.where(beside, BESIDE, 0.0)
    elif len(sizes):
        weights, prior = now
        s = np.add.reduceat(weights[ids], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        q = 1 / (1 + np.exp(-np.clip(prior + s * np.minimum(1.0, 24 / sizes), -50, 50)))
    else:
        q = np.zeros(0)
    return counted(ids, sizes, LAMBDA * q * n, size), counted(ids, sizes, (1 - q) * n, size)


def settle(known: list[str], neg: np.ndarray, nn0: float, pos: np.ndarray, np0: float, spread: Callable) -> Model:
    """EM from the counts of sure negatives and of trusted passages; ``spread(weights and prior so far)`` counts the unlabelled ones.

    Smoothing is in proportion to the classes' mass, so that an unseen feature speaks for neither.
    """
    pos, now = pos.copy(), None
    at = {x: k for k, x in enumerate(known)}
    for p in EXAMPLES:
        np0 += EXAMPLE
        pos[[at[x] for x in features(p)]] += EXAMPLE
    for _ in range(ROUNDS):
        (up, nup), (un, nun) = spread(now)
        np_, nn = np0 + nup, nn0 + nun
        a, b = PSEUDO * np_ / (np_ + nn), PSEUDO * nn / (np_ + nn)
        shift = math.log(nn + b) - math.log(np_ + a)
        weights = np.clip(np.log(pos + up + a) - np.log(neg + un + b) + shift, -WEIGHT_MOST, WEIGHT_MOST)
        now = weights, -shift
    # Features near nothing decide nothing; leaving them out keeps the model small.
    return Model({known[k]: float(weights[k]) for k in np.flatnonzero(np.abs(weights) > 0.3).tolist()}, -shift)


def bounded(model: Model, lowest: float) -> Model:
    """The model with its bound, which lies under the lowest score of all trusted passages."""
    model.bound = min(THRESHOLD, max(0.0, lowest - 1e-6))
    return model


def class_of(neg: int, seed: int) -> int:
    """0 sure negative, 1 unlabelled, 2 trusted."""
    return 2 if seed else 0 if neg else 1


def fit(records: list[list[str]]) -> Model:
    """EM on records; without trusted passages nothing is a case.

    Passages of rich records without a trusted one are reliable negatives; what
    remains is unlabelled, and EM moves it between the classes, its positive
    share weighing ``LAMBDA``.  ``pages.fit_residue`` does the same over a table.
    """
    found: dict[str, list[int]] = {}
    passages(records, found)
    if not any(c[2] for c in found.values()):
        return Model({}, -1e9)
    at: dict[str, int] = {}
    ids, sizes, n, beside = ([[], [], []] for _ in range(4))
    for p, (neg, other, seed, near) in sorted(found.items()):
        k, f = class_of(neg, seed), [at.setdefault(x, len(at)) for x in features(p)]
        ids[k] += f
        sizes[k].append(len(f))
        n[k].append(seed or neg + other)
        beside[k].append(near > 0)
    for p in EXAMPLES:
        for x in features(p):
            at.setdefault(x, len(at))
    rows = [(np.array(ids[k], np.int64), np.array(sizes[k], np.int64), np.array(n[k], np.float64)) for k in range(3)]
    (neg, nn0), (pos, np0) = (counted(*rows[k], len(at)) for k in (0, 2))
    model = settle(list(at), neg, nn0, pos, np0, lambda now: spread(*rows[1], np.array(beside[1], bool), now, len(at)))
    return bounded(model, min(map(model.score, (p for p, c in found.items() if c[2]))))


class _Most(dict):
    """Most that a word, as it stands, adds to a score by itself and its shape; ``mark`` and ``shape`` are the keys' prefixes."""

    def __init__(self, weights: dict[str, float], bare: Callable, mark: str, shape: str):
        super().__init__()
        self.weight, self.bare, self.mark, self.shape = weights.get, bare, mark, shape

    def __missing__(self, w: str) -> float:
        if len(self) > 300_000:
            self.clear()
        x = self.bare(w)
        v = max(0.0, self.weight(self.mark + x, 0.0))
        if _SIGN.search(x):
            v += max(0.0, self.weight(self.shape + _WORD.sub("w", x), 0.0))
        self[w] = v
        return v


class Judge:
    """Record decisions by the model alone; repeated passages are looked up.

    Few features speak for a case: where those of a passage can't reach the bound even
    without the others, it is not scored.
    """

    def __init__(self, model: Model, memory: int = 100_000):
        self.score, self.bound, self.memory, self.seen = model.scorer(), model.bound, memory, {}
        self.most = _Most(model.weights, _bare, "", "\x02").__getitem__
        self.first = _Most(model.weights, lambda w: _DIGITS.sub("9", w), "\x03", "\x04").__getitem__
        lengths = [max(0.0, model.weights.get(f"\x01{k}", 0.0)) for k in range(7)]
        # What rounding may add is far below.
        self.needs = model.bound - model.prior - max(lengths) - 1e-6

    def passage(self, text: str) -> bool:
        got = self.seen.get(text)
        if got is None:
            if len(self.seen) >= self.memory:
                self.seen.clear()
            words = text.lower().split()
            may = sum(map(self.most, words)) + (self.first(words[0]) if words else 0.0) > self.needs
            got = self.seen[text] = may and self.score(text) > self.bound
        return got

    def __call__(self, passages: list[str]) -> bool:
        return any(map(self.passage, passages))
