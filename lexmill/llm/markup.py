"""Problem 6: markup that a reader would see in a story, and its clean text.

The story's region is the maximum-scoring contiguous stretch of the page's
stream of words and tags: words score positive, tags negative, with weights
from pages that the teacher of problem 1 can label, found by one linear scan.
Within the region each block's source text (references decoded once, line
breaks kept) is read for HTML, Markdown, wiki and LaTeX constructs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape
from itertools import chain

from lexmill.llm.mainbody import _HEX, teach

KINDS = ("heading", "list", "code", "formula", "table", "inline")
MARKUPS = ("html", "markdown", "wiki", "latex")

# --- region


_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
#: Least and most that one word says.
WORD_LEAST, WORD_MOST = -3.0, 1.5
#: Blocks whose words' weights are remembered.
REMEMBERED = 50_000


class _Parts(dict):
    """Words that a token between blanks holds, numbers as '9', remembered within a bound; no word spans two tokens."""

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        v = self[token] = tuple(["9" if w[0].isdigit() else w for w in _WORD.findall(token)])
        return v


_parts = _Parts().__getitem__


def _words(text: str) -> set[str]:
    """Distinct words of a block with its length class, so that long blocks count more."""
    low = text.lower()
    words = list(chain.from_iterable(map(_parts, low.split())))
    out = set(words)
    out.add(f"\x01{min(len(words), 60).bit_length()}{int(text[-1:] in '.!?…”“»')}")
    out.add("^" + (_WORD.search(low)[0] if words else ""))
    return out


def _entered(path: tuple[str, ...], before: tuple[str, ...]) -> list[str]:
    """Tags entered between two blocks."""
    k = 0
    while k < len(path) and k < len(before) and path[k] == before[k]:
        k += 1
    return ["<" + _HEX.sub("*", p) for p in path[k:]] or ["<>"]


def _beside(path: tuple[str, ...], edge: tuple[str, ...]) -> bool:
    return len(path) > 1 and path[-1] != "h1" and path[:-1] == edge[:-1]


@dataclass
class Weights:
    words: dict[str, float]
    tags: dict[str, float]
    seen: dict[str, float] = field(default_factory=dict, repr=False, compare=False)

    def _of_words(self, text: str) -> float:
        """Sum of the weights of a block's words, remembered within a bound."""
        s = self.seen.get(text)
        if s is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            s = self.seen[text] = sum(map(self.words.__getitem__, self.words.keys() & _words(text)))
        return s

    def scores(self, blocks: list[tuple[str, tuple[str, ...]]]) -> list[float]:
        """Score of every block: its words' weights and those of the tags before it."""
        out, before = [], ()
        for text, path in blocks:
            s = self._of_words(text)
            for t in _entered(path, before):
                s += self.tags.get(t, -1.0)
            out.append(s)
            before = path
        return out

    def region(self, blocks: list[tuple[str, tuple[str, ...]]]) -> tuple[int, int]:
        """Half-open index range of the best contiguous region; (0, 0) if none scores above 0."""
        best, lo, hi, total, start = 0.0, 0, 0, 0.0, 0
        for i, s in enumerate(self.scores(blocks)):
            if total <= 0:
                total, start = 0.0, i
            total += s
            if total > best:
                best, lo, hi = total, start, i + 1
        # Short pieces at the ends belong to it if they stand in the same element.
        while 0 < lo < hi and _beside(blocks[lo - 1][1], blocks[lo][1]):
            lo -= 1
        while 0 < hi < len(blocks) and lo < hi and _beside(blocks[hi][1], blocks[hi - 1][1]):
            hi += 1
        return lo, hi


class Counts:
    """Blocks and tags outside and inside labelled stories, and how often they occur."""

    def __init__(self):
        self.texts, self.tags = (Counter(), Counter()), (Counter(), Counter())

    def add(self, page: list[tuple[str, tuple[str, ...]]], y: list[int]) -> None:
        """Count a page and its labels; what sites add amid a story counts as inside, being part of the region."""
        lo, hi = y.index(1), len(y) - y[::-1].index(1)
        before: tuple = ()
        for i, (text, path) in enumerate(page):
            there = lo <= i < hi
            self.texts[there][text] += 1
            # A tag that opens the story itself belongs to neither side.
            if i != lo:
                self.tags[there].update(_entered(path, before))
            before = path

    def drain(self) -> list[Counter]:
        """Words outside and inside, tags likewise, and the numbers of blocks under the keys of ``BLOCKS``."""
        words = (Counter({BLOCKS: sum(self.texts[0].values())}), Counter({BLOCKS: sum(self.texts[1].values())}))
        for side, texts in zip(words, self.texts):
            side.update(chain.from_iterable(_words(text) for text, n in texts.items() if n == 1))
            for text, n in texts.items():
                if n > 1:
                    for w in _words(text):
                        side[w] += n
        out = [*words, *self.tags]
        self.__init__()
        return out


#: Key of the number of blocks among the words' counts; no word is empty.
BLOCKS = ""


def weighed(outside: dict[str, int], inside: dict[str, int], tout: dict[str, int], tin: dict[str, int]) -> Weights:
    """Log ratios of words and tags from the counts of ``Counts.drain``; a tag is never better than neutral."""
    n_in, n_out = inside.get(BLOCKS, 0), outside.get(BLOCKS, 0)
    total = n_in + n_out + 1
    a, b = max(n_in, 1) / total, max(n_out, 1) / total
    shift = math.log(max(n_out, 1)) - math.log(max(n_in, 1))
    words = {w: max(WORD_LEAST, min(WORD_MOST, math.log(inside.get(w, 0) + a) - math.log(outside.get(w, 0) + b) + shift)) for w in (inside.keys() | outside.keys()) - {BLOCKS}}
    words = {w: v for w, v in words.items() if abs(v) > 0.1}
    c, d = sum(tin.values()) + 1, sum(tout.values()) + 1
    tags = {t: max(-6.0, min(0.0, math.log((tin.get(t, 0) + 0.5) / c) - math.log((tout.get(t, 0) + 0.5) / d))) for t in tin.keys() | tout.keys()}
    return Weights(words, tags)


def fit(pages: list[list[tuple[str, tuple[str, ...]]]]) -> Weights:
    """Log ratios of words and tags inside and outside labelled stories; ``pages.fit_markup`` does the same over a table."""
    counts = Counts()
    for page in pages:
        if (y := teach(page)) is not None:
            counts.add(page, y)
    return weighed(*counts.drain())


# --- constructs

_F = re.M | re.S
_CODE = (
    ("html", re.compile(r"<pre\b[^<>]*>.*?(?:</pre>|\Z)|<code\b[^<>]*>.*?(?:</code>|\Z)", re.S | re.I)),
    ("wiki", re.compile(r"<(syntaxhighlight|source|nowiki)\b[^<>]*>.*?(?:</\1>|\Z)", re.S | re.I)),
    ("latex", re.compile(r"\\begin\{(verbatim|lstlisting|minted)\}.*?(?:\\end\{\1\}|\Z)|\\verb\*?([^\sA-Za-z*]).*?\2|\\texttt\{[^{}]*\}", re.S)),
    ("markdown", re.compile(r"```.*?(?:```|\Z)|~~~.*?~~~|(?<!`)`[^`\n]+`(?!`)", re.S)),
)
_FORMULA = (
    ("wiki", re.compile(r"<math\b[^<>]*>.*?(?:</math>|\Z)", re.S | re.I)),
    ("latex", re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray)\*?\}.*?(?:\\end\{\1\*?\}|\Z)|\$\$.+?\$\$|\\\[(?:[^\\]|\\(?!\[))+?\\\]|\\\((?:[^\\]|\\(?!\())+?\\\)|(?<![\\$\w])\$(?=[^\s$])(?=[^$\n]*[\\^_={])[^$\n]+(?<=[^\s\\$])\$(?![\w$])", re.S)),
)
_REST = (
    ("html", "heading", re.compile(r"<h[1-6]\b[^<>]*>", re.I)),
    ("html", "list", re.compile(r"<(?:ul|ol|li|dl|dt)\b[^<>]*>", re.I)),
    ("html", "table", re.compile(r"<(?:table|tr|td|th)\b[^<>]*>", re.I)),
    ("html", "inline", re.compile(r"<(?:a|b|i|u|s|em|strong|span|br|hr|img|sub|sup|small|font|mark|p|div)\b[^<>]*>|</(?:a|b|i|em|strong|span|p|div)>|&(?:[a-zA-Z]{2,8}|#\d{2,6}|#x[0-9a-fA-F]{2,5});", re.I)),
    ("wiki", "heading", re.compile(r"^[^\S\n]*(={2,6})\s*[^=\s].*?[^=\s]\s*\1\s*$", re.M)),
    ("wiki", "table", re.compile(r"^[^\S\n]*\{\||\|\}\s*$", re.M)),
    ("wiki", "list", re.compile(r"^[^\S\n]*(?:\*{2,}|#{1,6}|\*|[*#]{2,})\s*(?=\[\[)|^[^\S\n]*\*{2,}\s+\S|^[^\S\n]*[*#]*#\*|^[^\S\n]*[;:]\s+\S", re.M)),
    ("wiki", "inline", re.compile(r"\[\[[^\[\]]+\]\]|'{2,5}[^']+'{2,5}|\[https?://[^\s\[\]]+ [^\[\]]+\]|<ref\b|\{\{(?:cite|ref|lang)\b")),
    ("markdown", "heading", re.compile(r"^[^\S\n]*#{1,6}\s+(?!\[\[)\S|\S[^\S\n]*\n\s*(?:={3,}|-{3,})[^\S\n]*$|\S\s+={5,}\s*$", re.M)),
    ("markdown", "table", re.compile(r"\|\s*:?-{2,}:?\s*\|")),
    ("markdown", "list", re.compile(r"^[^\S\n]*(?:[-+]|\*(?!\*)|\d{1,3}[.)])\s+(?!\[\[)\S", re.M)),
    ("markdown", "inline", re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s+\"[^\"]*\")?\)|\*\*(?=\S)[^*\n]+(?<=\S)\*\*|(?<![*\w])\*(?=[^\s*\d])[^*\n]+(?<=[^\s*])\*(?![*\w])|~~(?=\S)[^~\n]+~~")),
    ("latex", "heading", re.compile(r"\\(?:sub){0,2}section\b|\\(?:chapter|paragraph|part)\b\*?\{")),
    ("latex", "list", re.compile(r"\\begin\{(?:itemize|enumerate|description)\}|\\item\b")),
    ("latex", "table", re.compile(r"\\begin\{(?:tabular|table|longtable|array)\*?\}")),
    ("latex", "inline", re.compile(r"\\(?:textbf|textit|emph|underline|textsc|cite[tp]?|href|url|ref|label|footnote|includegraphics)\b|\\\\(?=\s*$)")),
)
_TABULAR = re.compile(r"\\begin\{(tabular|longtable|array)\*?\}.*?(?:\\end\{\1\*?\}|\Z)", re.S)
_LINE_MARK = r"^[^\S\n]*(?:#|[-+;:]\s|\d{1,3}[.)]\s)"
_ANY = re.compile(rf"[<\\`|$*]|\[\[|\]\(|''|&[a-zA-Z#]|==|~~|\[http|{_LINE_MARK}", re.M)
_may_sign, _line_mark = re.compile(r"[<\\`|$*\[\]'&=~]").search, re.compile(_LINE_MARK).match


def _may_hold(text: str) -> bool:
    """Whether ``_ANY`` is found, faster where a text has one line and none of its signs."""
    return (_may_sign(text) is not None or "\n" in text or _line_mark(text) is not None) and _ANY.search(text) is not None


_BLANKS, _LINES = re.compile(r"[^\S\n]{3,}"), re.compile(r"\n[^\S\n]*\n\s+")


def _short_runs(text: str) -> str:
    """Long runs of blanks and of empty lines cut to two; no pattern below minds their length."""
    return _LINES.sub("\n\n", _BLANKS.sub("  ", text))


def _closed(pattern: re.Pattern, closer: str, to, text: str) -> str:
    """``pattern.sub`` where it can end: up to the last ``closer``."""
    end = text.rfind(closer) + len(closer)
    return text if end < len(closer) else pattern.sub(to, text[:end]) + text[end:]


def constructs(text: str) -> set[tuple[str, str]]:
    """(markup, construct) pairs in a piece of source text."""
    if not _may_hold(text):
        return set()
    text = _short_runs(text)
    found = set()
    for markup, p in _CODE:
        text, n = p.subn(" \x00 ", text)
        if n:
            found.add((markup, "code"))
    for markup, p in _FORMULA:
        text, n = p.subn(" \x00 ", text)
        if n:
            found.add((markup, "formula"))
    plain = _TABULAR.sub(" \x00 ", text)
    for markup, kind, p in _REST:
        if p.search(text if kind == "table" else plain):
            found.add((markup, kind))
    return found


# --- clean text

_SECTION = re.compile(r"\\(?:sub)*section\*?\{([^{}]*)\}|\\(?:chapter|paragraph|part)\*?\{([^{}]*)\}")
_LTX_WRAP = re.compile(r"\\(?:textbf|textit|emph|underline|textsc|texttt|url)\{([^{}]*)\}")
_LTX_CITE = re.compile(r"~?\\(?:cite[tp]?|ref|label|footnote)\*?(?:\[[^\[\]]*\])?\{[^{}]*\}")
_LTX_ENV = re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}(?:\{[lcr|]*\})?")
_LTX_TABLE = re.compile(r"\\begin\{tabular\}(?:\{[^{}]*\})?(.*?)\\end\{tabular\}", re.S)
_WIKI_TABLE = re.compile(r"\{\|[^\n|!]*(.*?)\|\}", re.S)
_MD_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)")
_WIKI_FILE = re.compile(r"\[\[(?:Файл|File|Datei|Image|Изображение|Bild):(?:[^\[\]]*\|)?([^|\[\]]*)\]\]")
_WIKI_LINK = re.compile(r"\[\[(?:[^|\[\]]*\|)?([^|\[\]]*)\]\]")


def clean_text(text: str) -> str:
    """Plain text that keeps '# ' headings, '- ' items, fenced code, formulas and table rows.

    Text without markup comes back as it is, runs of blanks aside; null gives ''.
    """
    if not text:
        return ""
    kept: list[str] = []

    def hold(s: str) -> str:
        kept.append(s)
        return f"\x00{len(kept) - 1}\x00"

    def code(m) -> str:
        body = re.sub(r"^```\w*|```$|^`|`$|^~~~|~~~$|</?(?:pre|code|syntaxhighlight|source|nowiki)\b[^<>]*>|\\(?:begin|end)\{\w+\}|^\\texttt\{|\}$", "", m.group(), flags=re.I).strip("\n")
        return hold("\n```\n" + unescape(body).strip("\n") + "\n```\n")

    for _, p in _CODE:
        text = p.sub(code, text)
    for _, p in _FORMULA:
        text = p.sub(lambda m: hold(" $" + re.sub(r"^\$+|\$+$|^\\[\[(]|\\[\])]$|\\(?:begin|end)\{\w+\*?\}|</?math[^<>]*>", "", m.group()).strip() + "$ "), text)
    text = _short_runs(text)
    text = _closed(_LTX_TABLE, "\\end{tabular}", lambda m: "\n" + "\n".join("| " + r.replace("&", "|").strip() + " |" for r in re.split(r"\\\\", m[1]) if r.strip()) + "\n", text)
    text = _SECTION.sub(lambda m: f"\n# {m[1] or m[2]}\n", text)
    text = re.sub(r"\\item\s*", "\n- ", text)
    text = _LTX_CITE.sub("", _LTX_WRAP.sub(r"\1", text))
    text = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", text)
    text = _LTX_ENV.sub("\n", text)
    text = re.sub(r"(?m)\\\\\s*$", "\n", text)
    text = re.sub(r"(?m)^[^\S\n]*={2,6}[^\S\n]*(.*?)[^\S\n]*={2,6}[^\S\n]*$", r"# \1", text)
    text = re.sub(r"(?m)^([^\n]*\S)[^\S\n]*\n\s*={3,}[^\S\n]*$", r"# \1", text)
    text = re.sub(r"(?m)^(\S(?:[^\n]*\S)?)[^\S\n]+={5,}[^\S\n]*$", r"# \1", text)
    text = re.sub(r"(?m)^[^\S\n]*[*#]+\s*(?=\[\[)", "- ", text)
    text = re.sub(r"(?m)^[^\S\n]*(?:[-+*]|\d{1,3}[.)])[^\S\n]+(?=\S)", "- ", text)
    text = re.sub(r"(?m)^[^\S\n]*#{2,6}\s+", "# ", text)
    text = _WIKI_LINK.sub(r"\1", _WIKI_FILE.sub(r"\1", text))
    text = re.sub(r"'{2,5}([^']+)'{2,5}", r"\1", text)
    text = _closed(_WIKI_TABLE, "|}", lambda m: "\n" + "\n".join("| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", r.strip().lstrip("|!").strip()) + " |" for r in re.split(r"\|-|\n(?=[|!])", m[1]) if r.strip(" |!\n")) + "\n", text)
    text = re.sub(r"(?m)^[^\S\n]*\|(?:[^\S\n]*:?-{2,}:?[^\S\n]*\|)+[^\S\n]*$\n?", "", text)
    text = _MD_LINK.sub(r"\1", text)
    text = re.sub(r"\*\*(?=\S)([^*\n]+)(?<=\S)\*\*|~~(?=\S)([^~\n]+)~~", lambda m: m[1] or m[2], text)
    text = re.sub(r"(?i)<h[1-6]\b[^<>]*>((?:[^<\n]|<(?!/?h[1-6]))*)</h[1-6]>", r"\n# \1\n", text)
    text = re.sub(r"(?i)<li\b[^<>]*>", "\n- ", text)
    text = re.sub(r"(?i)<tr\b[^<>]*>", "\n| ", text)
    text = re.sub(r"(?i)</t[dh]>", " | ", text)
    text = re.sub(r"(?i)<br\s*/?>|</?(?:p|div|ul|ol|table|tbody|thead)\b[^<>]*>", "\n", text)
    text = re.sub(r"(?i)</?(?:a|b|i|u|s|em|strong|span|img|sub|sup|small|font|mark|li|tr|td|th|hr|h[1-6])\b[^<>]*>", "", text)
    text = unescape(text)
    lines = [" ".join(x.split(" ")).strip() for x in re.sub(r"[^\S\n]+", " ", text).split("\n")]
    text = "\n".join(x for x in lines if x)
    text = re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text)
    return re.sub(r"\n{2,}", "\n", text).strip()
