"""Blocks of a page: the text between two block-level tags.

Definition (fixed by the data contract): inline tags a, b, i, u, em, strong,
span vanish without a gap; every other tag ends a block; head, script, style,
noscript and comments hold none; a record without any tag has one block per
line; character references are decoded once, runs of Unicode whitespace become
one space, ends are trimmed and empty blocks are dropped.

``None`` and the empty string have no blocks.  Unclosed head/script/style/
noscript elements and comments run to the end of the record.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

INLINE_TAGS = ("a", "b", "i", "u", "em", "strong", "span")
SILENT_TAGS = ("head", "script", "style", "noscript")

_ANY_TAG = re.compile(r"<[a-zA-Z/!?]")
_SILENT = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(SILENT_TAGS) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)",
    re.S | re.I,
)
_INLINE = re.compile(r"</?(?:" + "|".join(INLINE_TAGS) + r")(?:\s[^>]*)?/?>", re.I)
_BREAK = re.compile(r"<[a-zA-Z/!?][^>]*>")
_BREAK_KEEP = re.compile(r"(<[a-zA-Z/!?][^>]*>)")
def has_tags(html: str) -> bool:
    return _ANY_TAG.search(html) is not None


_LINE = re.compile(r"\r\n?|\n")


def raw_blocks(html: str | None) -> list[str]:
    """Block sources: inline tags gone, references and whitespace untouched."""
    if not html:
        return []
    if _ANY_TAG.search(html) is None:
        return _LINE.split(html)
    return _BREAK.split(_INLINE.sub("", _SILENT.sub("<!>", html)))


def clean(raw: str) -> str:
    """A block's text from its source; may be empty."""
    if "&" in raw:
        raw = unescape(raw)
    return " ".join(raw.split())


def blocks(html: str | None) -> list[str]:
    """The record's blocks in document order."""
    return [c for c in map(clean, raw_blocks(html)) if c]


_NAME = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9]*)")
_CLASS = re.compile(r"(?:class|id)\s*=\s*[\"']?([^\"'>]*)", re.I)
_VOID = frozenset("br hr img input meta link wbr area base col embed source track".split())
#: Elements whose end tag may be left out; a new one of the set closes the last.
_IMPLIED = frozenset("p li td tr dt dd option".split())


@lru_cache(65536)
def _tag(text: str) -> tuple[int, str, str]:
    """(0 ignore, 1 open, -1 close; name; path step) of a tag's source."""
    m = _NAME.match(text)
    if m is None or m[1].lower() in _VOID:
        return 0, "", ""
    name = m[1].lower()
    if text[1] == "/":
        return -1, name, ""
    c = _CLASS.search(text)
    return 1, name, f"{name}.{c[1].strip().lower()}" if c else name


def raw_blocks_with_paths(html: str | None) -> list[tuple[str, tuple[str, ...]]]:
    """Block sources and, for each, the open elements as ``tag`` or ``tag.class``.

    End tags that match nothing are ignored; implied end tags of p, li, td, tr,
    dt, dd and option are supplied.
    """
    if not html:
        return []
    if _ANY_TAG.search(html) is None:
        return [(b, ("#text",)) for b in _LINE.split(html)]
    parts = _BREAK_KEEP.split(_INLINE.sub("", _SILENT.sub("<!>", html)))
    stack: list[tuple[str, str]] = []
    path: tuple[str, ...] | None = ()
    out = []
    for i, part in enumerate(parts):
        if i & 1:
            kind, name, step = _tag(part)
            if kind == 0:
                continue
            if kind < 0:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            else:
                if name in _IMPLIED and stack and stack[-1][0] in _IMPLIED and (stack[-1][0] == name or name == "tr" or stack[-1][0] == "p"):
                    stack.pop()
                stack.append((name, step))
            path = None
        elif part and not part.isspace():
            if path is None:
                path = tuple([s for _, s in stack])
            out.append((part, path))
    return out


def blocks_with_paths(html: str | None) -> list[tuple[str, tuple[str, ...]]]:
    return [(c, p) for r, p in raw_blocks_with_paths(html) if (c := clean(r))]
