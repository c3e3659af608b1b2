"""Text extraction from HTML.

Everything is Column expressions: an element's inside is cut by splitting what follows
its opening tag at the tags of the same name and summing their depths.  Null pages give
null, empty pages the empty string.
"""

from __future__ import annotations

import re
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements dropped before text is taken.
REPORT_DROP = ("script", "style", "nav", "header", "footer", "iframe")
GENERIC_DROP = ("script", "style", "nav", "header", "footer", "aside")
SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
#: Characters of the named references, and of numbers that stand for bytes of cp1252.
NAMED = {name: chr(code) for name, code in sorted(name2codepoint.items())}
BYTES = {b: bytes([b]).decode("cp1252") for b in range(128, 160) if bytes([b]).decode("cp1252", "ignore")}
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,7});"


def normalize_space(text: Column) -> Column:
    """Unicode whitespace runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def _map(of: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{k!r}, '{v}'" for k, v in of.items()) + ")")


def _character(ref: Column) -> Column:
    """Character of one reference; unknown names stay, numbers of no character give U+FFFD."""
    inner = F.substring(ref, F.lit(2), F.length(ref) - 2)
    code = F.when(F.regexp_like(inner, F.lit("^#[xX]")), F.conv(F.substring(inner, F.lit(3), F.length(inner)), 16, 10).cast("bigint")).when(F.startswith(inner, F.lit("#")), F.substring(inner, F.lit(2), F.length(inner)).cast("bigint"))
    none = (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(code.isNull(), F.coalesce(F.try_element_at(_map(NAMED), inner), ref)).when(none, F.lit("\ufffd")).otherwise(F.coalesce(F.try_element_at(_map(BYTES), code.cast("int")), char))


def decode_entities(text: Column) -> Column:
    """Character references, named and numeric, decoded once; only those that end in a semicolon."""
    refs = F.array_remove(F.array_distinct(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))), "&amp;")
    plain = F.aggregate(refs, text, lambda t, r: F.replace(t, r, _character(r)))
    return F.when(F.contains(text, F.lit("&")), F.replace(plain, F.lit("&amp;"), F.lit("&"))).otherwise(text)  # '&amp;' last: nothing is decoded twice


def drop_elements(html: Column, names) -> Column:
    html = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    return reduce(lambda h, n: F.regexp_replace(h, rf"(?is)<{n}\b[^>]*>.*?</{n}\s*>", ""), names, html)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "(?s)<[^>]*>", "\n")


def report_text(html: Column) -> Column:
    """Visible text of the body for size reports; '' where there is no body."""
    kept = drop_elements(html, REPORT_DROP)
    body = F.regexp_extract(kept, r"(?is)<body\b[^>]*>(.*?)</body\s*>", 1)
    return let(strip_tags(body), lambda t: normalize_space(decode_entities(t)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# What holds the text of a page of unknown layout, in order; names with a dot are classes.
GENERIC_BOXES = ("article", ".article", ".post-content", ".content", "main", ".main-content", "body")


def opening(selector: str) -> str:
    """Pattern of the opening tag of an element ``name``, ``.class`` or ``name#id``; no engine-specific syntax."""
    name, mark, key = re.fullmatch(r"([a-z]*)([.#]?)(.*)", selector).groups()
    if mark == "#":
        return rf"(?s)<(?i:{name})\s(?:[^>]*\s)?(?i:id)\s*=\s*(?:[\"']{key}[\"'][^>]*|{key}(?:\s[^>]*)?)>"
    if mark == ".":
        return rf"(?s)<(?i:{name or '[a-z][a-z0-9]*'})\s(?:[^>]*\s)?(?i:class)\s*=\s*(?:\"(?:[^\"]*\s)?{key}(?:\s[^\"]*)?\"[^>]*|'(?:[^']*\s)?{key}(?:\s[^']*)?'[^>]*|{key}(?:\s[^>]*)?)>"
    return rf"(?is)<{selector}(?:\s[^>]*)?>"


def _inside(html: Column, tag: Column, name: Column, keep: str) -> Column:
    """What follows the first ``tag`` up to its element's end; to the end of the page where it is not closed.

    ``keep`` is "source" for all of it, "text" for the pieces between tags of the same
    name, on lines of their own, and "own" for those in no further element of that name.
    """
    same = F.concat(F.lit("(?is)</?"), name, F.lit(r"(?:\s[^>]*)?>"))
    rest = F.substring(html, F.instr(html, tag) + F.length(tag), F.length(html))

    def pieces(rest: Column) -> Column:
        # Depth after each tag of that name, 1 at the start.
        tags = F.regexp_extract_all(rest, same, F.lit(0))
        steps = F.transform(tags, lambda t: F.when(F.startswith(t, F.lit("</")), -1).when(F.endswith(t, F.lit("/>")), 0).otherwise(1))
        depths = F.aggregate(steps, F.array(F.lit(1)), lambda d, s: F.concat(d, F.array(F.element_at(d, -1) + s)))
        parts = F.split(rest, same)
        end = F.array_position(depths, 0)
        kept = F.when(end > 0, F.slice(parts, 1, F.greatest(end - 1, F.lit(1)).cast("int"))).otherwise(parts)
        if keep == "source":
            return F.array_join(F.transform(kept, lambda p, i: F.when(i + 1 < F.size(kept), F.concat(p, F.coalesce(F.get(tags, i), F.lit("")))).otherwise(p)), "")
        if keep == "text":
            return F.array_join(kept, "\n")
        return F.array_join(F.filter(F.transform(kept, lambda p, i: F.when(F.get(depths, i) == 1, p)), lambda p: p.isNotNull()), "\n")

    return let(rest, pieces)


def element_text(html: Column, tag: Column, keep: str = "text") -> Column:
    """Inside of the element that the opening ``tag`` begins; '' for the empty tag."""
    name = F.lower(F.regexp_extract(tag, "^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    return F.when(tag == "", F.lit("")).otherwise(_inside(html, tag, name, keep))


def first_tag(html: Column, selectors) -> Column:
    """Opening tag of the first selector that the page has; '' without any."""
    def found(x: str) -> Column:
        tag = F.nullif(F.regexp_extract(html, opening(x), 0), F.lit(""))
        key = re.split("[.#]", x)[1:]
        return F.when(F.contains(html, F.lit(key[0])), tag) if key else tag  # most pages lack the name: a plain search spares the pattern

    return F.coalesce(*map(found, selectors), F.lit(""))


def generic_text(html: Column) -> Column:
    """Text of the first of ``GENERIC_BOXES`` that the page has, be it empty; '' where none is found."""
    kept = F.when(html.isNotNull(), drop_elements(html, GENERIC_DROP))
    found = let(kept, lambda k: let(first_tag(k, GENERIC_BOXES), lambda t: element_text(k, t)))
    return F.when(html.isNotNull(), let(strip_tags(found), lambda t: normalize_space(decode_entities(t))))


# Boxes of the two site layouts and what is dropped from them.
SITE_A_BOXES, SITE_A_DROP = ("div#content", "div.post_content"), ("script", "style", "ins", "iframe")
SITE_B_BOX, SITE_B_TEXT = ("div#content",), ("div#textblock",)


def _strings(html: Column, joint: str) -> Column:
    """Stripped strings between tags, empty ones dropped."""
    parts = F.transform(F.split(html, "(?s)<[^>]*>"), lambda p: normalize_space(decode_entities(p)))
    return F.array_join(F.filter(parts, lambda p: p != ""), joint)


def site_a_text(html: Column) -> Column:
    """Layout A: paragraphs of #content or .post_content outside of nested blocks, their strings run together."""
    box = let(F.regexp_replace(html, "(?s)<!--.*?-->", ""), lambda h: let(first_tag(h, SITE_A_BOXES), lambda t: element_text(h, t, "own")))
    kept = drop_elements(box, SITE_A_DROP)
    paragraphs = F.transform(F.regexp_extract_all(kept, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"), F.lit(1)), lambda p: _strings(p, ""))
    return F.when(html.isNotNull(), F.array_join(F.filter(paragraphs, lambda p: p != ""), " "))


def site_b_text(html: Column) -> Column:
    """Layout B: #textblock inside #content, nested divs and headlines removed."""
    def text(box: Column) -> Column:
        whole = _inside(F.concat(F.lit("<div>"), box), F.lit("<div>"), F.lit("div"), "own")
        return let(first_tag(box, SITE_B_TEXT), lambda t: F.when(t == "", whole).otherwise(element_text(box, t, "own")))

    content = let(F.regexp_replace(html, "(?s)<!--.*?-->", ""), lambda h: let(first_tag(h, SITE_B_BOX), lambda t: element_text(h, t, "source")))
    return F.when(html.isNotNull(), let(drop_elements(content, ("h1",)), lambda k: _strings(text(k), " ")))


# Parts of the addresses of the two sites with layouts of their own.
SITE_A, SITE_B = "f1news.ru", "f1report.ru"


def page_text(html: Column, url: Column, site_a: str = SITE_A, site_b: str = SITE_B) -> Column:
    """Layout chosen by a part of the address; generic otherwise."""
    a, b = url.contains(site_a), url.contains(site_b) & ~url.contains(site_a)
    generic = F.when(~(F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))), html)
    return F.coalesce(site_a_text(F.when(a, html)), site_b_text(F.when(b, html)), generic_text(generic))


def char_count(text: Column) -> Column:
    return F.length(text)


def word_count(text: Column) -> Column:
    """Words of normalized text; 0 for the empty one."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " ")))


HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


# A news link, and elements and classes of items of a listing.
NEWS = "/news/"
ITEM_TAGS = ("div", "article", "li")
ITEM_CLASS = r"""(?i)\sclass\s*=\s*(?:"[^"]*(?:news|article|item)|'[^']*(?:news|article|item)|[^"'\s>]*(?:news|article|item))"""
_LISTING = r"(?i)</?(?:div|article|li)(?:\s[^>]*)?>|<a\s[^>]*>"


def listing_links(html: Column, day: Column, mark: str = NEWS) -> Column:
    """Links with ``mark`` of a listing page, as an array: those that name ``day``, and those inside an item.

    An item is a div, article or li with a class of news, articles or items.  One pass
    over these tags keeps, for each name, which of the open elements are items.
    """
    closed = lambda s, t: F.when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)

    def moved(stack: Column, t: Column, name: str) -> Column:
        mine = F.regexp_like(t, F.lit(rf"(?i)^</?{name}[\s>]"))
        return F.when(~mine | F.endswith(t, F.lit("/>")), stack).when(F.startswith(t, F.lit("</")), closed(stack, t)).otherwise(F.concat(stack, F.array(F.regexp_like(t, F.lit(ITEM_CLASS)))))

    def step(state: Column, t: Column) -> Column:
        href = F.regexp_extract(t, HREF, 1)
        inside = reduce(lambda a, b: a | b, (F.array_contains(state[n], True) for n in ITEM_TAGS))
        wanted = F.contains(href, F.lit(mark)) & (inside | F.coalesce(F.contains(href, day), F.lit(False)))
        return F.struct(*(moved(state[n], t, n).alias(n) for n in ITEM_TAGS), F.when(wanted, F.concat(state["found"], F.array(href))).otherwise(state["found"]).alias("found"))

    none = F.array().cast("array<boolean>")
    start = F.struct(*(none.alias(n) for n in ITEM_TAGS), F.array().cast("array<string>").alias("found"))
    tags = F.regexp_extract_all(F.regexp_replace(html, "(?s)<!--.*?-->", ""), F.lit(_LISTING), F.lit(0))
    return F.array_distinct(F.aggregate(tags, start, step, lambda s: s["found"]))
