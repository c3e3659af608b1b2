"""URL, date and file-name expressions.  Null in, null out unless said."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted date formats, in order, and the missing-date mark.
DATE_FORMATS = ("yyyy/MM/dd", "yyyy-MM-dd", "yyyy.MM.dd", "dd/MM/yyyy", "dd.MM.yyyy")
UNKNOWN = "unknown"


def publication_date(url: Column) -> Column:
    """``yyyy/MM/dd`` from a ``news/yyyy/MM/dd/`` address, else ``unknown``."""
    found = F.regexp_extract(url, r"news/(\d{4}/\d{2}/\d{2})/", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(UNKNOWN))


def path_of(url: Column) -> Column:
    """What follows scheme and host."""
    return F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", "")


def file_name_flat(url: Column, ordinal: Column) -> Column:
    """Path with '/' and forbidden characters as '_', '.html' added where it is missing; ``article_<ordinal>`` for an empty path."""
    path = F.coalesce(F.nullif(F.trim(path_of(url), F.lit("/")), F.when(url.isNotNull(), F.lit(""))), F.when(url.isNotNull(), F.concat(F.lit("article_"), ordinal.cast("string"))))
    flat = F.replace(path, F.lit("/"), F.lit("_"))
    return F.regexp_replace(F.when(F.endswith(flat, F.lit(".html")), flat).otherwise(F.concat(flat, F.lit(".html"))), r'[<>:"|?*\\]', "_")


def file_name_capped(url: Column, ordinal: Column, limit: int = 100) -> Column:
    """The flat name; beyond ``limit`` characters its first ``limit - 5`` and '.html'."""
    name = file_name_flat(url, ordinal)
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, limit - 5), F.lit(".html"))).otherwise(name)


def file_name_last(url: Column, ordinal: Column) -> Column:
    """Last path segment, or ``article_<ordinal>.html`` where that is empty."""
    last = F.substring_index(url, "/", -1)
    return F.when(last == "", F.concat(F.lit("article_"), ordinal.cast("string"), F.lit(".html"))).otherwise(last)


def parse_date(text: Column) -> Column:
    """First accepted format that fits the whole string; otherwise null."""
    return F.coalesce(*(F.try_to_date(F.when(F.regexp_like(text, F.lit(_shape(f))), text), f) for f in DATE_FORMATS))


def _shape(fmt: str) -> str:
    return "^" + fmt.replace(".", r"\.").replace("yyyy", r"\d{4}").replace("MM", r"\d{2}").replace("dd", r"\d{2}") + "$"


def day_before(day: Column) -> Column:
    return F.date_sub(day, 1)


def without_dots(path: Column) -> Column:
    """A path that begins with '/' without its '.' and '..' segments; '..' above the root is dropped."""
    up = lambda done, s: F.when(s == "..", F.regexp_replace(done, "/[^/]*$", "")).when(s == ".", done).otherwise(F.concat(done, F.lit("/"), s))
    done = F.aggregate(F.split(F.substring(path, F.lit(2), F.length(path)), "/"), F.lit(""), up)
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?$")), F.concat(done, F.lit("/"))).otherwise(F.when(done == "", "/").otherwise(done))


def absolute(base: Column, href: Column) -> Column:
    """Resolve ``href`` against ``base``: absolute, //host, /path, relative with '.' and '..', ?query, #fragment or empty."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    whole = F.regexp_replace(base, r"#.*$", "")
    page = F.regexp_replace(whole, r"\?.*$", "")
    folder = F.regexp_replace(F.substring(page, F.length(origin) + 1, F.length(page)), r"[^/]*$", "")
    path, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    return (
        F.when(href == "", base)
        .when(F.regexp_like(href, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("#")), F.concat(whole, href))
        .when(F.startswith(href, F.lit("?")), F.concat(page, href))
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^/]*)", 1), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, without_dots(path), rest))
        .otherwise(F.concat(origin, without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), path)), rest))
    )


# Parameters that only track where a visit came from.
TRACKING = "utm_[a-z0-9_]+|fbclid|gclid|yclid|ysclid|dclid|msclkid|mc_cid|mc_eid|igshid|_openstat|_ga|from_source"


def canonical(url: Column) -> Column:
    """One spelling of a page's address.

    Scheme, letter case of the host, a leading ``www.``, default ports, doubled
    and trailing slashes, percent escapes, the fragment, tracking parameters and
    the order of parameters make no difference; other hosts and other parameters
    do.  Null stays null.
    """
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(plain, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:(?:80|443)$|\.$", "")
    host = F.regexp_replace(host, r":(?:80|443)$", "")
    path = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)
    path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    path = F.regexp_replace(F.regexp_replace(path, r"/{2,}", "/"), r"/$", "")
    query = F.regexp_extract(rest, r"\?(.*)$", 1)
    params = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(rf"(?i)^(?:{TRACKING})(?:=|$)")))
    return F.concat(host, path, F.lit("?"), F.array_join(F.array_sort(params), "&"))
