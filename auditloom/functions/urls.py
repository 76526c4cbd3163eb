"""URL scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as an absolute URL (one label, a dot, letters, one more character).
FULL_URL = r"^https?://[a-zA-Z0-9_-]+\.[a-zA-Z]+[^\n]"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?"


def is_full_url(url: Column) -> Column:
    """Absolute http(s) URL; hosts without a dot, numeric hosts and upper-case schemes are not."""
    return F.coalesce(url.rlike(FULL_URL), F.lit(False))


def netloc(url: Column) -> Column:
    """User, host and port; '' where there is none."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """What follows the last occurrence of the netloc, query and fragment included; NULL without a netloc."""
    n = netloc(url)
    return F.when(n != "", F.call_function("substring_index", url, n, F.lit(-1)))


def same_site(url: Column, source: Column) -> Column:
    """Relative, or netlocs of which one is a string suffix of the other."""
    a, b = netloc(url), netloc(source)
    return ~is_full_url(url) | (a == b) | a.endswith(b) | b.endswith(a)


def is_joinable(href: Column) -> Column:
    """Whether a reference can be read as a URL: brackets in its host stand in pairs."""
    host = F.regexp_extract(F.coalesce(href, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return host.contains("[") == host.contains("]")


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is a variable, so the expression tree holds it once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(segments: Column) -> Column:
    """Path segments with . dropped and .. applied; a .. with nothing to take back stays."""

    def step(acc: Column, s: Column) -> Column:
        take = (s == "..") & (F.size(acc) > 0) & ~F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")).isin("", "..")
        return F.when(take, F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(s)))

    # a last . or .. leaves the folder it stands for
    last = F.element_at(segments, -1)
    open_ = F.when((last == ".") | ((last == "..") & (F.size(segments) > 1)), F.concat(segments, F.array(F.lit("")))).otherwise(segments)
    return F.aggregate(F.filter(open_, lambda s: s != "."), F.array().cast("array<string>"), step)


def _split(url: Column) -> Column:
    """struct of scheme (lower case), whether a host is marked, host, path and query."""
    parts = [F.lower(F.regexp_extract(url, _SCHEME, 1)), url.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:)?//"), *(F.regexp_extract(url, _PARTS, k) for k in (2, 3, 4))]
    return F.struct(url.alias("url"), *(c.alias(n) for c, n in zip(parts, ("scheme", "marked", "host", "path", "query"))))


def _joined(ref: Column, base: Column) -> Column:
    site = F.concat(base["scheme"], F.lit("://"), base["host"])
    whole = let(F.split(base["path"], "/"), lambda folder: F.concat(F.slice(folder, 1, F.size(folder) - 1), F.split(ref["path"], "/")))
    rooted = let(F.array_join(let(whole, _fold), "/"), lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))
    return (
        F.when(ref["url"] == "", base["url"])
        .when((ref["scheme"] != "") & (ref["scheme"] != base["scheme"]), ref["url"])
        .when(ref["marked"], F.concat(base["scheme"], F.lit("://"), ref["host"], ref["path"], ref["query"]))
        .when(ref["path"] == "", F.concat(site, base["path"], F.when(ref["query"] == "", base["query"]).otherwise(ref["query"])))
        .when(ref["path"].startswith("/"), F.concat(site, ref["path"], ref["query"]))
        .otherwise(F.concat(site, rooted, ref["query"]))
    )


def resolve(href: Column, base: Column) -> Column:
    """href against base, cut at the first #. Rooted paths are taken as written; other schemes are left alone."""
    full = let(F.struct(_split(F.trim(href)).alias("r"), _split(base).alias("b")), lambda x: _joined(x["r"], x["b"]))
    return F.substring_index(full, "#", 1)


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def content_hash(body: Column) -> Column:
    """SHA-256 of the body without non-ASCII characters; NULL for an empty body."""
    return F.when(body != "", F.sha2(ascii_only(body), 256))
