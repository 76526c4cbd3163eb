"""The HTML and URL functions for SQL users: functions defined in SQL, among them a table function for LATERAL.

``register(spark)`` creates, as temporary functions of the session:

* ``url_join(href, base)`` – href against base, as :func:`auditloom.functions.urls.resolve`;
* ``html_text(html)`` – text without tags, references decoded;
* ``html_attribute(tag, name)`` – the decoded value of a start tag's attribute, NULL if it is absent;
* ``html_links(html, url)`` – the array of a page's links;
* ``extract_links(html, url)`` – the same as a table: ``SELECT page_id, l.* FROM pages, LATERAL extract_links(html, url) l``.

Spark answers a lateral table function of this kind for each distinct page and joins the answers back, so pages are shuffled. On large tables
``html_links`` with a LATERAL VIEW, as in :func:`page_links`, is one narrow stage.

Spark inlines their bodies, so a query with them is one plan of built-in functions without a Python worker. Bodies share the
patterns of the column functions, and tests hold the results against those. A function defined in SQL can't be called inside a lambda,
so what ``html_links`` does to each link is written out in its body.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import DataFrame, SparkSession

from auditloom.functions import html as H
from auditloom.functions import urls as U


def text(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _with_names(body: str) -> str:
    """body, which reads the names of characters as m."""
    return let(f"from_json({text(json.dumps(html5))}, 'map<string,string>')", "m", body)


def _decoded(c: str) -> str:
    number = "CASE WHEN d RLIKE '^[xX]' THEN CAST(conv(substring(d, 2, 8), 16, 10) AS BIGINT) ELSE try_cast(d AS BIGINT) END"
    usual = "CASE WHEN n IS NULL OR n <= 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 OR length(d) > 11 THEN 65533 ELSE n END"
    old = f"substring({text(H.CP1252)}, CAST(n - 127 AS INT), 1)"
    made = f"CASE WHEN n BETWEEN 128 AND 159 AND {old} <> ' ' THEN {old} ELSE decode(unhex(lpad(hex(n), 8, '0')), 'UTF-32') END"
    character = let("substring(rtrim(';', w), 2, 12)", "d", let(number, "n", let(usual, "n", made)))
    after = lambda name: f"substr(p, length({name}) + 1)"
    body = f"""CASE WHEN startswith(w, '#') THEN concat({character}, {after('w')})
        WHEN try_element_at(m, w) IS NOT NULL THEN concat(try_element_at(m, w), {after('w')})
        WHEN s <> '' THEN concat(try_element_at(m, s), {after('s')}) ELSE concat('&', p) END"""
    piece = let(f"regexp_extract(p, {text(H.ENTITY)}, 0)", "w", let(f"regexp_extract(p, {text(H.OLD_NAMES)}, 0)", "s", body))
    return f"CASE WHEN contains({c}, '&') THEN array_join(transform(split({c}, '&'), (p, k) -> CASE WHEN k = 0 THEN p ELSE {piece} END), '') ELSE {c} END"


def _decode(c: str) -> str:
    return let(c, "c", _decoded("c"))


def _attribute(tag: str, name: str) -> str:
    """name: an SQL expression."""
    pattern = f" || {name} || ".join(text(x) for x in H.attribute_pattern("\0").split("\0"))
    value = " || ".join(f"regexp_extract({tag}, {pattern}, {k})" for k in (1, 2, 3))
    return f"CASE WHEN {tag} RLIKE ({pattern}) THEN {_decode(value)} END"


def _text(inner: str) -> str:
    return _decode(f"regexp_replace({inner}, {text(H.ANY_TAG)}, '')")


def _split(url: str) -> str:
    host, path, query = (f"regexp_extract({url}, {text(U._PARTS)}, {k})" for k in (2, 3, 4))
    scheme, marked = f"lower(regexp_extract({url}, {text(U._SCHEME)}, 1))", f"{url} RLIKE {text('^([A-Za-z][A-Za-z0-9+.-]*:)?//')}"
    return f"named_struct('url', {url}, 'scheme', {scheme}, 'marked', {marked}, 'host', {host}, 'path', {path}, 'query', {query})"


def _join(href: str, base: str) -> str:
    takes = "s = '..' AND size(acc) > 0 AND coalesce(try_element_at(acc, -1), '') NOT IN ('', '..')"
    fold = f"aggregate(filter(o, s -> s <> '.'), CAST(array() AS ARRAY<STRING>), (acc, s) -> CASE WHEN {takes} THEN slice(acc, 1, size(acc) - 1) ELSE concat(acc, array(s)) END)"
    opened = let("element_at(g, -1)", "e", "CASE WHEN e = '.' OR (e = '..' AND size(g) > 1) THEN concat(g, array('')) ELSE g END")
    whole = let("split(b.path, '/')", "f", "concat(slice(f, 1, size(f) - 1), split(r.path, '/'))")
    rooted = let(f"array_join({let(whole, 'g', let(opened, 'o', fold))}, '/')", "y", "CASE WHEN startswith(y, '/') THEN y ELSE '/' || y END")
    full = f"""CASE WHEN r.url = '' THEN b.url WHEN r.scheme <> '' AND r.scheme <> b.scheme THEN r.url
        WHEN r.marked THEN b.scheme || '://' || r.host || r.path || r.query
        WHEN r.path = '' THEN b.scheme || '://' || b.host || b.path || CASE WHEN r.query = '' THEN b.query ELSE r.query END
        WHEN startswith(r.path, '/') THEN b.scheme || '://' || b.host || r.path || r.query
        ELSE b.scheme || '://' || b.host || {rooted} || r.query END"""
    return f"substring_index({let(f'trim({href})', 'h', let(_split('h'), 'r', let(_split(base), 'b', full)))}, '#', 1)"


def _links(html: str, url: str) -> str:
    anchor = text(H.element_pattern("a", "a"))
    cleaned = let(f"regexp_replace({html}, {text(H.HIDDEN)}, '$1$3$4')", "t", f"arrays_zip(regexp_extract_all(t, {anchor}, 1), regexp_extract_all(t, {anchor}, 2))")
    host = f"regexp_extract(j, {text(r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)')}, 1)"
    whole = f"contains({host}, '[') = contains({host}, ']')"
    link = let(
        f"trim(coalesce({_attribute('x.tag', text('href'))}, ''))",
        "j",
        let(whole, "v", f"named_struct('url', CASE WHEN v THEN {_join('j', url)} ELSE j END, 'valid', v, 'text', {_text('x.inner')}, 'alt', {_attribute('x.tag', text('alt'))}, 'rel', split({_attribute('x.tag', text('rel'))}, {text(chr(92) + 's+')}))"),
    )
    rows = f"transform(filter(transform({cleaned}, z -> named_struct('tag', z['0'], 'inner', z['1'])), x -> x.tag <> ''), x -> {link})"
    return f"filter({rows}, l -> l.url <> '' AND NOT contains(l.url, 'mailto:'))"


LINK = "url STRING, valid BOOLEAN, text STRING, alt STRING, rel ARRAY<STRING>"


def statements() -> list[str]:
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    typed = LINK.replace(" ", ": ").replace(",: ", ", ")
    return [
        f"{make} url_join(href STRING, base STRING) RETURNS STRING RETURN {_join('href', 'base')}",
        f"{make} html_text(html STRING) RETURNS STRING RETURN {_with_names(_text('html'))}",
        f"{make} html_attribute(tag STRING, name STRING) RETURNS STRING RETURN {_with_names(_attribute('tag', 'name'))}",
        f"{make} html_links(html STRING, url STRING) RETURNS ARRAY<STRUCT<{typed}>> RETURN {_with_names(_links('html', 'url'))}",
        f"{make} extract_links(html STRING, url STRING) RETURNS TABLE(pos BIGINT, {LINK}) RETURN SELECT CAST(k AS BIGINT), q.url, q.valid, q.text, q.alt, q.rel FROM (SELECT posexplode_outer(found) AS (k, q) FROM (SELECT html_links(extract_links.html, extract_links.url) AS found)) WHERE k IS NOT NULL",
    ]


def register(spark: SparkSession) -> None:
    """Create the functions in the session. Cases: NULL html has no links; NULL url joins to NULL, so such a page has none either."""
    for s in statements():
        spark.sql(s)


def page_links(spark: SparkSession, pages: str) -> DataFrame:
    """(page_id, pos, link, text) of a view's pages, in SQL. OUTER keeps the optimiser from filtering by the links first, for which they would be computed twice."""
    register(spark)
    return spark.sql(f"""SELECT page_id, CAST(pos AS BIGINT) AS pos, x.url AS link, x.text AS text
        FROM (SELECT page_id, html_links(html, url) AS links FROM {pages}) LATERAL VIEW OUTER posexplode(links) AS pos, x WHERE pos IS NOT NULL""")
