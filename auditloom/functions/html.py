"""HTML as column expressions: one cleaned text, start tags by name, attributes, element texts.

Comments and the insides of script and style are blanked first, so their text is never taken for
markup. Expressions stay in the JVM; ``parse`` stages them in projections so that each is computed once, and builds
only what the wanted fields read.

No pattern recurses or starts over as a page grows: repeated groups are possessive, which the regex engine loops over, and a
tag that never ends takes the rest of the page with it. So a hostile page costs its length, not a stack.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import built_once
from auditloom.functions.keywords import keywords
from auditloom.functions.urls import is_full_url, is_joinable, let, resolve

#: Comments, scripts and styles in one pass, so that the first to begin counts; what never ends, a start tag too, goes on to the page's end.
HIDDEN = r"(?is)(?=<[!s])(?:<!--.*?(?:-->|\z)|(<(script|style)\b[^>]*+>).*?(?:(</\2\s*+>)|\z)|(<(?:script|style)\b[^>]*+\z))"
HEAD_TAG = r"(?i)<head[\s>]"
#: Head elements that open a document without a head tag: a lenient parser supplies the head.
LEADING = r"(?is)^\s*+(?:<!doctype[^>]*+>)?\s*+(?:<html[^>]*+>)?\s*+<(?:title|meta|link|base|style|script)\b"
HEAD_END = r"(?is)(?:</head>|<body\b).*\z"
#: What stands between a tag's name and its end. A quote opens a value only behind an equals sign.
INSIDE = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+"
#: Any tag; a < that begins none is text.
ANY_TAG = rf"(?s)<[A-Za-z]{INSIDE}>|</?[A-Za-z!?][^>]*+>?"
#: What follows a reference's ampersand, and the names that need no semicolon, the longest first.
ENTITY = r"^(?:#[0-9]++|#[xX][0-9A-Fa-f]++|[A-Za-z][A-Za-z0-9]*+);?"
OLD_NAMES = "^(?:" + "|".join(sorted((n for n in html5 if n[-1] != ";"), key=len, reverse=True)) + ")"
# The characters that the numeric references 128 to 159 stand for, in order; a blank keeps the number's own.
CP1252 = "€ ‚ƒ„…†‡ˆ‰Š‹Œ Ž  ‘’“”•–—˜™š›œ žŸ"


def tag_pattern(name: str) -> str:
    """Group 1 is a closed tag. A tag without an end matches to the page's end, one with an open quote to its first >."""
    return rf"(?is)(?=<(?:{name})\b)(?:(<(?:{name})\b{INSIDE}>)|<(?:{name})\b{INSIDE}\z|<(?:{name})\b[^>]*+>?)"


def element_pattern(name: str, until: str) -> str:
    """Group 1 is a closed start tag, group 2 what follows it up to one of until or the end. On what it matched, it matches the same again."""
    inner = rf"(?:[^<]++|<(?!(?:{until})\b|/(?:{name})\s*+>))*+"
    return rf"(?is)(?=<(?:{name})\b)(?:(<(?:{name})\b{INSIDE}>)({inner})|<(?:{name})\b{INSIDE}\z|<(?:{name})\b[^>]*+>?)"


def attribute_pattern(name: str) -> str:
    """Attributes are walked from the tag's name on, so a value that holds another attribute's text is no attribute."""
    value = r"(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))?+"
    return rf"(?is)^<[a-z0-9]++(?:[\s/]++(?!{name}(?:[\s=>/]))[^\s/=>]++{value}|=[^\s>]*+)*+[\s/]++{name}(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+(?=[\s/>=])"


LONGEST = max(map(len, html5.values()))
#: Names of characters with the characters, from the standard table: as one text, which plans carry at less cost than a map.
NAMED = "".join(f"\x01{name}\x02{value}" for name, value in html5.items()) + "\x01"


def _named(table: Column, name: Column) -> Column:
    """What the table says of a name, or NULL; a name without its semicolon is its own key."""
    at = F.instr(table, F.concat(F.lit("\x01"), name, F.lit("\x02")))
    return let(at, lambda k: F.when(k > 0, F.substring_index(F.substring(table, k + F.length(name) + 2, F.lit(LONGEST + 1)), "\x01", 1)))


def _character(name: Column) -> Column:
    """What a reference stands for, by its name without & and ;, or NULL."""
    digits = F.substring(name, 2, 12)
    number = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 9), 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
    old = F.substring(F.lit(CP1252), (number - 127).cast("int"), F.lit(1))
    number = F.when(number.isNull() | (number <= 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF) | (F.length(digits) > 11), 0xFFFD).otherwise(number)
    made = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(number.between(128, 159) & (old != " "), old).otherwise(made)


def decode(c: Column) -> Column:
    """Character references as a browser reads them: named by the standard table, decimal and hexadecimal; unknown ones stay."""

    def piece(p: Column, k: Column, table: Column) -> Column:
        whole, start = F.regexp_extract(p, ENTITY, 0), F.regexp_extract(p, OLD_NAMES, 0)
        after = lambda name: F.substr(p, F.length(name) + 1)
        named = lambda name: F.when(name != "", F.concat(_named(table, name), after(name)))
        return (
            F.when(k == 0, p)
            .when(whole.startswith("#"), F.concat(_character(F.rtrim(whole, F.lit(";"))), after(whole)))
            .otherwise(F.coalesce(named(whole), named(start), F.concat(F.lit("&"), p)))
        )

    return F.when(c.contains("&"), let(F.lit(NAMED), lambda table: F.array_join(F.transform(F.split(c, "&"), lambda p, k: piece(p, k, table)), ""))).otherwise(c)


def clean(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, "$1$3$4")


def tags(c: Column, name: str) -> Column:
    return F.filter(F.regexp_extract_all(c, F.lit(tag_pattern(name)), 1), lambda t: t != "")


def elements(c: Column, name: str, until: str) -> Column:
    """(tag, inner) of each element."""
    p = element_pattern(name, until)
    found = F.transform(F.regexp_extract_all(c, F.lit(p), 0), lambda x: F.struct(*(F.regexp_extract(x, p, k).alias(n) for k, n in ((1, "tag"), (2, "inner")))))
    return F.filter(found, lambda x: x["tag"] != "")


def attribute(tag: Column, name: str) -> Column:
    """The decoded value, '' for an attribute without one; NULL if the attribute is absent."""
    p = attribute_pattern(name)
    return F.when(tag.rlike(p), decode(F.concat(*(F.regexp_extract(tag, p, k) for k in (1, 2, 3)))))


def text_of(inner: Column) -> Column:
    return decode(F.regexp_replace(inner, ANY_TAG, ""))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def has_rel(tag: Column, rel: str) -> Column:
    """rel holds the word, among others or alone; case counts."""
    return F.coalesce(F.array_contains(F.split(attribute(tag, "rel"), r"\s+"), rel), F.lit(False))


def _held(df: DataFrame) -> DataFrame:
    """df with its working columns passed through a Generate: projections above can't fold in what computes them."""
    work = [c for c in df.columns if c.startswith("_")]
    others = [c for c in df.columns if c not in work]
    return df.select(*others, F.explode(F.array(F.struct(*work))).alias("_g")).select(*others, "_g.*")


@built_once
def _links(url: str) -> Column:
    page = F.col(url)
    links = F.transform("_a", lambda x: F.struct(F.trim(F.coalesce(attribute(x["tag"], "href"), F.lit(""))).alias("href"), text_of(x["inner"]).alias("text"), attribute(x["tag"], "alt").alias("alt"), F.split(attribute(x["tag"], "rel"), r"\s+").alias("rel")))
    whole = lambda x: is_joinable(x["href"])
    links = F.transform(links, lambda x: F.struct(F.when(whole(x), resolve(x["href"], page)).otherwise(x["href"]).alias("url"), whole(x).alias("valid"), x["text"].alias("text"), x["alt"].alias("alt"), x["rel"].alias("rel")))
    return F.filter(links, lambda x: (x["url"] != "") & ~x["url"].contains("mailto:"))


@built_once
def _sources(url: str) -> Column:
    sources = F.transform("_src", lambda t: F.struct(F.trim(F.coalesce(F.nullif(attribute(t, "src"), F.lit("")), attribute(t, "href"), F.lit(""))).alias("raw"), attribute(t, "alt").alias("alt")))
    usable = F.filter(sources, lambda x: (x["raw"] != "") & is_joinable(x["raw"]))
    return F.transform(usable, lambda x: F.struct(F.when(is_full_url(x["raw"]), x["raw"]).otherwise(resolve(x["raw"], F.col(url))).alias("url"), x["alt"].alias("alt")))


def _pieces(url: str) -> dict[str, tuple[tuple[str, ...], object]]:
    """Columns by name, in an order in which each reads only earlier ones: name -> (columns it reads, what builds it).

    Names with one underscore are worked out first, those with two from held ones, others are fields of the document.
    """
    named = lambda name: first(F.filter("_metas", lambda t: F.coalesce(attribute(t, "name") == name, F.lit(False))))
    linked = lambda rel: first(F.filter("_rels", lambda t: has_rel(t, rel)))
    none = lambda: F.array().cast("array<string>")
    cut = lambda: F.regexp_replace("_c", HEAD_END, "")
    return {
        "_has": ((), lambda: F.col("_c").rlike(HEAD_TAG) | F.col("_c").rlike(LEADING)),
        "_metas": ((), lambda: F.when(F.col("_c").rlike(HEAD_TAG) | F.col("_c").rlike(LEADING), tags(cut(), "meta"))),
        "_rels": ((), lambda: F.when(F.col("_c").rlike(HEAD_TAG) | F.col("_c").rlike(LEADING), tags(cut(), "link"))),
        "_h1": ((), lambda: F.transform(elements(F.col("_c"), "h1", "h1"), lambda x: x["inner"])),
        "_a": ((), lambda: elements(F.col("_c"), "a", "a")),
        "_img": ((), lambda: tags(F.col("_c"), "img")),
        "_src": ((), lambda: tags(F.col("_c"), "img|link|script|style|meta")),
        "_links": ((), lambda: F.size(tags(F.col("_c"), "a"))),
        "_title": ((), lambda: F.when(F.col("_c").rlike(r"(?i)<title\b[^>]*+>"), decode(F.regexp_extract("_c", r"(?is)<title\b[^>]*+>(.*?)(?:</title>|\z)", 1))).otherwise(F.lit("None"))),
        "__desc": (("_metas",), lambda: named("description")),
        "__robots": (("_metas",), lambda: named("robots")),
        "__canon": (("_rels",), lambda: linked("canonical")),
        "__next": (("_rels",), lambda: linked("next")),
        "__prev": (("_rels",), lambda: linked("prev")),
        "__h1s": (("_h1",), lambda: F.transform("_h1", text_of)),
        "has_head": (("_has",), lambda: F.col("_has")),
        "title": (("_has", "_title"), lambda: F.when(F.col("_has"), F.col("_title"))),
        "has_description": (("__desc",), lambda: F.col("__desc").isNotNull()),
        "description": (("__desc",), lambda: attribute(F.col("__desc"), "content")),
        "has_canonical": (("__canon",), lambda: F.col("__canon").isNotNull()),
        "canonical": (("__canon",), lambda: attribute(F.col("__canon"), "href")),
        "has_next": (("__next",), lambda: F.col("__next").isNotNull()),
        "rel_next": (("__next",), lambda: attribute(F.col("__next"), "href")),
        "has_prev": (("__prev",), lambda: F.col("__prev").isNotNull()),
        "rel_prev": (("__prev",), lambda: attribute(F.col("__prev"), "href")),
        "robots": (("__robots",), lambda: attribute(F.col("__robots"), "content")),
        "h1s": (("__h1s",), lambda: F.col("__h1s")),
        "h1_count": (("_h1",), lambda: F.size("_h1")),
        "link_count": (("_links",), lambda: F.col("_links")),
        "img_count": (("_img",), lambda: F.size("_img")),
        "img_no_alt": (("_img",), lambda: F.size(F.filter("_img", lambda t: F.coalesce(attribute(t, "alt"), F.lit("")) == ""))),
        "size": (("_len",), lambda: F.col("_len")),
        "title_keywords": (("_title",), lambda: keywords(F.col("_title"))),
        "h1_keywords": (("__h1s",), lambda: F.when(F.size("__h1s") > 0, keywords(first(F.col("__h1s")))).otherwise(none())),
        "description_keywords": (("__desc",), lambda: F.when(F.col("__desc").isNotNull(), keywords(F.coalesce(attribute(F.col("__desc"), "content"), F.lit("None")))).otherwise(none())),
        "links": (("_a",), lambda: _links(url)),
        "sources": (("_src",), lambda: _sources(url)),
    }


#: The fields of a parsed document.
FIELDS = tuple(n for n in _pieces("url") if not n.startswith("_"))


@built_once
def _built(url: str, name: str) -> Column:
    return _pieces(url)[name][1]().alias(name)


def parse(df: DataFrame, html: str = "html", url: str = "url", parts: tuple[str, ...] = FIELDS) -> DataFrame:
    """df with the parsed pieces of each document in a struct column ``doc``; documents stay in their rows.

    parts: the fields wanted; the plan holds no pattern that only others need.
    Cases: a NULL document has a NULL doc; a document without head has has_head false and NULL fields. Columns of df whose
    names begin with an underscore are kept; those of the working columns must not be among them.
    """
    pieces = _pieces(url)
    parts = tuple(n for n in FIELDS if n in parts)
    wanted: set[str] = set(parts)
    for n in reversed(pieces):
        if n in wanted:
            wanted |= set(pieces[n][0])
    own = [c for c in df.columns if c.startswith("_")]
    a = df.withColumnsRenamed({c: f"kept{c}" for c in own})
    source = html if html not in own else f"kept{html}"
    body = F.coalesce(F.col(source), F.lit(""))
    work = {"_there": F.col(source).isNotNull()} | ({"_len": F.length(body)} if "_len" in wanted else {})
    early, late = ([n for n in pieces if n in wanted and n.startswith("_") and n.startswith("__") == two] for two in (False, True))
    a = a.withColumns(work)
    if early:
        a = _held(a.withColumn("_c", clean(body)))
        a = a.withColumns({n: _built(url, n) for n in early}).drop("_c")
    if late:
        a = _held(a).withColumns({n: _built(url, n) for n in late})
    if early:
        a = _held(a)
    doc = F.struct(*[_built(url, n) for n in parts]) if parts else F.struct(F.col("_there").alias("there"))
    a = a.withColumn("doc", F.when(F.col("_there"), doc))
    return a.select(*[F.col(f"kept{c}").alias(c) if c in own else F.col(c) for c in df.columns], "doc")
