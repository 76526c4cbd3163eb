"""The parse against the standard library's parser, on made-up, broken and hostile markup."""

import random
from html import unescape
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from auditloom.functions.html import FIELDS, decode, parse
from auditloom.operators.lint import lint_html

URL = "http://h.example.com/d/"


class Twin(HTMLParser):
    """Start tags with their attributes, texts of title, h1 and a. A new a or h1 ends the one before, as lenient parsers do."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.open, self.text = [], {}, {"title": [], "h1": [], "a": []}

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.tags.append((tag, first))
        if tag in self.text:
            self.open[tag] = len(self.text[tag])
            self.text[tag].append("")

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        self.open.pop(tag, None)

    def handle_data(self, data):
        for tag, k in self.open.items() if not self.cdata_elem else ():  # code is no text
            self.text[tag][k] += data


def twin(html):
    t = Twin()
    t.feed(html)
    t.close()
    return t


def parsed(spark, pages, **kw):
    df = spark.createDataFrame([(k, p, URL) for k, p in enumerate(pages)], "k int, html string, url string")
    return [x.doc for x in parse(df, **kw).orderBy("k").collect()]


def agree(doc, html):
    t = twin(html)
    number = lambda *names: sum(x in names for x, _ in t.tags)
    assert doc.link_count == number("a") and doc.h1_count == number("h1") and doc.img_count == number("img"), html
    assert list(doc.h1s) == t.text["h1"], html
    assert doc.img_no_alt == sum(x == "img" and not a.get("alt") for x, a in t.tags), html
    assert [x.alt for x in doc.sources] == [a.get("alt") for x, a in t.tags if x in ("img", "link", "script", "style", "meta") and ((a.get("src") or a.get("href")) or "").strip()], html
    links = [(a, text) for (x, a), text in zip([x for x in t.tags if x[0] == "a"], t.text["a"]) if "mailto:" not in a.get("href", "")]
    assert [(x.text, x.alt) for x in doc.links] == [(text, a.get("alt")) for a, text in links], html


def value(r):
    return r.choice(["", "x", "a b", "it&#39;s", "1 > 0", "<b>", "q&amp;a", "é&eacute;&#233;", "href=", " src='z'", "alt=\"no"]).replace('"', "")


def tag(r, name):
    out = f"<{name if r.random() < 0.8 else name.upper()}"
    for _ in range(r.randint(0, 4)):
        k, v, quote = r.choice(["href", "src", "alt", "rel", "class", "data-href", "title", "HREF"]), value(r), r.choice("\"\"'n-")
        out += r.choice([" ", "  ", "\n", "\t"]) + k
        if quote == "n":
            out += "=" + ("".join(c for c in v if c.isalnum()) or "u")
        elif quote != "-":
            out += r.choice(["=", " = ", "= "]) + quote + v.replace(quote, "") + quote
    return out + r.choice([">", " >", "/>" if name == "img" else ">"])


def page(r, broken):
    body = []
    for _ in range(r.randint(0, 12)):
        name = r.choice(["a", "img", "h1", "p", "b", "div", "link", "meta", "abbr"])
        body.append(tag(r, name) + r.choice(["", "text", "a &amp b", "x &lt;y", "&unknown; z", "&copy2", "&#8211;&#x27;"]))
        if name not in ("img", "link", "meta") and r.random() < (0.8 if broken else 1):
            body.append(f"</{name}>")
    body += r.sample(["<!-- <h1>no</h1> <a href=x> -->", "<script>if (a<b) '<a href=1>'; // <!-- </script>", "<style>h1 { }</style>", "< a href=x>", "1 < 2 > 1"], r.randint(0, 3))
    r.shuffle(body) if broken else None
    return "<html><head><title>t</title></head><body>" + "".join(body) + "</body></html>"


@pytest.mark.parametrize("broken", [False, True])
def test_random_markup(spark, broken):
    r = random.Random(int(broken))
    pages = [page(r, broken) for _ in range(300)]
    for doc, html in zip(parsed(spark, pages), pages):
        agree(doc, html)


def test_references(spark):
    texts = ["&#8211; &eacute; &#x27; &#X41;&#65", "&amp;lt; &lt &copy2 &notit; &not; &unknown; & &; &#; &#x; &#0; &#128;&#150; &#1114112; &#xD800;", "no reference", "&AMP&amp", "&NotEqualTilde; &acE;", "a&b&&amp;c", "&#99999999999999999999;"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode(F.col("t")).alias("d"), decode(F.lit(None).cast("string")).alias("n")).collect()
    for x in got:
        assert x.n is None and x.d == unescape(x.t), x.t


def test_hostile_pages(spark):
    """A page costs its length: no stack, no start from the beginning for each of its tags."""
    n = 100_000
    many = "".join(f' a{k}="v"' for k in range(n))
    pages = [
        f"<head></head><a{many} href='/x'>l</a>", f"<head></head><img{many}", "<head></head>" + "<a " * n, "<head></head>" + '<a href="' * n, "<head></head>" + '<a b=">" ' * n,
        "<head></head>" + "<script>" * n, "<head></head>" + "<!--" * n, "<head></head>" + "<h1>" * n, "<head></head>" + "&" * n, "<head></head><a href=" + "'\"" * n + ">", "<head><title>" + "<" * n,
        "<head></head><meta" + " x" * n + " name=robots content=noindex>", "<head>" + "<link rel='" + "a " * n + "next' href=/n>",
    ]
    docs = parsed(spark, pages)
    assert [x.url for x in docs[0].links] == ["http://h.example.com/x"] and docs[7].h1_count == n and docs[1].img_count == 0
    assert docs[12].has_next and docs[12].rel_next == "/n" and docs[11].robots is None and all(d.has_head for d in docs)


#: Prefixes that a hostile page may repeat.
HOSTILE = ("<script ", "<style x", "<script>", "</script", "<!--", "<!", "<title>", "<h1>", "<h1 ", "<a ", "<a href=x>", '<a href="', "<a b=", "<img src='", '<meta content="', "<link rel=", "&amp", "&#", "<", "</a", "<b>")


def test_time_grows_with_the_page(spark):
    """Twice the page, about twice the time, for every prefix."""
    import time

    def took(n):
        df = spark.createDataFrame([(f"<head></head>{x * n}", URL) for x in HOSTILE], "html string, url string").coalesce(1)
        began = time.time()
        parse(df).write.format("noop").mode("overwrite").save()
        return time.time() - began

    took(10)
    small, large = took(10_000), took(40_000)
    # of all pages together: one that took the square would take 16 times as long
    assert large < 6 * small + 5, (small, large)


def test_a_start_tag_that_never_ends_takes_the_rest(spark):
    (doc,) = parsed(spark, ["<head><title>t</title></head><a href=/x>l</a><script <a href=/y m"])
    assert [x.text for x in doc.links] == ["l"] and doc.title == "t"


def test_malformed_links(spark):
    hrefs = ["http://[bad", "//x]/y", "http://[::1]/ok", "/fine[1]", "ok", "mailto:[x"]
    (doc,) = parsed(spark, ["<head></head>" + "".join(f'<a href="{h}">t</a>' for h in hrefs)])
    assert [(x.url, x.valid) for x in doc.links] == [("http://[bad", False), ("//x]/y", False), ("http://[::1]/ok", True), ("http://h.example.com/fine[1]", True), ("http://h.example.com/d/ok", True)]


def test_only_what_is_wanted_is_in_the_plan(spark):
    df = spark.createDataFrame([("<head><title>t</title></head><a href=x>", URL)], "html string, url string")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    whole = parsed(spark, ["<head><title>t</title></head><h1>h</h1><a href=x>"])[0]
    for name in FIELDS:
        assert parsed(spark, ["<head><title>t</title></head><h1>h</h1><a href=x>"], parts=(name,))[0][name] == whole[name]
    title = plan(parse(df, parts=("title",)))
    assert "title" in title and "href" not in title and "regexp_extract_all" not in title
    assert "regexp" not in plan(parse(df, parts=())).lower() and "regexp" not in plan(parse(df, parts=("size",))).lower()
    assert "lint" in lint_html(parse(df)).columns


def test_elements_and_their_texts_take_one_pass(spark):
    pages = spark.createDataFrame([("<html><head></head><body><h1>a<b>b</b></h1><H1 x>c", "http://a.example.com/")], "html string, url string")
    found = parse(pages, parts=("h1s", "link_count"))
    assert found.first()["doc"]["h1s"] == ["ab", "c"]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
