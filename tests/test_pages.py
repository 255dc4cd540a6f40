"""Page parsing: reference behaviour on inline pages, and each quirk."""

import datetime as dt
import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from jobloom.functions import markup
from jobloom.functions.text import collapse
from jobloom.operators import pages

AS_OF = dt.datetime(2026, 4, 30, 12)


def ld(**fields):
    return json.dumps({"@context": "https://schema.org/", "@type": "JobPosting"} | fields)


def script(text):
    return f'<html><head><script type="application/ld+json">\n{text}\n</script></head>'


def lines(*items, title="Data Engineer", head=""):
    shown = "".join(f"<p>{i}</p>" for i in items)
    return f"<html><head>{head}</head><body><h1>{title}</h1>{shown}</body></html>"


PAGES = {
    "plain": "<html><head><title>Ignored</title></head><body><h1>Harbour Pilot</h1>"
             "<p>Tides are read at dawn.</p><p>Berth: Oslo, NO</p></body></html>",
    "posting": script(ld(
        title="Glass Blower", hiringOrganization={"name": "Kiln & Co"},
        jobLocation={"address": {"addressLocality": "Murano", "addressRegion": "VE",
                                 "addressCountry": "IT"}},
        description="Works hot glass; some Terraform helps.",
    )) + "<body><h1>Not read</h1></body></html>",
    "shared": '<html><head><meta property="og:title" content="Bell Ringer"></head><body></body></html>',
    "bare": "<html><body><p>Only one sentence stands here.</p></body></html>",
    "custom": "<html><body><h1>T</h1><nav-item>x</nav-item><header-bar>y</header-bar>"
              "<style-guide>z</style-guide><p>We use Python</p></body></html>",
    "custom_h1": "<html><body><h1-x>q</h1-x><h1>H</h1></body></html>",
    "marks": "<html><body><h1>a\x02b</h1><p>c\x01d\x05</p></body></html>",
    "empty_h1": '<html><head><meta property="og:title" content="X"></head>'
                "<body><h1></h1></body></html>",
    "ld_list": script(f'[{{"@type": "Thing"}}, {ld(title="Second")}]') + "</html>",
    "ld_graph": script(f'{{"@graph": [{ld(title="Hidden")}]}}') + "<h1>Shown</h1></html>",
    "ld_broken": script("{oops") + script(ld(title="Kept")) + "</html>",
    "ld_iso_date": script(ld(title="T", datePosted="2026-04-01")) + "</html>",
    "ld_num_date": script(ld(title="T", datePosted=20260401)) + "</html>",
    "ld_dot_city": script(ld(title="T", jobLocation=[{"address": {
        "addressLocality": "St. Louis", "addressRegion": "MO"}}])) + "</html>",
    "ld_values": script(ld(title=5, employmentType=["A", None, True, ""],
                           hiringOrganization="text", jobLocation={"address": {
                               "addressLocality": " Rome ", "addressCountry": {
                                   "@type": "Country", "name": "IT"}}})) + "</html>",
    "header": lines("Acme", "Chicago, IL", "3 days ago", "Over 200 applicants", "Full-time",
                    "2 weeks ago"),
    "header_skip": lines("Contract Talent Group", "Remote", "Temporary"),
    "header_keep": lines("Contract Talent Group", "Remote", "Temporary",
                         head='<meta property="og:site_name" content="X">'),
    "board": lines("apply", "Acme", head="<meta name='twitter:site' content='@LinkedIn'>"),
    "huge_date": lines("Acme", "99999999999999 days ago"),
    "entities": "<html><body><h1>R&amp;D &#8211; &lt;b&gt; &#x1F600;</h1>"
                "<p title='a>b'>AT&T &foo; &hellip;</p></body></html>",
    "hidden": "<html><!-- <h1>no</h1> --><style>h1{}</style><script>var a='<h1>no</h1>'"
              "</script><template><h1>no</h1></template><h1>yes</h1></html>",
    "nested": "<html><body><h1>T</h1><nav>a<nav>b</nav>c</nav><p>We use</p></body></html>",
    "nested_far": "<body><footer>1<header>2<footer>3<nav>4</nav>5</footer>6</header>7</footer><p>8</p><header/>9</body>",
    "unclosed": "<body><div><header>a<p>b</div><p>shown</p><nav>rest<br></p></body>",
    "hidden_twice": "<h1>A</h1><template>x<template><h1>B</h1></template>y</template><p>z</p><ruby>k<rt>r</rt></ruby>",
    "stray": "<body></nav><p>a</p></header><nav>b</nav>c</body>",
    "repeated_keys": script('{"@type": "Thing", "@type": "JobPosting", "title": "A", "title": "B", '
                            '"hiringOrganization": {"name": "X", "name": "Y"}}') + "<h1>H</h1></html>",
    "company_text": "<html><body><p>About the job</p><p>Globex is hiring now</p></body></html>",
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, f"https://www.example.com/{n}", h) for i, (n, h) in enumerate(PAGES.items())]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = pages.parse_pages(df, F.lit("2026-04-30 12:00:00").cast("timestamp"))
    names = list(PAGES)
    return {names[r.page_id]: r.asDict() for r in found.collect()}


@pytest.mark.parametrize("name, field, value", [
    ("plain", "title", "Harbour Pilot"),
    ("plain", "location", "Berth: Oslo, NO"),
    ("plain", "company", None),
    ("plain", "date_posted", None),
    ("posting", "title", "Glass Blower"),
    ("posting", "company", "Kiln & Co"),
    ("posting", "location", "Murano, VE, IT"),
    ("posting", "description_raw", "Works hot glass; some Terraform helps."),
    ("shared", "title", "Bell Ringer"),
    ("shared", "source", "example.com"),
    ("bare", "description_raw", "Only one sentence stands here."),
    ("bare", "title", None),
    ("custom", "description_raw", "T x y z We use Python"),
    ("custom_h1", "title", "H"),
    ("marks", "title", "ab"),
    ("marks", "description_raw", "ab cd"),
    ("empty_h1", "title", None),
    ("ld_list", "title", "Second"),
    ("ld_graph", "title", "Shown"),
    ("ld_broken", "title", "Kept"),
    ("ld_iso_date", "date_posted", None),
    ("ld_iso_date", "parse_error", None),
    ("ld_num_date", "parse_error", "datePosted is not text"),
    ("ld_dot_city", "location", None),
    ("ld_values", "title", "5"),
    ("ld_values", "job_type", "A, True"),
    ("ld_values", "company", None),
    ("ld_values", "location", "Rome, {'@type': 'Country', 'name': 'IT'}"),
    ("header", "company", "Acme"),
    ("header", "location", "Chicago, IL"),
    ("header", "date_posted", AS_OF - dt.timedelta(weeks=2)),
    ("header", "job_type", "Full-time"),
    ("header_skip", "company", "Contract Talent Group"),
    ("header_skip", "job_type", "Temporary"),
    ("header_skip", "location", "Remote"),
    ("header_keep", "company", "X"),
    ("header_keep", "job_type", "Contract"),
    ("board", "company", "Acme"),
    ("huge_date", "parse_error", "date value out of range"),
    ("entities", "title", "R&D – <b> 😀"),
    ("entities", "description_raw", "R&D – <b> 😀 AT&T &foo …"),
    ("hidden", "title", "yes"),
    ("nested", "description_raw", "T We use"),
    ("nested_far", "description_raw", "8 9"),
    ("unclosed", "description_raw", "shown"),
    ("hidden_twice", "description_raw", "A z k"),
    ("hidden_twice", "title", "A"),
    ("stray", "description_raw", "a c"),
    ("repeated_keys", "title", "B"),
    ("repeated_keys", "company", "Y"),
    ("company_text", "company", "Globex"),
])
def test_parse(parsed, name, field, value):
    assert parsed[name][field] == value


@pytest.mark.parametrize("text, labels, value", [
    ("Location: San Francisco, CA", ["Location"], None),
    ("Location: Austin, TX", ["Location"], "Austin, TX"),
    ("Relocation: paid", ["Location"], "paid"),
    ("Location\nAustin", ["Location"], "Austin"),
    ("Job type: Contract Apply Now", ["Job type"], None),
    ("Posted On: 3 days ago", pages.DATE_LABELS, "On: 3 days ago"),
    ("Schedule - " + "x" * 100, ["Schedule"], "x" * 78),
    ("nothing", ["Location"], None),
])
def test_labelled_value(spark, text, labels, value):
    c = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(
        pages.labelled_value(c, pages.folded(c), labels)).first()
    assert row[0] == value


def test_long_page_does_not_overflow(spark):
    html = "<html><body>" + "<p class='a'>word word, </p>" * 20_000 + "</body></html>"
    df = spark.createDataFrame([(html,)], "html string")
    n = df.select(F.size(markup.text_nodes(markup.readable(F.col("html"))))).first()[0]
    assert n == 20_000


class Reader(HTMLParser):
    """Visible text by a stack of open elements."""

    def __init__(self):
        super().__init__()
        self.open, self.seen = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in markup.VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not set(self.open) & set(markup.BOILERPLATE):
            self.seen.append(data)


def test_elements_end_as_a_stack_has_them(spark):
    draw = random.Random(11)
    names = ["nav", "NAV", "header", "footer", "noscript", "div", "p", "nav-x"]
    bits = [f"<{n} class='a>b'>" for n in names] + [f"</{n}>" for n in names] + ["<br>", "<img/>", "<nav/>", "x", "y ", "z", "<!doctype a>"]
    soups = ["".join(draw.choice(bits) for _ in range(draw.randint(1, 30))) for _ in range(600)]
    wanted = {}
    for i, soup in enumerate(soups):
        reader = Reader()
        reader.feed(soup)
        reader.close()
        wanted[i] = "".join(reader.seen)
    df = spark.createDataFrame(list(enumerate(soups)), "i int, h string")
    shown = F.regexp_replace(F.regexp_replace(markup._cut_out(F.col("h"), markup.BOILERPLATE), markup._TAG, ""), "\x01", "")
    assert {r.i: r.t for r in df.select("i", shown.alias("t")).collect()} == wanted
    # Where one regex does, it gives the same.
    both = df.select("i", F.array_join(markup.text_nodes(markup.without(F.col("h"), markup.BOILERPLATE)), "|").alias("a"),
                     F.array_join(markup.text_nodes(markup._cut_out(F.col("h"), markup.BOILERPLATE)), "|").alias("b")).collect()
    mixed = [r.i for r in both if r.a.replace("|", "") != r.b.replace("|", "")]
    for i in mixed:  # only where another element is closed in between
        assert "</div>" in soups[i] or "</p>" in soups[i] or "</nav-x>" in soups[i]


def test_a_long_page_with_nested_elements(spark):
    html = "<body><nav><nav></nav>menu</nav>" + "<p class='a'>word word, " * 5_000 + "</body>"
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(markup.body_text(F.col("html"))).first()[0] == " ".join(["word word,"] * 5_000)


def test_stack_same_as_element_by_element(spark):
    """Pairs with nothing left inside are taken out first; that changes nothing that is shown."""
    html = ("<body><nav><nav></nav>Menu</nav><ul><li><b>a</b></li><li><i>b</i></li></ul>"
            "<div><header>Top<header></div><p>c</p><a<nav>d</a<nav><footer>x<footer>y</footer>z</footer>e</body>")
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(markup.body_text(F.col("html"))).first()[0] == "a b c d e"
    # The walk over the open elements gets what is left of the tags, of which most of a page have gone.
    walked = df.select(F.size(F.split(markup._open_words(F.regexp_extract_all(
        "html", F.lit(markup._TAG), F.lit(0)), markup.BOILERPLATE), "<")) - 1).first()[0]
    assert walked < html.count("<") // 2 + 2


def test_pairs_are_cut_as_the_stack_cuts(spark):
    """Pages are the same to the last character, whether their elements are well nested, unclosed or stray."""
    draw = random.Random(7)
    names = ["nav", "NAV", "header", "footer", "div", "p", "nav-x", "body"]
    bits = ["<br>", "</br>", "<nav/>", "</ nav>", "x", "z < 3", "> ", "<!doctype a>", "<a<nav>", "$1", "\\2", "<nav", "\x06",
            *[f"<{n} a='x>y'>" for n in names], *[f"</{n}>" for n in names]]

    def tree(depth):
        if depth == 0 or draw.random() < 0.2:
            return draw.choice(["x", "y", ""])
        name = draw.choice(names)
        return f"<{name}>" + "".join(tree(depth - 1) for _ in range(draw.randint(0, 3))) + draw.choice([f"</{name}>"] * 6 + [""])

    pages_ = [(i, "".join(draw.choice(bits) for _ in range(draw.randint(1, 25))) if i % 2 else tree(5)) for i in range(1500)]
    df = spark.createDataFrame([*pages_, (-1, None)], "i int, h string")
    both = df.select("h", markup._cut_pairs(F.col("h"), markup.BOILERPLATE).alias("a"), markup._cut_out(F.col("h"), markup.BOILERPLATE).alias("b"))
    assert both.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_nested_pages_need_no_stack(spark, monkeypatch):
    html = ("<html><body><nav>Menu<nav>Jobs</nav>Home</nav><p>a</p><div><header>Top<header></div>"
            "<footer>x<footer>y</footer>z</footer><p>b</p></body></html>")
    monkeypatch.setattr(markup, "_cut_out", lambda page, names: F.raise_error(F.lit("the stack")))
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(markup.body_text(F.col("html"))).first()[0] == "a b"


def test_a_costly_text_is_made_once(spark):
    """`nullif` in a condition would make its text twice."""
    df = spark.createDataFrame([(" a  b ", 1), (" ", 1), (None, 1)], "t string, n int")
    found = df.select(F.when(F.col("n") == 1, collapse(F.col("t"))).alias("c"))
    assert [r.c for r in found.collect()] == ["a b", None, None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1


def test_methods_are_no_longer_than_are_compiled(spark):
    key = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(key, "65535")
    pages.parse_pages(spark.createDataFrame([], "page_id long, url string, html string"), F.current_timestamp())
    assert spark.conf.get(key) == "8000"


def test_a_filter_on_the_page_does_not_make_it_again(spark, tmp_path):
    from jobloom.plans.catalog import fetched_ads

    for name, row in {
        "orders": "1 AS o_orderkey, 2 AS o_custkey, 'P' AS o_orderstatus, '1-URGENT' AS o_orderpriority, TIMESTAMP '1995-01-02 00:00:00' AS o_orderdate",
        "customer": "2 AS c_custkey, 3 AS c_nationkey, 'BUILDING' AS c_mktsegment, 'C' AS c_name",
        "nation": "3 AS n_nationkey, 4 AS n_regionkey", "region": "4 AS r_regionkey, 'ASIA' AS r_name"}.items():
        spark.sql(f"SELECT {row}").write.parquet(f"{tmp_path}/{name}.parquet")
    ads = fetched_ads(spark, str(tmp_path))
    assert ads.count() == 1
    assert ads._jdf.queryExecution().optimizedPlan().toString().count("og:site_name") == 1
