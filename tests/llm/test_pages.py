import html as html_lib
import os
import re

import pytest

from stratamix.llm import html_text, url_filter

SF = "/root/testdata/sf0.001"


def brute_rule(host, path, rules):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0]) or r[0] == "") and path.startswith(r[1])]
    return max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)


def test_rules_equal_brute_force(spark):
    import random

    r = random.Random(3)
    labels, parts = ["a", "b", "ab", "a-b", "org"], ["", "/", "/x", "/x/", "/x/y", "/xy", "/é"]
    rules = {}
    while len(rules) < 40:
        rules[".".join(r.choices(labels, k=r.randint(1, 3))), r.choice(parts)] = r.choice(["allow", "block"])
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [(i, f"http{r.choice(['', 's'])}://{'.'.join(r.choices(labels, k=r.randint(1, 4)))}{r.choice(parts)}{r.choice(['', '?a://b/x', '#/x'])}") for i in range(600)]
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(5)
    for row in url_filter.judge(df, rules).collect():
        want = brute_rule(row.host, row.path, rules)
        ties = [x for x in rules if want and x[0] + x[1] == want[0] + want[1]]
        assert row.rule == (want[0] + want[1] if want else None)
        assert row.verdict == (want[2] if want else "allow") or len(ties) > 1


def test_rule_blocks_carry_the_best(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://m.example.org/en/12"), (2, "http://x.net/")], "page_id long, url string")
    monkeypatch.setattr(url_filter, "RULES_PER_BLOCK", 1)
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(df).collect()} == {1: ("example.org/en/1", "block"), 2: (None, "allow")}


def test_url_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://EXAMPLE.ORG/ES/x"), (5, "http://Example.ORG/es/x?q#f"), (6, "x://org"), (7, "x://org?/a"), (None, "http://a.com/de/"), (7, "x://org?/a"), (8, "http://éX.com/fr/" + "y" * 100_000)]
    df = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, host string")
    got = [(r.page_id, r.host, r.path[:6], r.rule, r.verdict) for r in url_filter.judge(df).collect()]
    assert sorted(got, key=str) == sorted(
        [
            (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.org", "/ES/x", "org/", "allow"), (5, "example.org", "/es/x", "example.org/es/", "block"),
            (6, "org", "", None, "allow"), (7, "org", "", None, "allow"), (7, "org", "", None, "allow"), (None, "a.com", "/de/", "com/de/", "block"), (8, "éx.com".replace("éx", "éx"), "/fr/yy", "com/fr/", "allow"),
        ],
        key=str,
    )
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df, [], default="block").collect()} == {"block"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_urls_equal_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({url_filter.SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in url_filter.op7_url_filter(spark, SF).collect()), key=str) == want


RICH = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="comments-on">
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, please agree to them all.</p></div>
<main><article><h1>Caf&eacute; &amp; more</h1><script>var x = "</p><p>no";</script>
<p>First <b>bold</b>text,<br>next   line.<p>Second &lt;tag&gt; &#8212; dash.<!-- no --></p><ul><li>item one<li>item two</ul>
<div class="ad-slot">Buy now, it is very cheap indeed today.</div><aside>Related things</aside>
<form><label>Mail</label><input><button>Go</button></form><table><tr><td>a<td>b</table>
<section id="comments"><p>A reader's comment that is rather long and not part of it.</p></section></article></main>
<footer>&copy; 2020 Somebody with a long imprint</footer></body></html>"""


def test_article_without_furniture():
    assert html_text.main_text(RICH) == "Café & more First boldtext, next line. Second <tag> — dash. item one item two a b"


def test_plain_text_of_an_article_stays_and_what_stands_outside_goes():
    import itertools

    for words, before, after in itertools.product((1, 5, 50, 500), (0, 3, 80), (0, 3, 80)):
        for links_before, links_after, heading in itertools.product((0, 1), (0, 1), (0, 1)):
            row = lambda zone, furniture: (words, 0, before, links_before, after, links_after, zone, furniture, heading)  # noqa: B023, E731
            assert html_text.decide(html_text.TREE, row(1, 0))
            assert not html_text.decide(html_text.TREE, row(1, 1)) and not html_text.decide(html_text.TREE, row(-1, 0))


def test_tree_fits_its_pages():
    x, y = html_text.labelled()
    assert len(y) > 300 and 0.4 < y.mean() < 0.6
    assert all(html_text.decide(html_text.TREE, row) == bool(label) for row, label in zip(x, y))


def test_attributes_and_names_that_mislead():
    page = '<article><p title="The hidden valley">One.</p><h2 id="notice-period">Two</h2><section id="search-engines"><p>Three.</p></section><p data-x="class=ad" class="share-price">Four.</p><p hidden>no</p><p aria-hidden="true">no</p><p style="color:red;display: none">no</p></article>'
    assert html_text.main_text(page) == "One. Two Three. Four."
    page = "<article><p>One.</p><div class='ad-box'>no</div><div class='box sidebar'>no</div><div id=comments>no</div><div role=search>no</div></article>"
    assert html_text.main_text(page) == "One."


LONG = "This is a paragraph of running text that goes on for quite a while and has no links at all. " * 3


def test_pages_without_a_main_element():
    page = f"<ul><li><a>One</a><li><a>Two</a><li><a>Three</a></ul><h1>A heading of the text</h1><p>{LONG}</p><p>{LONG}</p><p>Short one here.</p><p>{LONG}</p><p><a>Next</a> <a>Last</a></p>"
    assert html_text.main_text(page) == " ".join(f"A heading of the text {LONG} {LONG} Short one here. {LONG}".split())


def test_neighbours_decide():
    """The same block is kept or dropped by its neighbours' word counts and link densities alone."""
    keep = lambda *row: html_text.decide(html_text.TREE, row)
    # words, links, words and links before, words and links after, zone, furniture, heading
    assert keep(2, 0, 60, 0, 50, 0, 0, 0, 0) and not keep(2, 0, 3, 1, 4, 1, 0, 0, 0)
    assert keep(8, 0, 60, 0, 50, 0, 0, 0, 0) and not keep(8, 0, 60, 0, 0, 0, 0, 0, 0)
    used = set()

    def walk(tree):
        if len(tree) > 1:
            used.add(html_text.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(html_text.TREE)
    assert {"words", "link_density", "words_before", "words_after", "links_before"} <= used
    text = "<p>Ten words of text stand in this block of ours.</p>"
    around = "<p>{0}</p>{1}<p>{0}</p>"
    assert "Ten words" in html_text.main_text(around.format(LONG, text))
    assert "Ten words" not in html_text.main_text(f"<p><a>Some link</a></p><p>By me</p><p><a>Other link</a></p>{'<p>Two words</p>'}") and html_text.main_text("<p><a>Some link</a></p><p>By me</p><p><a>Other link</a></p>") == ""


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<p cla", "<!-- open", "</p></p>", "<a href='x", "&", "<script>x", "<div" + " a=\"" * 2000])
def test_broken_pages_do_not_crash(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_edge_cases(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<article>x</article>", "t"), (2, "u", "<article>" + "<p>word</p>" * 50_000 + "</article>", "t"), (2, "u", "<article>x", "t")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert [(r.page_id, r.n_chars) for r in rows] == [(1, 0), (None, 1), (2, 249_999), (2, 1)]
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
def test_pages_of_the_tables(spark):
    rows = html_text.op8_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        plain = re.sub(r"<[a-zA-Z/][^>]*>", " ", re.sub(r"</?(?:b|i|em|strong|a)\b[^>]*>", "", inner))
        assert r.text == " ".join(html_lib.unescape(plain).split()) and r.n_chars == len(r.text)
