"""Main text of pages: written-out cases, cut pages, wrappers of a host."""

import html
import random

import pytest

from ebbtide.llm import pages
from ebbtide.llm.common import table

ARTICLE = """<article><header><h1>Title &eacute; &lt;b&gt;</h1><p class="byline">by x</p></header>
<p>One  two<br>three <a href="x">link</a> more.<p>Second &amp;amp; third.<ul><li>a<li>b</ul>
<aside>side</aside><div class="ad">buy</div><form><label>mail</label><input></form>
<section id="comments"><article><p>Reader says</p></article></section><p>Last&nbsp;one</p></article>"""
TEXT = "Title é <b>\nOne two three link more.\nSecond &amp; third.\na\nb\nLast one"


@pytest.mark.parametrize("page", [
    ARTICLE,
    f"<html><head><title>t</title><style>p{{}}</style></head><body class='has-sidebar'><nav><a href=/>home</a></nav>{ARTICLE}<footer>&copy; f</footer>",
    f"<body><div id=wrapper class='content sidebar'><header>Site</header><!-- <p>no</p> --><script>var t='</p><article>x';</script>{ARTICLE}</div><div class='cookie-notice'>We use cookies",
    f"<body><main><div class=menu>m</div>{ARTICLE}<div role=complementary>more</div></main><div hidden>h</div></body>",
])
def test_article_without_its_surroundings(page):
    assert pages.extract(page) == TEXT


def test_pages_without_article():
    assert pages.extract("<body><div id=menu><a>m</a></div><div><h2>Head</h2><p>Body text.</p><p><a>only</a> <a>links</a></p></div><div class=footer>c</div>") == "Head\nBody text."
    assert pages.extract("<main><p>in main</p></main><p>outside</p>") == "in main"
    assert pages.extract("plain &lt; text\n here") == "plain < text here"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!-- x", "<script>x", "<nav>a</nav>", "<article></article>"])
def test_no_text(page):
    assert pages.extract(page) in ("", "<", "<p")


def test_cut_and_deep_and_long_pages():
    cut = "<html><body><nav>n</nav><article><h1>T</h1><p>Some &amp; text &am"
    assert pages.extract(cut) == "T\nSome & text &am"
    assert pages.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    many = [f"paragraph {i}" for i in range(20_000)]
    assert pages.extract("<article>" + "".join(f"<p>{m}" for m in many)) == "\n".join(many)


def host_page(i, rng):
    body = "".join(f"<p>{rng.random()} text {rng.random()}</p>" for _ in range(rng.randrange(2, 9)))
    return f"<body><div class=top>Welcome to the site</div><div class=story><h1>Story {i}</h1>{body}<p>Follow us everywhere</p></div><div>All rights belong to us</div></body>"


def test_constant_nodes_of_a_host_are_template():
    rng = random.Random(1)
    made = [host_page(i, rng) for i in range(8)]
    wrapper = pages.learn(made[:6])
    for page in made:
        got = pages.extract(page, wrapper)
        assert "Welcome" not in got and "Follow" not in got and "rights" not in got
        assert got.splitlines() == [x.split("</")[0] for x in page.replace("<h1>", "<p>").split("<p>")[1:-1]]
    assert pages.learn(made[:3]) is None
    assert pages.learn([made[0]] * 6) is None  # copies of one article prove nothing


def test_matching_is_the_largest_common_mapping():
    leaf = lambda t, s="": (t, s, [])
    a = ("div", "", [leaf("p", "x"), leaf("b"), ("ul", "", [leaf("li"), leaf("li")])])
    b = ("div", "", [leaf("b"), ("ul", "", [leaf("li")]), leaf("p", "x")])
    size, pairs = pages.matching(a, b)
    assert size == 4 and [(p[0], q[0]) for p, q in pairs] == [("div", "div"), ("ul", "ul"), ("li", "li"), ("b", "b")]
    assert pages.matching(a, leaf("p"))[0] == 0


def test_query_over_given_pages(spark, sf_dir):
    """The given pages hold their article between two tags, so a plain cut gives the same blocks."""
    rows = table(spark, sf_dir, "pages").collect()
    got = {r["page_id"]: r for r in pages.main_text(table(spark, sf_dir, "pages")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(part).split()) for part in inner.replace("<h1>", "\0").replace("</h1>", "\0").replace("<p>", "\0").replace("</p>", "\0").replace("<br>", " ").replace("<b>", "").replace("</b>", "").split("\0")]
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_rows_of_every_kind(spark):
    rng = random.Random(2)
    rows = [(i, f"http://Host.example/{i}", host_page(i, rng)) for i in range(12)] + [(None, None, host_page(1, rng)), (3, "not a url", "<p>x"), (3, "not a url", "<p>x"), (4, "", None)]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "page_id long, url string, html string, text string, wrapper int")
    got = pages.main_text(df).collect()
    assert len(got) == len(rows)
    assert sum("Welcome" in r["text"] for r in got) == 1  # the page without a host has no wrapper
    assert sorted(r["text"] for r in got if r["url"] in ("", "not a url")) == ["", "x", "x"]
    assert pages.main_text(df.limit(0)).collect() == []


def test_article_below_many_levels():
    for deep in (200, 20_000):
        page = "<div>" * deep + "<nav>menu</nav><article><p>one</p><div><p>two</p></div></article><footer>foot</footer>" + "</div>" * deep
        assert pages.extract(page) == "one\ntwo"
        assert pages.extract(page.replace("article>", "section>")) == "one\ntwo"
    rng = random.Random(3)
    made = ["<div>" * 3000 + host_page(i, rng) + "</div>" * 3000 for i in range(6)]
    wrapper = pages.unpack(pages.pack(pages.learn(made)))
    assert wrapper == pages.learn(made)
    assert all("Welcome" not in pages.extract(m, wrapper) and "Story" in pages.extract(m, wrapper) for m in made)


def test_every_main_part_counts_once():
    page = "<body><nav>menu</nav><main><p>one</p><div role='main'><p>two</p></div></main><div><main><p>three</p></main></div><footer>end</footer></body>"
    assert pages.extract(page) == "one\ntwo\nthree"


def second_page(i, rng):
    """Another layout of the same host."""
    body = "".join(f"<p>{rng.random()} text {rng.random()}</p>" for _ in range(rng.randrange(2, 9)))
    return f"<body><section class=lead><div>Greetings of the shop</div></section><section class='entry entry-{i}'><h2>Entry {i}</h2>{body}<p>Write to us soon</p></section></body>"


@pytest.mark.parametrize("trees", [0, 1000])
def test_all_pages_and_layouts_of_a_host_are_learned(spark, monkeypatch, trees):
    """Of six references none would be constant, as the layouts take turns; 0: many bases take the way over a shuffle."""
    monkeypatch.setattr(pages, "TREES", trees)
    rng = random.Random(4)
    made = [(host_page if i % 2 else second_page)(i, rng) for i in range(40)]
    rows = [(i, f"http://host.example/{i}", m) for i, m in enumerate(made)] + [(100 + i, "http://host.example/copy", made[0]) for i in range(30)]
    odd = [(-1, "http://host.example/", None), (-2, None, made[1]), (-3, "http://host.example/", "")]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows + odd, "page_id long, url string, html string").repartition(3)).collect()}
    assert len(got) == len(rows) + 3 and got[-1] == got[-3] == "" and "Welcome" in got[-2]
    constant = ("Welcome to the site", "Follow us everywhere", "All rights belong to us", "Greetings of the shop", "Write to us soon")
    for i, _, page in rows:
        said = page.replace("<h1>", "<p>").replace("<h2>", "<p>").split("<p>")[1:]
        assert got[i].splitlines() == [x.split("</")[0] for x in said if x.split("</")[0] not in constant]


def test_what_few_pages_repeat_is_no_template(spark):
    """A text of the six pages with the least hashes alone is content, for the other pages of the host vary there."""
    rng = random.Random(5)
    plain = [host_page(i, rng) for i in range(40)]
    hashed = spark.createDataFrame([(i, p) for i, p in enumerate(plain)], "i int, html string").selectExpr("i", "xxhash64(html) AS h").collect()
    floor = min(r["h"] for r in hashed)
    tries = [host_page(1000 + i, rng).replace("<p>Follow", "<div class=season>Only in May</div><p>Follow") for i in range(1500)]
    hashed = spark.createDataFrame([(i, p) for i, p in enumerate(tries)], "i int, html string").selectExpr("i", "xxhash64(html) AS h").orderBy("h").limit(6).collect()
    assert sum(r["h"] < floor for r in hashed) == 6
    made = [p.replace("<p>Follow", f"<div class=season>Note {i}</div><p>Follow") for i, p in enumerate(plain)]
    made = [m for m, h in zip(made, spark.createDataFrame([(m,) for m in made], "html string").selectExpr("xxhash64(html) AS h").collect()) if h["h"] > hashed[-1]["h"]] + [tries[r["i"]] for r in hashed]
    got = pages.main_text(spark.createDataFrame([(i, "http://host.example/", m) for i, m in enumerate(made)], "page_id long, url string, html string")).collect()
    assert len(made) > 40 and sum("Only in May" in r["text"] for r in got) == 6
    assert not any("Welcome" in r["text"] or "Follow" in r["text"] for r in got)


def _tree(rng, depth=3):
    return (rng.choice("ab"), rng.choice(["", "x", "y", "z"]), [_tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)])


@pytest.mark.parametrize(("few", "cells"), [(0, 1 << 21), (64, 40), (10**9, 100)])
def test_long_lists_are_aligned_like_short_ones(monkeypatch, few, cells):
    rng = random.Random(6)
    for _ in range(30):
        a, b = (("div", "", [_tree(rng) for _ in range(rng.randrange(1, 25))]) for _ in range(2))
        monkeypatch.setattr(pages, "PAIRS", 250_000)
        size, pairs = pages.matching(a, b)
        monkeypatch.setattr(pages, "PAIRS", 0)
        monkeypatch.setattr(pages, "FEW", few)
        monkeypatch.setattr(pages, "CELLS", cells)
        got, same = pages.matching(a, b)
        assert got == size and [(id(p), id(q)) for p, q in same] == [(id(p), id(q)) for p, q in pairs]


def test_every_child_of_a_long_list_takes_part():
    """Children without text of their own, and those beyond the first 500, are mapped as well."""
    row = lambda i, s: ("tr", "", [("td", f"{s} {i}", []), ("td", "same", []), ("td", "", [("b", f"{i}", [])])])
    a, b = (("table", "", [row(i, s) for i in range(1200)]) for s in ("left", "right"))
    size, pairs = pages.matching(a, b)
    assert size == 1 + 1200 * (1 + 1 + 2 + 1 + 2) and len(pairs) == 1 + 1200 * 5
    assert {id(p) for p, _ in pairs[1:]} >= {id(t) for t in a[2]}
    leaves = [("p", f"{i}", []) for i in range(3000)]
    assert len(pages.matching(("div", "", leaves), ("div", "", leaves[::1]))[1]) == 3001


def test_template_in_a_long_page():
    """Of 700 blocks every other is said by all pages of the host: all of these are template, wherever they stand."""
    rng = random.Random(8)
    made = ["<body><div>" + "".join(f"<p>rule {i}</p><p>{rng.random()}</p>" for i in range(700)) + "</div></body>" for _ in range(5)]
    wrapper = pages.learn(made)
    for page in made:
        got = pages.extract(page, wrapper).splitlines()
        assert len(got) == 700 and not any(x.startswith("rule") for x in got)
