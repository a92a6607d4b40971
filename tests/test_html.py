import random
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from courant.functions import html as H
from courant.functions.urls import join_url
from courant.operators.links import count_anchors, extract_links, selector_faults

BASE = "https://news.example.com"


def links(spark, html, selector=None, base=BASE):
    df = spark.createDataFrame([(1, base, html)], "page_id long, url string, html string")
    return [(r.title, r.url) for r in extract_links(df, selector).orderBy("pos").collect()]


def page(*pairs):
    return "<body>" + "".join(f'<a href="{h}">{t}</a>' for t, h in pairs) + "</body>"


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column(F.col("html"))).first()[0]


@pytest.mark.parametrize("html, want", [
    (page(("Harbour reopens after storm", "https://news.example.com/port/opening-7")), [("Harbour reopens after storm", f"{BASE}/port/opening-7")]),
    (page(("Weekly grain review", "/grain/review/9")), [("Weekly grain review", f"{BASE}/grain/review/9")]),
    (page(("Jump to part", "#part2"), ("Rail strike ends", "/rail/strike-ends")), [("Rail strike ends", f"{BASE}/rail/strike-ends")]),
    (page(("Open the menu", "javascript:void(0)"), ("Copper hits a high", "/metal/copper-high")), [("Copper hits a high", f"{BASE}/metal/copper-high")]),
    (page(("Front page", "/"), ("English", "/uk"), ("Tram line extended", "/city/tram/extended")), [("Tram line extended", f"{BASE}/city/tram/extended")]),
    (page(("All", "/wire/all"), ("Diesel gets cheaper", "/fuel/diesel")), [("Diesel gets cheaper", f"{BASE}/fuel/diesel")]),
    (page(("Title seen first", "/news/001"), ("Title seen later", "/news/001")), [("Title seen first", f"{BASE}/news/001")]),
    (page(("no", "/news/001"), ("A later good title", "/news/001")), []),  # the poor first title hides it
    (page(("Mail us now", "mailto:a@b.example"), ("Six chars", "/about"), ("Three", "/abc")), [("Six chars", f"{BASE}/about")]),
    ('<a href="/news/1" title=" From attribute "><img></a>', [("From attribute", f"{BASE}/news/1")]),
    ("<A HREF=/news/2>Upper <b> case </b> tag</A>", [("Uppercasetag", f"{BASE}/news/2")]),
    ("<!-- <a href='/news/3'>hidden link</a> --><script>'<a href=\"/news/4\">in script</a>'</script>", []),
    ('<a href="/news/5">R&amp;D &lt;now&gt;&nbsp;</a>', [("R&D <now>", f"{BASE}/news/5")]),
    ('<a class="x" data-href="/no/way">without target</a>', []),
    ("", []),
])
def test_link_rules(spark, html, want):
    assert links(spark, html) == want


def test_selectors(spark):
    html = """<div class="wide stack x"><div><a href="/read/in-stack">Story in the stack</a></div>
      <a class="big lead" href="/read/other">The other story</a></div>
      <nav id="bar"><a href="/bar/who-we-are">Who we are, in the bar</a></nav>
      <ul class="rows"><li><a href="/read/row-one">Story row one</a></li><li><a href="/read/row-two">Story row two</a></li></ul>"""
    urls = lambda s: [u.rsplit("/", 1)[1] for _, u in links(spark, html, s)]
    assert urls(".stack a") == ["in-stack", "other"]
    assert urls("div.stack a.lead") == ["other"]
    assert urls(".rows li") == ["row-one", "row-two"]
    assert urls("#bar") == ["who-we-are"]
    assert urls("nav#bar a") == ["who-we-are"]
    assert urls(".row") == []
    assert urls(None) == ["in-stack", "other", "who-we-are", "row-one", "row-two"]
    for bad in ("a:first-child", "div > a", "a[href]", "*"):
        with pytest.raises(ValueError):
            links(spark, html, bad)


class Tree:
    """A random well-formed page: its text, and for each tag the steps that lead to it."""

    def __init__(self, seed):
        self.rnd, self.text, self.paths, self.anchors = random.Random(seed), "", [], 0
        self.grow((), 0)

    def grow(self, path, depth):
        for _ in range(self.rnd.randrange(1, 4)):
            tag = self.rnd.choice(["div", "ul", "nav", "p", "a", "span"])
            kinds = self.rnd.sample(["k0", "k1", "k2", "k3-x"], self.rnd.randrange(3))
            name = self.rnd.choice(["", "", "i0", "i1"])
            n = self.anchors
            self.anchors += tag == "a"
            self.text += f"<{tag} href='/story/{n}'" + (f' class="{" ".join(kinds)}"' if kinds else "") + (f" id={name}" if name else "") + ">"
            here = (*path, (tag, kinds, name))
            self.paths.append((here, n if tag == "a" else None))
            if depth < 4 and tag != "a" and self.rnd.random() < 0.8:
                self.grow(here, depth + 1)
            self.text += f"story text {n}</{tag}>"

    def meets(self, step, tag):
        m = re.fullmatch(r"(\w*)(?:([.#])([\w-]+))?", step)
        if not m:
            attr, value = re.fullmatch(r"\[(class|id)\*='([\w-]+)'\]", step).groups()
            return value in (" ".join(tag[1]) if attr == "class" else tag[2])
        return m[1] in ("", tag[0]) and (not m[2] or (m[3] in tag[1] if m[2] == "." else m[3] == tag[2]))

    def selected(self, path, steps):
        """Whether the last tag of a path is what the steps choose."""
        rest = iter(path[:-1])
        return self.meets(steps[-1], path[-1]) and all(any(self.meets(s, t) for t in rest) for s in steps[:-1])

    def count(self, steps):
        return sum(self.selected(p, steps) for p, _ in self.paths)

    def links(self, steps):
        if steps[-1].split(".")[0].split("#")[0] == "a":
            return [n for p, n in self.paths if n is not None and self.selected(p, steps)]
        return [n for p, n in self.paths if n is not None and any(self.selected(p[:i], steps) for i in range(1, len(p) + 1))]


def test_a_thousand_selectors_in_one_pass(spark):
    rnd, chosen = random.Random(3), {}
    while len(chosen) < 1000:
        steps = [rnd.choice(["", "div", "ul", "nav", "p", "span", "a"]) + rnd.choice(["", ".k0", ".k1", ".k2", ".k3-x", "#i0", "#i1"])
                 for _ in range(rnd.randrange(1, 4))]
        steps = [s or rnd.choice(["[class*='k3']", "[id*='i']", ".none"]) for s in steps]
        chosen[rnd.choice([" ", "  "]).join(steps)] = steps
    trees = [Tree(i) for i in range(25)]
    rows = [(i, BASE, trees[i % 25].text, s) for i, s in enumerate(chosen)]
    rows += [(2000, BASE, trees[0].text, "div > a"), (2001, BASE, None, "div a"), (2002, BASE, trees[0].text, "  "), (2003, BASE, "", ".k0 a")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, link_selector string").repartition(4)
    counted = {r.page_id: r.n_links for r in count_anchors(df, selector_col="link_selector").collect()}
    found = {}
    for r in extract_links(df, selector_col="link_selector").orderBy("page_id", "pos").collect():
        found.setdefault(r.page_id, []).append(int(r.url.rsplit("/", 1)[1]))
    for i, steps in enumerate(chosen.values()):
        tree = trees[i % 25]
        assert counted[i] == tree.count(steps), steps
        assert found.get(i, []) == tree.links(steps), steps
    assert counted[2000] is None and counted[2002] == trees[0].anchors and counted[2003] == 0
    assert 2000 not in found and len(found[2002]) == trees[0].anchors
    faults = selector_faults(df.withColumnRenamed("page_id", "id")).collect()
    assert [(r.id, r.error) for r in faults] == [(2000, "selector not supported: >")]


def test_count_is_before_the_rules(spark):
    df = spark.createDataFrame([('<a href="#x">x</a><a>y</a><p>',), ("<p>none</p>",)], "html string")
    assert [r.n_links for r in count_anchors(df).collect()] == [2, 0]


def test_join_url_like_the_standard_library(spark):
    bases = [BASE, "https://n.com/a/b/c?x=1#f", "http://n.com/a/b/", "http://n.com/a", "http://n.com:80?q"]
    refs = ("/x/y ../z ./q a/../b ?k=v #f //h.com/p http://o.com/../p https:rel http:rel mailto:a@b a//b /a//b "
            "../../../up . .. x?y=/../z /x/./y/.. g;p=1/../y ftp://f/x ? a# x? /p?# ;x /a/..b/.c").split(" ")
    rows = [(b, r, urljoin(b, r)) for b in bases for r in refs]
    df = spark.createDataFrame(rows, "b string, r string, want string")
    bad = df.withColumn("got", join_url(F.col("b"), F.col("r"))).where("not got <=> want").collect()
    assert bad == []


def test_summary(spark):
    long = "x" * 100
    html = (f"<body><p>outside text of the area</p><article><nav><p>navigation text here</p></nav><p>short</p>"
            f"<p>first good paragraph<p>second <b>good</b> paragraph</p><p>a | b | c | d links</p>"
            f"<p>请勿复制，版权所有违者必究的段落</p><p>{long}</p><p>{long}</p></article></body>")
    text = "first good paragraph" + "secondgoodparagraph" + long + long
    assert one(spark, html, H.extract_summary) == text[:140] + "..."
    exact = "y" * 140
    assert one(spark, f"<main><p>{exact}</p><p>more than ten characters</p></main>", H.extract_summary) == exact
    assert one(spark, "<p>no area, no body at all</p>", H.extract_summary) == "no area, no body at all"
    assert one(spark, "", H.extract_summary) == ""
    nested = "<div class='content'><div>x<p>inner paragraph</p></div><p>outer paragraph</p></div><p>after the area</p>"
    assert one(spark, nested, H.extract_summary) == "inner paragraphouter paragraph"


def test_article_text(spark):
    html = ("<div class='my-article-box'><header><p>header text to be dropped</p></header>"
            "<div class='ad'><p>kept, as only tags are removed</p></div><p>123 456.789,000 12345</p>"
            "<p>see >> here >> and more text</p><p>a real paragraph of text</p></div>")
    assert one(spark, html, H.extract_article_text) == "kept, as only tags are removed\n\na real paragraph of text"


def test_selected_anchors_and_elements(spark):
    html = """<div class="box"><a class="title" href="/one/first">Anchor chosen itself</a></div>
      <h3 class="title"><a href="/two/second">Anchor inside</a></h3><a href="/three/third">Another one</a>"""
    assert [u.rsplit("/", 1)[1] for _, u in links(spark, html, ".title")] == ["first", "second"]
    df = spark.createDataFrame([(1, BASE, html, ".title"), (2, BASE, html, "a:hover"), (3, BASE, html, None)],
                               "page_id long, url string, html string, link_selector string")
    counted = {r.page_id: r.n_links for r in count_anchors(df, selector_col="link_selector").collect()}
    assert counted == {1: 2, 2: None, 3: 3}
    assert {r.page_id for r in extract_links(df, selector_col="link_selector").collect()} == {1, 3}
    faults = selector_faults(df.select(F.col("page_id").alias("id"), "link_selector")).collect()
    assert [r.id for r in faults] == [2]
    empty = spark.createDataFrame([(1, "<div class='list'><p>x</p></div>")], "page_id long, html string")
    assert count_anchors(empty, ".list").first().n_links == 1


@pytest.mark.parametrize("html, want", [
    ("a<nav>b<nav>c</nav>d</nav>e", "ae"), ("a<nav>b<nav>c</nav>d", "a"), ("a</nav>b", "a</nav>b"),
    ("a<NAV x='1'>b</Nav >c<aside>d</aside>e", "ace"), ("a<navy>b</navy>", "a<navy>b</navy>"), ("", ""),
    ("a<nav><aside>b</nav>c</aside>d", "acd"),
])
def test_balanced_noise(spark, html, want):
    got = one(spark, html, lambda c: H.without_elements(c, ("nav", "aside")))
    assert got == want
