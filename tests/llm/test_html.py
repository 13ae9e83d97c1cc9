"""Extraction on hand-written pages, induction over hosts, and the registered query against an independent parser."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest

from basinflow.llm import html_text
from basinflow.llm.html_text import CONTENT, NEUTRAL, Page, Template, decide
from tests import parity

ODD = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a = "</p><article>";</script></head>
<body class="post"><div id="cookieNotice">We use cookies</div><header class=site><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="side-bar sidebar">side</div><main><article><header><h1>T &amp; x &#233;</h1><span>by me</span></header>
<p>a<b>b</b> &eacute;\n\t c&nbsp;d<br>e <!-- <p>gone</p> --><p class="ad">buy</p><p><i>one<p>two</i>
<ul><li>x<li>y</ul><table><tr><td>1<td>2</table><form>f<input></form><section id=comments><p>first!</p></section><p hidden>h</p>
<article><p>a reader wrote this</p></article><blockquote>5 < 6 &amp;amp; 7</blockquote></article></main><footer>&copy; f</footer><p>after</p></body></html>"""


def brute(pages: list[str]) -> list[str]:
    """One host's pages in plain Python: all of them united, counted and decided at once."""
    parsed = [Page(p) for p in pages]
    whole = Template()
    for shape, n in sorted(Counter(tuple(p.slots) for p in parsed).items(), key=lambda x: (-x[1], str(x[0]))):
        whole.add(list(shape), n, n)
    whole = Template.load(whole.dump())
    places = [whole.align(p.slots) for p in parsed]
    on, size = defaultdict(set), Counter()
    stats: dict[int, list] = defaultdict(lambda: [0, 0, 0, 0])
    for i, (p, place) in enumerate(zip(parsed, places)):
        whole_page = max(1, sum(len(b[1]) for b in p.blocks))
        for slot, text, linked in p.blocks:
            on[place[slot], text].add(i)
            share = len(text) * 10**6 // whole_page
            size[place[slot], text] += share
            stats[place[slot]][2] += share
            stats[place[slot]][3] += linked * 10**6 // whole_page
    least = max(3, len(pages) / 2)
    fixed, fixed_size = set(), Counter()
    for (s, text), where in on.items():
        stats[s][0] += 1
        stats[s][1] += len(where) > 1
        if len(where) >= least:
            fixed.add((s, text))
            fixed_size[s] += size[s, text]
    fixed = {(s, t) for s, t in fixed if 2 * fixed_size[s] < stats[s][2]}
    slots, _ = whole.slots()
    kinds = decide(slots, {s: tuple(x) for s, x in stats.items()}, len(pages))
    out = []
    for p, place in zip(parsed, places):
        found = [b for b in p.blocks if kinds[place[b[0]]] == CONTENT] or [b for b in p.blocks if kinds[place[b[0]]] == NEUTRAL]
        left = [b for b in found if (place[b[0]], b[1]) not in fixed] or found
        out.append("\n\n".join(b[1] for b in left))
    return out


def test_odd_page():
    assert brute([ODD])[0].split("\n\n") == ["T & x é", "ab é c d e", "one", "two", "x", "y", "1", "2", "h", "5 < 6 &amp; 7"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("<!-->a<!--->b<!-- c --!>d", "abd"),
        ("<p class=it's>a that's</p><p title='x>y' id=\"z>\">b</p><p title=\"open>c", "a that's\n\nb\n\nc"),
        ("<p " + "\"'" * 5000, "<p " + "\"'" * 5000),
        ("plain &lt;text", "plain <text"),
        ("<div>" * 4000 + "deep" + "</div>" * 10, "deep"),
        ("<b>" * 3000 + "x<p>y", "x\n\ny"),
        ("<p>open <!-- never closed", "open"),
        ("<script>never closed", ""),
        ("<body><main><p>a</p><aside>b</aside></main><p>c</p>", "a"),
        ("<body><ul><li><a>menu</a></ul><p>text <a>link</a></p>", "text link"),
        ("<article><p>a</p></article><article class='comment'><p>b</p></article>", "a"),
        ("</p></b></article><p>a</p>", "a"),
        ("<article><p>a</p><xmp><b>&amp;\n as it is</b></xmp><p hidden>b</p></article>", "a\n\n<b>&amp; as it is</b>\n\nb"),
        ("<article><p>see <a>x</a></p><ul><li><a>a source</a></ul></article>", "see x\n\na source"),
        # a class that sounds like furniture holds what the page is about
        ("<body><nav><a>home</a></nav><div class=header-notice><h1>Title</h1><p>" + "long text " * 50 + "</p></div><footer>x</footer>", "Title\n\n" + ("long text " * 50).strip()),
    ],
)
def test_small_pages(html, text):
    assert brute([html]) == [text]


def test_simple_tree_matching_finds_the_largest_ordered_map():
    t = Template()
    t.align([(-1, "#"), (0, "a"), (0, "b"), (2, "c"), (0, "d")], grow=True)
    before = len(t.signature)
    # an optional node between, one missing: the rest keep their slots
    slots = t.align([(-1, "#"), (0, "a"), (0, "x"), (0, "b"), (3, "c")], grow=True)
    assert len(t.signature) == before + 1
    assert [t.signature[s] for s in slots] == ["#", "a", "x", "b", "c"] and slots[3] == 2
    assert [t.signature[c] for c in t.children[0]] == ["a", "x", "b", "d"]
    assert t.align([(-1, "#"), (0, "b"), (1, "new"), (2, "newer")]) == [0, 2, 2, 2]


def page(i, extra=""):
    return (
        f"<html><body><div class=top><span>Only on example: subscribe today.</span></div><div class=rail>{'teaser ' * (i % 4)}{i % 7}</div>"
        f"<div class=text><h1>Title {i}</h1><p>Body {i} text, which is longer than what stands beside it.</p>{extra}<p>Shared closing words.</p></div>"
        f"<div class=base>Mentions, terms and an address {i % 3}</div></body></html>"
    )


def test_varying_slots_are_content_without_any_prior(spark):
    hosts = {
        "a.example": [page(i, "<p>now and then</p>" if i % 5 == 0 else "") for i in range(20)],
        "b.example": [page(i) for i in range(3)],
        "c.example": [page(0)],
        "copies.example": ["<body><div><h1>T</h1><p>the same article everywhere</p></div></body>"] * 30,
        "": ["<p>x</p>", ""],
    }
    rows = [(n * 1000 + i, f"https://{h}/{i}" if h else "no url", html) for n, (h, pages) in enumerate(hosts.items()) for i, html in enumerate(pages)]
    rows += [(4002, None, None), (4002, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got[3] == "Title 3\n\nBody 3 text, which is longer than what stands beside it."
    assert got[5].endswith("\n\nnow and then") and "Shared" not in got[5]
    assert got[1001].startswith("Title 1\n\nBody 1") and "terms" not in got[1001]
    assert got[2000].startswith("Title 0") and "Mentions" not in got[2000] and "Only" not in got[2000]
    assert got[3007] == "T\n\nthe same article everywhere" and got[4000] == "x" and got[4001] == got[4002] == ""
    for n, pages in enumerate(hosts.values()):
        assert [got[n * 1000 + i] for i in range(len(pages))] == brute(pages if n < 4 else [*pages, "", ""])[: len(pages)]
    assert html_text.extract_text(df).count() == len(rows)
    assert html_text.extract_text(df.limit(0)).count() == 0
    other = html_text.extract_text(df.repartition(1).sortWithinPartitions("url")).collect()
    assert {r.page_id: r.text for r in other} == got  # however pages fall to tasks


def test_long_pages_and_a_page_unlike_its_host(spark):
    long = "<body><div class=text>" + "".join(f"<p>paragraph {i} of a very long page</p>" for i in range(30_000)) + "</div></body>"
    rows = [(i, "https://d.example/", page(i)) for i in range(12)] + [(99, "https://d.example/", long), (98, "https://d.example/", "<table><tr><td>other</table>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(df).collect()}
    assert got[99].count("\n\n") == 29_999 and got[98] == "other" and got[4].startswith("Title 4")


class Article(HTMLParser):
    """The blocks of <article>, by the standard library's parser."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.parts = False, [], []
        self.feed(html)
        self.close()

    def cut(self):
        if text := " ".join("".join(self.parts).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag == "br":
            self.parts.append(" ")
        elif tag in ("p", "h1", "article"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


@pytest.fixture(scope="module")
def table(spark):
    return {r.page_id: r for r in spark.read.parquet(f"{parity.DATA}/pages.parquet").collect()}


def test_registered_query_gives_the_articles(spark, table):
    rows = html_text.op10_html_text(spark, parity.DATA).collect()
    assert {r.page_id for r in rows} == set(table) and len(rows) == len(table)
    for r in rows:
        assert r.url == table[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == "\n\n".join(Article(table[r.page_id].html).blocks)


def by_host(rows):
    found = defaultdict(list)
    for r in rows:
        found[re.match(r"^\w+://([^/:?#]*)", r.url)[1].lower()].append(r)
    return found


def test_alignment_decides(spark, monkeypatch):
    """On hosts of three pages or more the prior changes no text of the registered query; without alignment over pages, and without the prior, texts change."""
    folder = "/root/testdata/sf0.01"
    whole = {r.page_id: r.text for r in html_text.op10_html_text(spark, folder).collect()}
    hosts = [rows for rows in by_host(spark.read.parquet(f"{folder}/pages.parquet").collect()).values() if len(rows) >= 3]
    monkeypatch.setattr(html_text, "PRIOR", 1.0)
    for rows in hosts:
        assert brute([r.html for r in rows]) == [whole[r.page_id] for r in rows]
    monkeypatch.setattr(html_text, "_kind", lambda s: (s.partition("@")[0], False, False))  # no names at all
    aligned = sum(t == whole[r.page_id] for rows in hosts for r, t in zip(rows, brute([r.html for r in rows])))
    alone = sum(brute([r.html])[0] == whole[r.page_id] for rows in hosts for r in rows)
    assert alone < aligned >= 0.95 * sum(map(len, hosts))


def test_host():
    pattern = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
    for url, host in [("http://u:p@H.example:80/x", "H.example"), ("https://a.b?x=1", "a.b"), ("HTTP://a#t", "a")]:
        assert re.match(pattern, url)[1] == host
