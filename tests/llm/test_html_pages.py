"""Malformed and nested pages, containers of any name, and the registered query against a reading by html.parser."""

import random
import time
from html.parser import HTMLParser

import pytest
from test_html_extract import page

from stintline.llm import html_extract as hx


@pytest.mark.parametrize(
    ("html", "texts"),
    [
        ('<p title="a"b">hello</p>x', ["hello", "x"]),
        ("<a href='x' title='it's'>hello</a>", ["hello"]),
        ('<p title="5" wide">last words', ["last words"]),
        ('<div class="open>abc</div><p>tail', ["abc", "tail"]),
        ('<p title="a>b">c</p>', ["c"]),
        ("a<!-->b<!-- x", ["ab"]),
        ("m < n <o", ["m < n"]),
        ("</>a</ x>b<?c?>d<!e>f", ["abdf"]),
        ("<head><title>x</title><p>in body", ["in body"]),
        ("<textarea>no</textarea>y<svg><p>l</svg>m<select><option>n</select>", ["ym"]),
        ("<script>var t='<p>no'</SCRIPT >yes<style>p{}", ["yes"]),
        ("&am<b>p;</b> &amp;lt; &eacute;&#233;", ["&amp; &lt; éé"]),
        ("<td>a<td>b<li>c<ul><li>d</ul><li>e", ["a", "b", "c", "d", "e"]),
    ],
)
def test_malformed(html, texts):
    assert [t for _, t, _ in hx.blocks(html)] == texts


@pytest.mark.parametrize(
    "html",
    [
        "<a " * 1_000_000,
        "<" * 1_000_000,
        "<!" * 500_000,
        "<script" * 300_000,
        "<p " + "a=\"b' " * 200_000,
        "<li><ul>" + "<div>" * 50_000 + "<li>x</li>" * 50_000,
        "</x>" * 300_000 + "<div>" * 100_000 + "</span></p>" * 100_000,
    ],
)
def test_reading_is_linear(html):
    begun = time.process_time()
    hx.blocks(html)
    assert time.process_time() - begun < 10


def test_deep_page_is_labelled_in_seconds():
    begun = time.process_time()
    leaves = hx.blocks("<div>x" * 100_000)
    assert len(leaves) == 100_000 and leaves[-1][0].depth == 100_000
    hx.Labeller.new(1).labels([leaves])
    assert time.process_time() - begun < 90


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    return hx.train([page(rng, extra=False)[0] for _ in range(120)])


@pytest.mark.parametrize("main", ["div class='page'", "div class='page-text'", "div class='post comments-open'", "div class='xk3 qqz'", "section id=x9", "div"])
def test_any_container_name(model, main):
    rng = random.Random(9)
    right = total = 0
    for _ in range(25):
        html, paras = page(rng, main)
        leaves = hx.blocks(html)
        is_main = model.labels([leaves])[0]
        right += sum(bool(m) == (t in paras or "h1" == p[-1][0]) for (p, t, _), m in zip(leaves, is_main))
        total += len(leaves)
    assert right / total >= 0.95


def test_without_labelled_pages_all_blocks_stay(spark):
    rows = [(1, "<p>a</p><p>b"), (2, None), (3, "")]
    frame = spark.createDataFrame(rows, "page_id long, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in hx.extract(frame, hx.fit(frame)).collect()} == {1: ("a b", 3), 2: ("", 0), 3: ("", 0)}


def test_clashing_columns(spark, model):
    rows = [(1, "own", "<article><p>a</article>", 5)]
    frame = spark.createDataFrame(rows, "page_id long, text string, html string, n_chars int")
    got = hx.extract(frame, hx.Labeller.untaught())
    assert got.columns == ["page_id", "html", "text", "n_chars"] and got.first().text == "a"
    named = frame.select("page_id", frame.html.alias("text"))
    assert hx.extract(named, hx.Labeller.untaught(), "text").first().text == "a"


class Reading(HTMLParser):
    """The text of an article's blocks, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.out, self.parts = 0, [], []

    def part(self, tag):
        if tag not in hx.INLINE:
            self.out.append(" ".join("".join(self.parts).split()))
            self.parts = []

    def handle_starttag(self, tag, attrs):
        self.part(tag)
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.part(tag)
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth:
            self.parts.append(data)


def test_query_against_the_articles(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = hx.op7_html(spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        reading = Reading()
        reading.feed(pages[r.page_id])
        assert r.text == " ".join(t for t in reading.out if t) and r.n_chars == len(r.text)
