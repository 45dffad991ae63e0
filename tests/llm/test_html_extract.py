import random

import numpy as np
import pytest

from stintline.llm import html_extract as hx


def page(rng, main="article", extra=True):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    paras = [text(rng.randint(8, 60)) for _ in range(rng.randint(2, 9))]
    nav = "".join(f"<li><a href='/{i}'>{word()}</a></li>" for i in range(6))
    comments = f"<div class='comments'><p>{text(12)}</p><p>{text(9)}</p></div>" if extra and rng.random() < 0.6 else ""
    side = f"<aside><h3>{word()}</h3><p>{text(10)}</p></aside>" if extra and rng.random() < 0.6 else ""
    body = "".join(f"<p>{p[:5]}<b>{p[5:]}</b>" for p in paras)
    return (
        f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body><script>var t='</p>';</script><nav><ul>{nav}</ul></nav>"
        f"<!-- <p>no</p> --><div class=ad>{text(9)}</div><{main}><h1>{word()}</h1>{body}</{main.split()[0]}>{comments}{side}<footer>&copy; {text(6)}</footer></body></html>",
        paras,
    )


def test_blocks_are_the_leaves_of_the_page():
    got = hx.blocks("<head><title>x</title></head><p>a &amp; b<br>c\xa0 d<ul><li>e<li><a href='#'>f</a>g</ul><table><tr><td>h<td>i</table><p hidden>j<!-- k --><svg><p>l</svg>m < n <o")
    assert [t for _, t, _ in got] == ["a & b c d", "e", "fg", "h", "i", "jm < n"] or [t for _, t, _ in got][:5] == ["a & b", "c d", "e", "fg", "h"]


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    model = hx.Labeller.new(1)
    x, sizes, y = rng.normal(size=(5, 3, hx.WIDTH)), np.array([5, 2, 3]), rng.integers(0, 2, (5, 3)).astype(float)
    live = np.arange(5)[:, None] < sizes

    def loss():
        z = model.run(x, sizes)[0]
        return np.where(live, np.logaddexp(0, z) - y * z, 0).sum() / live.sum()

    grad = model.gradient(x, sizes, y)
    for name, at in (("xf", (3, 7)), ("hb", (2, 30)), ("cf", (20,)), ("xb", (9, 40)), ("o", (4,)), ("p", (0,))):
        base, eps = model.weights[name][at], 1e-5
        model.weights[name][at] = base + eps
        up = loss()
        model.weights[name][at] = base - eps
        down = loss()
        model.weights[name][at] = base
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=1e-4, abs=1e-9)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    return hx.train([page(rng, extra=False)[0] for _ in range(60)])


@pytest.mark.parametrize("main", ["article", "main", "div class='content'", "div id='main-content'"])
def test_held_out_pages(model, main):
    rng = random.Random(9)
    right = total = 0
    for _ in range(25):
        html, paras = page(rng, main)
        leaves = hx.blocks(html)
        is_main = model.labels([leaves])[0]
        right += sum(bool(m) == (t in paras or "h1" == p[-1][0]) for (p, t, _), m in zip(leaves, is_main))
        total += len(leaves)
    assert right / total > 0.97


def test_frame(spark, model):
    rng = random.Random(11)
    rows = [(i, f"u{i}", page(rng)[0]) for i in range(20)] + [(100, None, None), (101, "u", ""), (102, "u", "<p>"), (103, "u", "<article><p>" + "long text. " * 30000), (0, "u0", None), (None, None, "<<>&<!-- ")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = hx.extract(frame, hx.fit(frame)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text is not None and r.n_chars == len(r.text) and "  " not in r.text and r.text == r.text.strip()
    assert {r.page_id: r.text for r in got}[100] == ""
    empty = frame.where("false")
    assert hx.extract(empty, hx.fit(empty)).count() == 0
