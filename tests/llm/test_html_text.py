import numpy as np
import pytest

from tessella.llm import html_text as h
from tessella.llm import made_pages


@pytest.fixture(scope="module")
def net():
    return h.trained()


def test_blocks():
    page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>out<nav><a href=x>A</a></nav><!-- c <p> --><p>a<b>b</b> c&amp;d&nbsp; e<br>f<p>g<script>var t='</p>';</script>h<div class='ad x'>i</div><svg><text>no</text></svg>tail &lt;"
    got = h.blocks_of(page)
    assert [b.text for b in got] == ["out", "A", "ab c&d e f", "g", "h", "i", "tail <"]
    assert got[1].linked == 1 and h.path_feature("ad") in got[5].path
    assert [b.text for b in h.blocks_of("")] == [] and [b.text for b in h.blocks_of("just text")] == ["just text"]
    assert h.blocks_of("<p " * 20000 + "<" * 20000) is not None and len(h.blocks_of("<div>x" * 5000)) == 5000


def test_every_word_and_tag_of_a_block_counts():
    words, text = h.Words(), [f"w{i}" for i in range(500)]
    table = lambda own: h._mean(np.eye(h.WORD_BUCKETS, dtype=np.float32), x["marks"], x["of_word"], x["n"], x["n_word"], x["times"]) if (x := h.Labeller(1).inputs([h.blocks_of(f"<p>{' '.join(own)}")], words)) else None
    want = np.bincount([words[w] for w in text], minlength=h.WORD_BUCKETS) / 500
    assert np.allclose(table(text)[0], want, atol=1e-7)
    deep = h.blocks_of("<div class=outermost>" + "<div>" * 300 + "<section class=inner><p>x</p></section>" + "<b>" * 50 + "y" + "</div>" * 301 + "z")
    assert [b.text for b in deep] == ["x", "y", "z"] and all({h.path_feature("outermost"), h.path_feature("<div>")} <= set(b.path) for b in deep[:2])
    assert h.path_feature("inner") in deep[0].path and h.path_feature("inner") not in deep[1].path and deep[2].path == ()
    far = h.blocks_of("<p>" + "<i>" * 30 + "a<div>b</div><a>" + "<i>" * 20 + "c")  # the paragraph ends at the div, a link goes on
    assert h.path_feature("<p>") not in far[1].path and far[1].text == "b" and far[2].linked == 1 and h.blocks_of("<a>" + "<i>" * 20 + "c<br>d</a>")[0].linked == 2


def test_unclosed_silent_tags_hide_nothing():
    for tag in ("object", "select", "noscript", "svg", "head", "canvas"):
        assert [b.text for b in h.blocks_of(f"<p>a</p><{tag}><p>b</p><p>c</p>")] == ["a", "b", "c"], tag
        assert [b.text for b in h.blocks_of(f"<p>a</p><{tag}>no</{tag}><p>b</p><{tag}>yes")] == ["a", "b", "yes"], tag
    assert [b.text for b in h.blocks_of("<p>a</p><script><p>b</p>")] == ["a"]


def test_gradient():
    g = np.random.default_rng(0)
    net, words = h.Labeller(1), h.Words()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = net.inputs([h.blocks_of(made_pages.page(g)[0]) for _ in range(3)], words)
    slope = g.normal(size=x["n"])
    net.forward(x, keep=True)
    grad = net.gradient(x, slope)
    for k in ("Wf", "Wb", "path", "out", "bf"):
        at = np.unravel_index(np.argmax(np.abs(grad[k])), grad[k].shape)
        old, ends = net.p[k][at], []
        for d in (1e-2, -1e-2):
            net.p[k][at] = old + d
            ends.append(float(net.forward(x) @ slope))
        net.p[k][at] = old
        assert abs((ends[0] - ends[1]) / 2e-2 - grad[k][at]) < 0.03 * abs(grad[k][at]) + 1e-3, k


def test_made_up_pages_unseen_in_training(net):
    g, words = np.random.default_rng(1234), h.Words()
    right = total = 0
    for _ in range(150):
        page, main = made_pages.page(g)
        blocks = h.blocks_of(page)
        z = net.forward(net.inputs([blocks], words)) > 0
        right += sum(bool(a) == (b.text in main) for a, b in zip(z, blocks))
        total += len(blocks)
    assert right / total > 0.98


def test_query(spark, net):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = h.main_text(pages).collect()
    assert len(got) == pages.count()
    for r, p in zip(sorted(got), sorted(pages.collect())):
        article = p.html[p.html.index("<article>") : p.html.index("</article>")]
        want = " ".join(b.text for b in h.blocks_of(article))
        assert r.text == want and r.n_chars == len(want)
    odd = spark.createDataFrame([(1, "u", None, "t"), (1, None, "", None), (None, "u", "<p>" + "x " * 10**5, "t")], "page_id long, url string, html string, text string")
    assert [r.text for r in h.main_text(odd).collect()][:2] == ["", ""] and h.main_text(odd.limit(0)).count() == 0
