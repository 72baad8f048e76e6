import html
import re
import tracemalloc

import numpy as np
import pytest

from tidemark.llm import html_blocks as H


def test_blocks_survive_broken_markup():
    page = '<body><nav><a href="/">A</a><p>one &amp;amp; two<p>three&nbsp;<b>bo</b>ld<!-- x --><script>var t="</p>";</script><div class="ad x">ad</div></nav></div>tail &am <style>p{'
    got = [(b.text, b.path[-1]) for b in H.blocks(page)]
    assert got == [("A", "nav"), ("one &amp; two", "p"), ("three bold", "p"), ("ad", "x"), ("tail &am", "body")]
    assert H.blocks(None) == H.blocks("") == [] and H.blocks("<p> \n </p>") == []


@pytest.mark.parametrize("form, inside", [
    ('<svg viewBox="0 0 1 1"/>', ""), ("<svg/>", ""), ('<object data="a.swf" />', ""), ("<select-menu>x</select-menu>", "x"), ("<title-bar>x</title-bar>", "x"), ("<object-card>x</object-card>", "x"), ("<template-x>x", "x"), ("<script-x>x</script-x>", "x"),
    ("<object>", ""), ("<select><option>x", "x"), ("<svg><title/>", None), ("<noscript>x", "x"), ("<canvas>", ""), ("<object title=it's>x</object>", ""), ('<svg a=">" b="/">x</svg>', ""), ("<object><object>x</object>", ""), ("<svg><svg>x</svg>x</svg>", ""), ("<SELECT\n><option>x</select >", ""),
    ('<svg><title/><style>x</svg>', ""), ("<script>'<select>'</script>", ""), ("<!-- <svg> -->", ""), ("<template><p>x</p></template>", ""), ("<noscript><style>x</style></noscript>", ""),
])
def test_held_elements_end_where_they_end(form, inside):
    got = [b.text for b in H.blocks(f"<div>{form}</div><article><p>one</p></article><svg>y</svg><p>two</p><select>y</select><object>y</object><p>three")]
    assert inside is None or got == ([inside] if inside else []) + ["one", "two", "three"]


def test_raw_elements_reach_to_the_end():
    for name in ("script", "style", "title", "textarea", "iframe"):
        assert [b.text for b in H.blocks(f"<p>one</p><{name}>x<p>y</p>")] == ["one"] == [b.text for b in H.blocks(f"<p>one<{name} a='b'>x<p>y</p></{name}>")]


def test_many_open_elements_are_read_once():
    assert len(H.blocks("<svg><select><p>x</p>" * 20_000)) == 20_000


def test_made_pages_are_labelled():
    net, wrong, total = H.trained(), 0, 0
    for found, y in H.training_pages(200, 4242):
        p = net.label([H.features(found)])[0] >= 0.5
        wrong, total = wrong + int((p != y).sum()), total + len(y)
    assert wrong <= 0.01 * total


def test_a_long_page_among_short_ones():
    long = "<article><h1>Long</h1>" + "<p>Some words here, and more.</p>" * 20_000 + "</article>"
    short = "<nav><a href='/'>Home</a></nav><article><p>Some words here, and more.</p></article>"
    net = H.trained()
    tracemalloc.start()
    got = H.main_texts([short] * 60 + [long] + [short] * 60, net)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[0] == got[-1] == H.main_texts([short], net)[0] and got[60].count("\n") > 19_000 and peak < 300e6


def test_slices_and_groups_change_no_label(monkeypatch):
    pages = [H.features(b) for b, _ in H.training_pages(40, 99)]
    net = H.trained()
    whole = [H._sigmoid(net.logits(*H.padded([p]))[0])[0] for p in pages]
    for size in (1, 7, 50, 400):
        monkeypatch.setattr(H, "GROUP_BLOCKS", size)
        assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(net.label(pages), whole))


def test_gradients_match_differences():
    net, rng = H.Labeller(1), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, lengths, y = rng.standard_normal((2, 4, H.WIDTH)), np.array([4, 2]), rng.integers(0, 2, (2, 4)).astype(float)
    _, grads = net.gradients(x, lengths, y)
    for k in ("hf", "cb", "o", "xb"):
        flat, g = net.p[k].reshape(-1), grads[k].reshape(-1)
        for i in rng.choice(len(flat), 3):
            keep = flat[i]
            losses = []
            for d in (1e-4, -1e-4):
                flat[i] = keep + d
                losses.append(net.gradients(x, lengths, y)[0])
            flat[i] = keep
            assert abs((losses[0] - losses[1]) / 2e-4 - g[i]) < 1e-3


def article(page: str) -> str:
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    return "\n".join(x for part in re.split(r"</?(?:p|h1)>", inner) if (x := " ".join(html.unescape(re.sub(r"<[^>]*>", "", part)).split())))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_of_the_tables(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    got = H.extract(pages).collect()
    assert len(got) == pages.count() and all(r.text == article(r.html) for r in got)


def test_null_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (2, "", "b"), (3, "<article><p>Some words here, and more.</p></article>", "c")], "page_id long, html string, text string")
    got = sorted((r.page_id, r.text) for r in H.extract(df, keep=["page_id", "text"]).collect())
    assert got == [(1, ""), (1, ""), (2, ""), (3, "Some words here, and more.")]
