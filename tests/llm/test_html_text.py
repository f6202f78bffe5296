import html
import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import html_text as H


def article_of(page):
    """The article of a given page, taken by its tags alone."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inner))
    return " ".join(html.unescape(inner).split())


def test_blocks():
    page = """<!DOCTYPE html><title>T &amp; x</title><style>p{}</style><script>var a="</p><p>no";</script>
    <nav><ul><li><a href="/a">A</a><li>B</ul></nav><!-- <p>gone</p> --><article><h1>Head</h1><p><b>bo</b>ld &eacute;&#33;
      next<br>line<p class="Big red">open <i>two</i> 3 < 4</article><textarea>x</textarea>tail"""
    got = [(t, p) for t, p, _ in H.blocks(page)]
    assert got == [
        ("T & x", ("title",)), ("A", ("nav", "ul", "li")), ("B", ("nav", "ul", "li")), ("Head", ("article", "h1")),
        ("bold é! next", ("article", "p")), ("line", ("article", "p")), ("open two 3 < 4", ("article", "p", ".big", ".red")), ("tail", ())]
    assert H.blocks("") == H.blocks("<p> </p><script>x") == []
    assert H.blocks("plain")[0][0] == "plain"


def test_gradients():
    model, reader = H.Labeller.fresh(3), H.Reader()
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    pages = [H.blocks("<p>one two<p>three<div>four</div>"), H.blocks("<nav>a</nav>"), H.blocks("<li>x y z<li>w")]
    read, label = reader.read(pages), np.array([1, 0, 1, 0, 1, 1.0])

    def loss():
        p = H.sigmoid(model.forward(read).astype(float))
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    for name, g in model.gradients(read, label).items():
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = model.weights[name][at]
        model.weights[name][at] = old + 1e-2
        up = loss()
        model.weights[name][at] = old - 1e-2
        down = loss()
        model.weights[name][at] = old
        assert abs((up - down) / 2e-2 - g[at]) < 2e-3 + 0.05 * abs(g[at]), name


def test_given_pages_are_read_exactly(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    rows = {r.page_id: r for r in H.main_text(pages).collect()}
    given = pages.collect()
    assert len(rows) == len(given)
    for page in given:
        want = article_of(page.html)
        assert (rows[page.page_id].url, rows[page.page_id].text, rows[page.page_id].n_chars) == (page.url, want, len(want))


@pytest.fixture(scope="module")
def model():
    pick = random.Random(1)
    lines = [" ".join("".join(pick.choice("abcdefgh") for _ in range(pick.randint(1, 8))) for _ in range(pick.randint(2, 60))) for _ in range(200)]
    return H.train([f"<html><body><nav>{lines[0]}</nav><article><p>{a}</article></body></html>" for a in lines]), lines


def test_layouts_not_seen(model):
    labeller, lines = model
    draw, reader, right, total = random.Random(77), H.Reader(), 0, 0
    for _ in range(150):
        page, label = H.made_page(draw, lines)
        found = H.blocks(page)
        if len(found) == len(label):
            right += int(((labeller.forward(reader.read([found])) > 0) == (np.array(label) > 0)).sum())
            total += len(label)
    assert right / total > 0.97


def test_odd_rows(spark):
    long = "<article>" + "<p>word and more words here." * 20000 + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<p", "x"), (None, "u", "<article><p>the one and only text of it</article>", "x"), (4, "u", long, "x"), (4, "u", long, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_text(frame).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[1].text == by[2].text == "" and by[2].url is None
    assert by[None].text == "the one and only text of it"
    assert by[4].n_chars == len("word and more words here. ") * 20000 - 1
    assert H.main_text(frame.limit(0)).count() == 0


def test_text_of_other_elements_is_read():
    page = """<article><p>a<svg class="icon"/>b<p>x <math><mi>y</mi><mo/><mn>2</mn></math> z</p><noscript><p>plain</noscript>
    <object data="f"><p>instead</object><template>later</template><iframe>framed</iframe><p>last<select><option>one<option>two</article><p>after<script>no</script>"""
    found = H.blocks(page)
    assert " ".join(t for t, *_ in found) == "a b x y 2 z plain instead later framed last one two after"
    paths = {t: p for t, p, _ in found}
    assert paths["y"] == ("article", "p", "math", "mi") and paths["2"] == ("article", "p", "math", "mn")
    assert paths["b"][:1] == ("article",) and "svg" not in paths["b"] and paths["plain"] == ("article", "noscript", "p")
    assert paths["instead"] == ("article", "object", "p") and paths["two"][-2:] == ("select", "option") and paths["after"] == ("p",)


@pytest.mark.parametrize("page", ["<a " * 3_300_000, '"' * 10_000_000, '<p "' * 1_000_000, "<p '" * 1_000_000, "<!--" * 1_000_000, "<div>" * 100_000 + "</x>" * 100_000,
                                  "<span>" * 50_000 + "<h1>" * 50_000, "<script>" + "</script " * 300_000, "<div>x" * 50_000])
def test_broken_markup_takes_time_in_proportion(page):
    started = time.time()
    H.blocks(page)
    assert time.time() - started < 20


def test_what_is_left_open_is_no_text():
    assert [b[0] for b in H.blocks('<p title="it>First.')] == ["First."]
    assert [b[0] for b in H.blocks("a < b <p>one</p> <q two")] == ["a < b", "one"]
    assert [b[0] for b in H.blocks("one<!-- two <p>three")] == ["one"]
    assert [b[0] for b in H.blocks("<script>x<p>y</SCRIPT >one<style>z")] == ["one"]
    assert [b[0] for b in H.blocks("<p title='a>b' id=x>one</p>")] == ["one"]
