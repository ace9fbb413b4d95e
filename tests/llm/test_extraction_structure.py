"""What the extraction leaves out, whatever its size; hostile pages; the scan against all subsequences."""

import time

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import extraction

ARTICLE = "<h1>A day at the lake</h1>" + "".join(
    f"<p>Sentence number {i} of the story tells what the children found near the water.</p>" for i in range(5))
WORDS = "A day at the lake " + " ".join(
    f"Sentence number {i} of the story tells what the children found near the water." for i in range(5))


@pytest.fixture(scope="module")
def learned():
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    return extraction.learn([p for p in pages if p][:200])


def crowd(kind, n):
    if kind == "comments":
        return '<div class="comments">' + "".join(
            f"<div class='comment'><b>Reader {i}</b><p>I liked this one a lot, thanks for it.</p></div>" for i in range(n)) + "</div>"
    if kind == "menu":
        return "<nav><ul>" + "".join(f'<li><a href="/{i}">Go to page {i}</a></li>' for i in range(n)) + "</ul></nav>"
    if kind == "form":
        return "<form>" + "".join(f"<label>Field {i}</label><input name=x{i}><p>Fill in field {i} here.</p>" for i in range(n)) + "</form>"
    if kind == "sidebar":
        return "<aside><h2>More</h2>" + "".join(f"<p>Another story number {i} that you may read.</p>" for i in range(n)) + "</aside>"
    return '<footer>' + "".join(f"<p>Address line {i} of the house.</p>" for i in range(n)) + "</footer>"


@pytest.mark.parametrize("n", [1, 10, 100, 1000])
@pytest.mark.parametrize("kind", ["comments", "menu", "form", "sidebar", "footer"])
@pytest.mark.parametrize("place", ["inside", "before", "after"])
@pytest.mark.parametrize("labelled", [True, False])
def test_left_out_at_any_size(learned, kind, n, place, labelled):
    extra, tag = crowd(kind, n), "article" if labelled else "div"
    inner = ARTICLE + extra if place == "inside" else ARTICLE
    page = (f"<html><head><title>T</title></head><body>{extra if place == 'before' else ''}"
            f"<{tag}>{inner}</{tag}>{extra if place == 'after' else ''}</body></html>")
    for weights in (learned, extraction.Weights()):
        assert extraction.extract(page, weights) == WORDS


def test_wrappers_that_hold_all_paragraphs_stay(learned):
    for opening, closing in (('<div class="right-sidebar">', "</div>"), ('<form id="aspnetForm">', "</form>"),
                             ('<form><div class="social widget">', "</div></form>")):
        comments = crowd("comments", 40)
        assert extraction.extract(f"<body>{opening}{ARTICLE}{comments}{closing}</body>", learned) == WORDS
        assert extraction.extract(f"<body><article>{opening}{ARTICLE}{closing}{comments}</article></body>", learned) == WORDS


@pytest.mark.parametrize("piece", [
    "<b><p>x", "<b>", "<a ", "<a \">\" ", "<a '>\" ", "</b>", "<p><button><center>", "<ul><b><b><li>x", "<svg><g>", "<svg><foreignobject><p>",
    "<div>x", "<script ", "<!-- x", "<table><td>x", "<li>x", "&amp;", "< ", "<a b=\"", "<x y='a>", "<div class=ad>x", "<p class=comment>x</p>"])
def test_hostile_pages_take_linear_time(piece):
    """A megabyte takes at most some seconds, and about as many times as long as its parts."""
    weights = extraction.Weights()
    page = "<h1>Title</h1>" + piece * (1_000_000 // len(piece))
    start = time.process_time()
    extraction.extract(page, weights)
    assert time.process_time() - start < 10


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.sampled_from(["p", "/p", "div", "=nav", "article"])), max_size=14))
def test_region_has_the_largest_sum_of_all(parts):
    weights = extraction.Weights(tags={"p": -0.5, "/p": -0.25, "div": -2.0, "=nav": -4.0, "article": -3.0})
    items = [extraction.Item("text", "w " * p, p) if isinstance(p, int) else extraction.Item(p) for p in parts]
    values = [i.words * weights.word if i.kind == "text" else weights.tag(i.kind) for i in items]
    sums = [(sum(values[a:b]), a, b) for a in range(len(items)) for b in range(a + 1, len(items) + 1)]
    start, end = extraction.best_region(items, weights)
    assert sum(values[start:end]) == max([0.0, *[s for s, _, _ in sums]])
