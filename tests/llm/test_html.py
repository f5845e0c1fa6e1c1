"""Wrapper induction on pages without telling tags, on deep and wide ones, and tree matching by brute force."""

import itertools
import random

import pytest

from parley.llm import html


def extract(spark, rows, extra=""):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html.extract(df).collect()}


def plain(i):
    menu = "".join(f"<div class=k1><a href=/{i}{j}>entry {i * j}</a></div>" for j in range(5))
    body = "".join(f"<div class=q7>Paragraph {j} of page {i} tells something of its own {i * 7 + j}.</div>" for j in range(6))
    return f"<html><body><div class=z1>{menu}</div><div class=z2><div class=z3>{body}</div><div class=z4>Contact us at any time, we are glad to hear from you.</div></div><div class=z5>All rights reserved by the owner of this site.</div></body></html>"


def test_content_by_varying_slots(spark):
    got = extract(spark, [(i, f"http://plain.example/{i}", plain(i)) for i in range(2, 12)])
    for i in range(2, 12):
        assert got[i] == " ".join(f"Paragraph {j} of page {i} tells something of its own {i * 7 + j}." for j in range(6))


def test_template_inside_an_article_goes_and_shared_passages_of_some_pages_stay(spark):
    note, passage = "Subscribe to our service for more of this.", "A passage that four of ten pages share, word for word."
    page = lambda i: f"<html><body><article><p>Text {i} of the page.</p>{f'<p>{passage}</p>' if i % 10 < 4 else ''}<p>{note}</p></article></body></html>"
    got = extract(spark, [(i, "https://a.example/x", page(i)) for i in range(20)])
    for i in range(20):
        assert got[i] == f"Text {i} of the page." + (f" {passage}" if i % 10 < 4 else "")


def test_names_inside_the_content(spark):
    page = "<html><body><div class='ad-top'>Buy</div><article><p class='comment-policy'>Policy.</p><div class='header-image-notice'>Image.</div><p class='share-price'>Price.</p><div class='search-results'>Found.</div><div class='cookie-notice'>Cookies.</div><div class='comments'>Bad.</div><section class='related-posts'>More.</section></article></body></html>"
    assert extract(spark, [(1, None, page)])[1] == "Policy. Image. Price. Found."


def test_deep_wide_and_odd_pages(spark):
    deep = "<html><body><article>" + "<div>" * 5000 + "bottom" + "</div>" * 5000 + "<p>end</p></article></body></html>"
    wide = lambda k: "<html><body><main>" + "".join(f"<{'ph2'[j % 2 : j % 2 + 1 + j % 2]}>{k} {j}</{'ph2'[j % 2 : j % 2 + 1 + j % 2]}>" for j in range(5000)) + "</main></body></html>"
    rows = [(1, "http://d/1", deep), (2, "http://d/2", deep.replace("bottom", "other")), (3, "http://w/1", wide(1)), (4, "http://w/2", wide(2)), (5, "http://w/3", wide(3)), (6, None, None), (7, "x", ""), (8, "x", " "), (9, "x", "no markup & more &amp; text")]
    got = extract(spark, rows + rows[:1])
    assert got[1] == "bottom end" and got[2] == "other end" and got[6] == got[7] == got[8] == "" and got[9] == "no markup & more & text"
    assert got[3] == " ".join(f"1 {j}" for j in range(5000)) and len(got[5].split()) == 10_000


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([(1, "http://c", "<article>A</article>", "q", 1, 2)], "page_id long, url string, html string, host string, page int, layout int")
    assert [tuple(r) for r in html.extract(df).collect()] == [(1, "http://c", "A")] and html.extract(df.limit(0)).count() == 0


def grow(rng, depth):
    return [html.Slot(rng.choice("ab"), 0, grow(rng, depth - 1)) for _ in range(rng.randint(0, 3))] if depth else []


def brute(a, b):
    """The largest matching of two forests, over all ordered pairings of their roots."""
    best = 0
    for k in range(1, min(len(a), len(b)) + 1):
        for x in itertools.combinations(a, k):
            for y in itertools.combinations(b, k):
                if all(i.label == j.label for i, j in zip(x, y)):
                    best = max(best, sum(1 + brute(i.children, j.children) for i, j in zip(x, y)))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_simple_tree_matching(seed):
    rng = random.Random(seed)
    a, b = grow(rng, 3), grow(rng, 3)
    total, pairs = html.match(a, b)
    assert total == brute(a, b)
    assert pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
    assert total == sum(1 + brute(a[i].children, b[j].children) for i, j in pairs) and all(a[i].label == b[j].label for i, j in pairs)


def test_depth_does_not_matter(spark):
    """The same page under 20 and under 20,000 nested elements; the menu's role is not lost."""
    page = lambda k: "<html><body>" + "<div>" * k + "<nav><p>Menu item one</p></nav><div class='ad-box'>Buy</div><p>Real text</p>" + "</div>" * k + "</body></html>"
    got = extract(spark, [(i, f"http://h{k}.example/{i}", page(k)) for i, k in enumerate((20, 200, 20_000))])
    assert set(got.values()) == {"Real text"}
    inline = "<html><body><article>" + "<b>" * 30_000 + "deep" + "</i>" * 30_000 + "<p>end</p></article></body></html>"
    assert extract(spark, [(1, "http://i", inline)])[1] == "deep end"


def test_wide_levels_of_alternating_names_end_soon():
    import time

    def level(depth, k):
        return [html.Slot("ab"[i % 2], 0, level(depth - 1, k)) for i in range(k)] if depth else []

    began = time.time()
    for k in (20, 40):
        a, b = level(3, k), level(3, k - 1)
        html.merge(a, b)
    rng = random.Random(3)
    a, b = ([html.Slot(rng.choice("abc"), 0, [html.Slot(rng.choice("xyz")) for _ in range(rng.randint(0, 6))]) for _ in range(1_000)] for _ in range(2))
    assert html.match(a, b)[0] > 1_000 and time.time() - began < 30


def test_names_that_an_article_may_have_itself(spark):
    parts = "".join(f"<div class='{c}'>{c} text.</div>" for c in ("content-header", "social-content", "main-menu-item", "notice", "comments", "cookie-notice", "ad-box", "newsletter-signup"))
    page = f"<html><body><div class='notice'>Site notice</div><div class='main-menu'>Menu</div><article>{parts}</article></body></html>"
    assert extract(spark, [(1, "http://n", page)])[1] == "content-header text. social-content text. main-menu-item text. notice text."
