"""Main text of pages: markup cases, learned weights, held-out pages."""

import random

import pytest

from winnow.llm import html_text as H

NAV = "<nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>Menu two</a></li></ul></nav>"
FOOTER = "<footer>&copy; example and more words here to read</footer>"


def page(body, before=NAV, after=FOOTER):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{before}<article>{body}</article>{after}</body></html>"


@pytest.fixture(scope="module")
def weights(spark):
    draw = random.Random(2)
    rows = []
    for _ in range(60):
        text = "".join(f"<p>{' '.join(draw.choices(['sun', 'rain', 'wind', 'snow'], k=draw.randint(5, 40)))}</p>" for _ in range(4))
        rows.append((page(f"<h1>On weather</h1>{text}", NAV + "<div class='ad'>Buy these things now</div>"),))
    rows += [(None,), ("",), ("no markup at all",)]
    return H.train(spark.createDataFrame(rows, "html string"))


CASES = [
    ("<h1>Head &amp; tail</h1><p>One\n  two<br>three</p>", "Head & tail One two three"),
    ("<p>un<b>bro</b>ken <i>inline</i></p><p>next", "unbroken inline next"),
    ("<p>a &lt;b&gt; &#233;&eacute; &am</p>", "a <b> éé &am"),
    ("<p>before</p><aside>side</aside><form><p>mail</p></form><p>after</p>", "before after"),
    ("<p>text</p><div class='cookie-notice'><p>We use</p></div><section id=comments><p>first!</p></section><p>end</p>", "text end"),
    ("<p>a</p><script>var x = '<p>no</p>';</script><style>q</style><!-- <p>c</p> --><p>b</p>", "a b"),
    ("<p>x < y & z</p><P CLASS=lead>Upper</P>", "x < y & z Upper"),
    ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2</table>", "one two c1 c2"),
    ("<header>by line</header><p>body of it</p><button>Share</button>", "body of it"),
    ("", ""),
]


@pytest.mark.parametrize(("body", "text"), CASES)
def test_cases(weights, body, text):
    assert H.main_text(page(body), weights) == text


def test_marks_are_whole_names_and_not_of_main_elements(weights):
    want = "A title of five words 5 euro a share story"
    body = "<div class='post-header'><h1>A title of five words</h1></div><div class=\"share-price\"><p>5 euro a share</p></div><p>story</p>"
    assert H.main_text(page(body), weights) == want
    whole = page(body).replace("<html>", "<html class='sidebar'>").replace("<article>", "<main id=nav><article class='post no-sidebar modal'>")
    for attributes in ("class='has-sidebar'", "class=sidebar", "id='nav-target'"):
        marked = whole.replace("<body>", f"<body {attributes}>")
        assert H.main_text(marked, weights) == want
        assert any(t.gold for t in H.tokenize(marked))
    assert H.main_text(page(body + "<div class='x share'><p>on</p></div><p>end</p>"), weights) == f"{want} end"


def test_region_is_the_best_one(weights):
    draw = random.Random(4)
    for _ in range(30):
        parts = [draw.choice(["<p>some words here</p>", NAV, FOOTER, "<div class=ad>x y</div>", "<h1>t</h1>"]) for _ in range(6)]
        tokens = list(H.tokenize("".join(parts)))
        scores = [
            H._tag_score(t, weights) if t.text is None else len(t.text.split()) * H._word_score(t, weights)
            for t in tokens
        ]
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0)
        low, high = H.region(tokens, weights)
        assert sum(scores[low:high]) == pytest.approx(max(best, 0))


def test_page_without_an_article_and_without_weights(weights):
    text = "<html><body>" + NAV + "<h1>Title</h1><p>" + "words of the story " * 20 + "</p>" + FOOTER + "</body></html>"
    want = "Title " + ("words of the story " * 20).strip()
    assert H.main_text(text, weights) == want
    assert H.main_text(text, {}) == want
    assert H.main_text("", {}) == "" == H.main_text("<p", weights)


def test_extract(spark):
    rows = [(1, "u", page("<p>x y</p>"), "old", 1), (2, None, None, "old", 2), (3, "u", "", "old", 3), (1, "u", page("<p>x y</p>"), "old", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = H.extract(pages, H.train(pages))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id, r.text, r.n_chars) for r in got.collect()) == [(1, "x y", 3), (1, "x y", 3), (2, "", 0), (3, "", 0)]
    none = pages.limit(0)
    assert H.extract(none, H.train(none)).count() == 0
