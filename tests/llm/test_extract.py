import html
import re

import pytest
from pyspark.sql import functions as F

from stocklens.llm import extract, registry


@pytest.fixture(scope="module")
def tree():
    return extract.trained()


def article_of(page):
    """The article's text by plain substitutions, for pages that mark it."""
    part = page[page.index("<article>") + 9 :].split("</article>")[0]
    part = re.sub(r"<[a-z/!][^>]*$", "", part)
    part = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", part))
    return " ".join(html.unescape(part).split())


def test_query_on_pages(spark, sf_dir):
    got = {r.page_id: r for r in registry.queries()["op6_extract"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        found = got[row.page_id]
        assert found.text == article_of(row.html) and found.n_chars == len(found.text) and found.url == row.url


def test_page_without_semantic_tags(tree):
    page = """<html><body class="has-sidebar"><div id=top><a href=x>Home</a> <a href=y>About us</a></div>
    <div class="cookie-notice"><p>We use cookies to improve your experience on this web site and much more is here to read.</p></div>
    <div class=content><h2>A good&nbsp;title</h2><div>Some intro te<b>x</b>t with <a href=q>one link</a> and a few more words &amp; so it is long enough to be text.</div>
    <p>Short one.<p>Another paragraph with a fair number of words, the body of what is told here, and a little more of it.</div>
    <div id="comments"><h3>2 comments</h3><p>I like this so much that I read it twice, thank you for writing it all down.</p></div>
    <form><label>Mail</label><p>Subscribe to our letter</p></form><div class="sidebar"><p>popular</p></div><footer>c 2020</footer></body>"""
    want = "A good title Some intro text with one link and a few more words & so it is long enough to be text. Short one. "
    assert extract.main_text(page, tree) == want + "Another paragraph with a fair number of words, the body of what is told here, and a little more of it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<nav><a href=x>a</a></nav>", ""),
        ("<article><p>One<!-- no --> two<script>var x = '<p>';</script></p><p>&lt;3 &eacute;&#x41;&am", "One two <3 éA&am"),
        ("<article><p title='a > b'>In</p><p cla", "In"),
        ("<article><header><h1>Head</h1></header><p>Text.</p><aside>not this</aside><div class='comments'><p>nor this</p></div></article>", "Head Text."),
        ("<main><ul><li>first</li><li>second</li></ul><table><tr><td>cell</td></tr></table></main>", "first second cell"),
        ("<article><div class='text with-sidebar'><p>kept</p></div><div class='x share-bar'><p>gone</p></div></article>", "kept"),
        ("<article><div style='display: none'>gone</div><p>here<br>and\n\n there</p></article><header>top</header>", "here and there"),
    ],
)
def test_small_pages(tree, page, want):
    assert extract.main_text(page, tree) == want


LONG = "There is a good deal of text in this paragraph, and it goes on for some time, so that nobody takes it for a menu."


@pytest.mark.parametrize("name", ['class="search-engine-story"', 'id="share-price-report"', 'title="the hidden gem"', 'data-hidden="no" class="with-comments"', 'class="notice"', 'class="related popup page"'])
def test_names_lose_no_article(tree, name):
    """What is around the article is known by the head of its name, and never if it holds most of the page."""
    page = f"<nav><a href=x>Home</a></nav><div {name}><h1>The title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class='site-footer'><p>c 2020</p></div>"
    assert extract.main_text(page, tree) == f"The title {LONG} Short. {LONG}"


@pytest.mark.parametrize("name", ["site-footer", "share-bar", "comments-area", "ad", "cookie-notice", "post-comments", "social_links", "promo-box"])
def test_names_of_parts(name):
    assert extract.names_part(name) and not extract.names_part(f"{name}-story") and not extract.names_part("with-comments") and not extract.names_part("area")


def counts(tree, pages):
    import numpy as np

    hits = wrong = lost = 0
    for page in pages:
        found = extract.blocks(page)
        want, got = np.array([b.text.startswith("main") for b in found]), extract.decide(tree, extract.features(found))
        hits, wrong, lost = hits + (want & got).sum(), wrong + (~want & got).sum(), lost + (want & ~got).sum()
    return hits / (hits + wrong), hits / (hits + lost)


def test_precision_and_recall_on_other_pages(tree):
    pages = extract.labelled_pages(560, seed=77)
    precision, recall = counts(tree, pages)
    assert precision > 0.99 and recall > 0.99
    bare = [p for p in pages if "<article" not in p and "<main" not in p]
    assert len(bare) > 300 and min(counts(tree, bare)) > 0.99


def test_the_tree_is_more_than_its_flags(tree):
    """Neighbours and density decide blocks that the rule "in an article, or not around it" gets wrong."""
    pages = extract.labelled_pages(160, seed=5)
    asked = set()

    def walk(node):
        if node.feature >= 0:
            asked.add(extract.FEATURES[node.feature])
            walk(node.left), walk(node.right)

    walk(tree)
    assert asked & {"before_words", "before_density", "after_words", "after_density"} and {"density", "share"} <= asked
    found = [b for page in pages for b in extract.blocks(page)]
    plain = sum((b.article or not (b.boiler or b.marked)) != b.text.startswith("main") for b in found) / len(found)
    assert plain > 0.1


def plain_features(found):
    total = sum(b.words for b in found)
    out = []
    for k, b in enumerate(found):
        part = sum(o.words for o in found if o.region == b.region) / total if b.region else -1
        density = [min(o.linked, o.words) / o.words for o in found]
        around = [(found[j].words, density[j]) if 0 <= j < len(found) else (0, 0) for j in (k - 1, k + 1)]
        out.append([b.boiler, b.marked, part, b.article, b.heading, b.paragraph, b.item, b.words, density[k], *around[0], *around[1]])
    return out


def test_features_and_decisions_one_by_one(tree):
    def plain_decision(row):
        node = tree
        while node.feature >= 0:
            node = node.left if row[node.feature] <= node.limit else node.right
        return node.answer

    for page in extract.labelled_pages(48, seed=8):
        found = extract.blocks(page)
        rows = plain_features(found)
        got = extract.features(found)
        assert got.tolist() == [pytest.approx(r) for r in rows] and extract.decide(tree, got).tolist() == [plain_decision(r) for r in got.tolist()]


def test_odd_rows(spark, tree):
    schema = "page_id bigint, url string, html string, text string, n_chars string"
    long = "<article>" + "<p>some words of a paragraph</p>" * 20_000
    rows = [(1, "u", None, "x", "x"), (None, None, "<article><p>a</p>", "x", "x"), (2, "u", long, "x", "x"), (2, "u", long, "x", "x"), (3, "u", "<" * 3000, "x", "x")]
    got = extract.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5
    assert {(r.page_id, r.n_chars) for r in got} >= {(1, 0), (None, 1), (2, 20_000 * 26 - 1)}
    assert extract.extract(spark.createDataFrame([], schema)).count() == 0
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert spark.createDataFrame(rows, schema).filter(F.col("page_id") == 99).transform(extract.extract).count() == 0
