"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into blocks of text at its block-level tags. A block is described by its word count and link density, by
those of the blocks before and after it, and by what holds it: an article, a heading, a paragraph, a list item, or a part
around the article, known by its tag or by its class name, with the share of the page that this part holds. A decision
tree, grown from the blocks of labelled pages, says which blocks are main text; no feature decides by itself.

Null html counts as empty; a page without main text gives the empty text; an empty table gives no rows. Pages of any length are read whole, also cut
off ones. Rows are independent, so repeated rows give equal results; columns not named are not read.
"""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stocklens.llm.common import slices, text

#: Elements whose content is no text of the page, or is a control's.
DROPPED = "script style noscript template textarea select button svg canvas iframe object math title datalist".split()
#: Elements that hold no article text wherever they are; ``header`` only outside an article.
BOILER_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
#: Elements that do not end a block.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li td th dt dd option".split())
#: Words of class, id and role that name parts around an article.
BOILER_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments
    commentlist consent contentinfo cookie cookies copyright dialog disclaimer disqus feedback footer gdpr hidden login
    masthead menu menubar modal nav navbar navigation newsletter notice overlay pager pagination paywall popup promo
    promoted promotion recommend recommended related replies reply respond search share sharing sidebar signup skip
    social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets""".split()
)
#: Elements whose class is about the whole page or the article, not about a part to leave out.
WHOLE = ARTICLE_TAGS | HEADINGS | {"html", "body", "p"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(DROPPED)})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attributes2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
#: Class names that say what an element is combined with, not what it is.
ABOUT = re.compile(r"(?:has|with|no|without|not|js)[-_]")
#: Last words of class names that only say that there is a part: the word before names it.
PARTS = frozenset("area bar block box button buttons container form group holder inner item items links list module outer panel section wrap wrapper".split())


@dataclass
class Block:
    boiler: int
    marked: int
    region: int
    article: int
    heading: int
    paragraph: int
    item: int
    parts: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0
    linked: int = 0


def names_part(name: str) -> bool:
    """Whether a class name says that an element is a part around the article: by its head, the last word that says
    something, so that ``site-footer`` and ``share-bar`` do and ``share-price-report`` does not."""
    words = WORDS.findall(name)
    while len(words) > 1 and words[-1] in PARTS:
        words.pop()
    return bool(words) and words[-1] in BOILER_WORDS and not ABOUT.match(name)


def _around(tag: str, attributes: str, in_article: bool) -> int:
    """Whether an element is a part around the article: 1 by its tag or as it is hidden, 2 by a class name, else 0."""
    if tag in BOILER_TAGS or tag == "header" and not in_article:
        return 1
    if not attributes or tag in WHOLE:
        return 0
    found = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and NO_DISPLAY.search(value):
            return 1
        if name in ("class", "id", "role") and any(map(names_part, value.split())):
            found = 2
    return found


def blocks(page: str) -> list[Block]:
    """Text blocks of a page, in page order."""
    found: list[Block] = []
    opened: list[tuple[str, int, bool]] = []  # tag, part around the article, article
    boiler = marked = region = regions = article = links = 0
    heading = paragraph = item = 0

    def fresh() -> Block:
        return Block(int(boiler > 0), int(marked > 0), region if boiler or marked else 0, int(article > 0), heading, paragraph, item)

    def enter(tag: str, around: int) -> None:
        nonlocal boiler, marked, region, regions, article
        opened.append((tag, around, tag in ARTICLE_TAGS))
        if around and not boiler and not marked:
            regions += 1
            region = regions
        boiler += around == 1
        marked += around == 2
        article += tag in ARTICLE_TAGS

    block = fresh()

    def flush():
        nonlocal block
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                block.words = block.text.count(" ") + 1
                found.append(block)
        block = fresh()

    def add(raw: str):
        nonlocal block
        if raw:
            plain = html.unescape(raw) if "&" in raw else raw
            if not block.parts:
                block = fresh()
            block.parts.append(plain)
            if links:
                block.linked += len(plain.split())

    at = 0
    for token in TOKEN.finditer(page):
        add(page[at : token.start()])
        at = token.end()
        tag = token["tag"] or token["tag2"]
        if not tag:
            continue
        tag, closes = tag.lower(), bool(token["end"] or token["end2"])
        if tag == "a":
            links = 0 if closes else 1
            continue
        if tag == "br":
            block.parts.append(" ")
            continue
        if tag in INLINE and closes:
            if any(t == tag for t, _, _ in opened):  # only menu-like inline elements are kept open
                flush()
        elif tag in INLINE:
            attributes = token["attributes"] or token["attributes2"] or ""
            if not attributes or tag in VOID or not _around(tag, attributes, article > 0):
                continue
        if closes:
            if tag not in INLINE:
                flush()
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == tag:
                    for _, around, was_article in opened[k:]:
                        boiler -= around == 1
                        marked -= around == 2
                        article -= was_article
                    del opened[k:]
                    break
            links = 0 if tag not in INLINE else links
            heading = 0 if tag in HEADINGS else heading
            paragraph = 0 if tag == "p" else paragraph
            item = 0 if tag in ITEMS else item
        else:
            flush()
            heading, paragraph = int(tag in HEADINGS), int(tag == "p")
            item = 1 if tag in ITEMS else item if tag in ("p", "div", "ul", "ol") else 0
            if tag not in VOID:
                around = _around(tag, token["attributes"] or token["attributes2"] or "", article > 0)
                if around or tag != "p" and tag not in ITEMS:
                    enter(tag, around)
        if not block.parts:
            block = fresh()
    add(page[at:])
    flush()
    return found


#: Names of a block's features, in order.
FEATURES = "boiler marked share article heading paragraph item words density before_words before_density after_words after_density".split()


def features(found: list[Block]) -> np.ndarray:
    """Features of one page's blocks, in page order.

    ``share`` is the share of the page's words in the part around the article that holds the block: what holds most of a
    page is no part around it, whatever its name. It is -1 for blocks in no such part.
    """
    rows = np.array([(b.boiler, b.marked, 0, b.article, b.heading, b.paragraph, b.item, b.words, min(b.linked, b.words) / max(b.words, 1)) for b in found], float)
    region = np.array([b.region for b in found])
    inside = np.bincount(region, weights=rows[:, 7])
    rows[:, 2] = np.where(region > 0, inside[region] / max(rows[:, 7].sum(), 1), -1)
    none = np.zeros((1, 2))
    sides = np.concatenate([none, rows[:, 7:9], none])
    return np.column_stack([rows, sides[:-2], sides[2:]])


def labelled_pages(count: int = 180, seed: int = 11) -> list[str]:
    """Labelled pages: the words of main text are ``main``, all others ``other``. Layouts take turns; sizes are drawn."""
    rng = np.random.default_rng(seed)

    def words(low: int, high: int, word: str = "main") -> str:
        return " ".join([word] * int(rng.integers(low, high + 1)))

    def link(low: int = 1, high: int = 6, word: str = "other") -> str:
        return f"<a href=x>{words(low, high, word)}</a>"

    def many(make, low: int, high: int) -> str:
        return "".join(make() for _ in range(int(rng.integers(low, high + 1))))

    def paragraph() -> str:
        return f"<p>{words(12, 120)}</p>" if rng.random() < 0.6 else f"<p>{words(1, 8)}</p>" if rng.random() < 0.6 else f"<p>{words(2, 9)} {link(1, 12, 'main')} {words(1, 6)}</p>"

    def long() -> str:
        return f"<p>{words(25, 120)}</p>"

    def items(tag: str = "li") -> str:
        return "<ul>" + many(lambda: f"<{tag}>{words(3, 14)}</{tag}>" if rng.random() < 0.7 else f"<{tag}>{link(2, 8, 'main')} {words(2, 8)}</{tag}>", 2, 5) + "</ul>"

    def menu(low: int = 2, high: int = 8) -> str:
        return "<ul>" + many(lambda: f"<li>{link()}</li>", low, high) + "</ul>"

    def other(low: int, high: int) -> str:
        return many(lambda: f"<p>{words(low, high, 'other')}</p>", 1, 3)

    def body(tag: str = "h2") -> str:
        return f"<h1>{words(2, 12)}</h1>" + long() + many(lambda: paragraph() if rng.random() < 0.7 else items() if rng.random() < 0.6 else f"<{tag}>{words(1, 6)}</{tag}>{long()}", 2, 9) + long()

    def short() -> str:
        kinds = [f"<p>{words(1, 12)}</p>", f"<p>{link(1, 5, 'main')}</p>", f"<div>{words(1, 9)}</div>", f"<ul><li>{words(1, 7)}</li><li>{link(1, 4, 'main')}</li></ul>", f"<table><tr><td>{words(1, 4)}</td><th>{words(1, 4)}</th></tr></table>"]
        return kinds[int(rng.choice(5, p=[0.5, 0.15, 0.15, 0.1, 0.1]))]

    def short_body() -> str:
        return f"<h1>{words(1, 8)}</h1>" + many(short, 1, 8)

    def related() -> str:
        return f"<h3>{words(1, 3, 'other')}</h3>" + menu(3, 8)

    name = lambda options: str(rng.choice(options.split()))
    layouts = [
        lambda: f"<nav>{menu()}</nav><div class=ad>{words(4, 20, 'other')}</div><article>{body()}</article><footer>{words(2, 15, 'other')}</footer>",
        lambda: f"<header>{words(1, 9, 'other')}</header><article><header><h1>{words(2, 9)}</h1></header>{short_body()}<aside>{other(2, 30)}</aside><div class={name('comments share-bar related-links')}>{other(1, 70)}{menu()}</div><p>{words(1, 5)}</p></article>",
        lambda: f"<div id=top>{many(link, 2, 6)}</div><div class=content>{body()}</div><div id=comments>{other(3, 60)}</div><form><label>{words(1, 3, 'other')}</label><p>{words(2, 9, 'other')}</p></form><div class=sidebar>{related()}</div><div>{words(2, 8, 'other')}</div>",
        lambda: many(lambda: f"<div>{link(1, 5)}</div>", 2, 6) + many(lambda: f"<div>{words(25, 110)}</div>", 2, 6) + many(lambda: f"<div>{link(1, 7)}</div>", 2, 5) + f"<div>{words(2, 8, 'other')}</div>",
        lambda: f"<div>{menu()}</div><div class='{name('widget notice popup overlay hidden-gem banner')} page'>{body()}</div><div class=footer>{words(2, 12, 'other')}</div>",
        lambda: f"<div class={name('cookie-notice gdpr consent-box')}>{other(5, 40)}</div><div>{body()}{long()}{long()}{long()}</div><aside>{other(2, 40)}</aside><div>{related()}</div>",
        lambda: many(lambda: f"<div>{menu(3, 9)}</div>", 1, 3) + f"<div>{words(1, 3, 'other')}</div>",
        lambda: f"<table><tr><td>{link()}</td><td>{link()}</td></tr></table><table><tr><td>{words(25, 90)}</td></tr><tr><td>{long()}{paragraph()}{long()}</td></tr></table><table><tr><td>{link()}</td><td>{link()}</td></tr></table>",
        lambda: f"<div hidden>{other(3, 50)}</div><main>{body()}<div style='display:none'>{other(2, 20)}</div></main><div class='{name('promo newsletter subscribe-box')}'>{other(3, 30)}</div>",
        lambda: f"<div>{menu()}</div>{body('h3')}<p>{words(2, 6)} {link(6, 20, 'main')}</p>{long()}{related()}<div>{words(2, 9, 'other')}</div>",
        lambda: f"<article>{body()}</article><section class={name('comments recommended taboola')}>{other(4, 90)}</section>{related()}<footer>{menu()}</footer>",
        lambda: f"<article>{short_body()}</article><nav>{menu()}</nav><footer>{other(2, 30)}</footer>",
        lambda: f"<div>{menu()}</div><div>{body()}</div>",
        lambda: f"<nav>{menu()}</nav><div class=ad>{words(3, 20, 'other')}</div><article>{body()}{many(short, 0, 3)}</article>",
        lambda: f"<main>{many(short, 1, 4)}</main>" + (f"<div>{menu()}</div>" if rng.random() < 0.5 else ""),
        lambda: f"<p>{words(1, 90)}</p>" if rng.random() < 0.5 else f"<h1>{words(1, 9)}</h1>{many(paragraph, 1, 4)}",
        lambda: many(lambda: f"<div>{words(10, 90)}</div>", 1, 4) + (f"<div>{link(1, 5)}</div>" if rng.random() < 0.5 else ""),
        lambda: f"<div class='{name('search-story page-with-sidebar price-report')}'>{body()}{items()}</div><div class='{name('site-footer social-links pager copyright-notice')}'>{other(2, 25)}</div>",
    ]
    return [layouts[k % len(layouts)]() for k in range(count)]


@dataclass
class Node:
    """A leaf's answer, or a question: at most ``limit`` in ``feature`` goes left."""

    answer: bool
    feature: int = -1
    limit: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1) -> Node:
    """A decision tree by Gini impurity; ties go to the first feature and the lowest limit."""
    node = Node(bool(2 * y.sum() > len(y)))
    if not depth or y.all() or not y.any():
        return node
    best = (len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        for limit in (values[1:] + values[:-1]) / 2:
            left = x[:, k] <= limit
            if min(left.sum(), (~left).sum()) < least:
                continue
            impurity = sum(2 * part.sum() * (1 - part.mean()) for part in (y[left], y[~left]))
            if impurity < best[0]:
                best = (impurity, k, float(limit))
    if best[1] >= 0:
        node.feature, node.limit = best[1], best[2]
        left = x[:, node.feature] <= node.limit
        node.left, node.right = grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least)
    return node


def decide(node: Node, x: np.ndarray) -> np.ndarray:
    """Answers for all rows."""
    out = np.full(len(x), node.answer)
    if node.feature >= 0:
        left = x[:, node.feature] <= node.limit
        out[left], out[~left] = decide(node.left, x[left]), decide(node.right, x[~left])
    return out


def trained(labelled: list[str] | None = None) -> Node:
    pages = [blocks(page) for page in labelled or labelled_pages()]
    return grow(np.concatenate([features(found) for found in pages]), np.array([b.text.startswith("main") for found in pages for b in found]))


def main_text(page: str, tree: Node) -> str:
    found = blocks(page)
    return " ".join(b.text for b, main in zip(found, decide(tree, features(found)).tolist(), strict=True) if main) if found else ""


def extract(pages: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    tree = trained(labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(page, tree) for page in batch.column(2).to_pylist()]
            lengths = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), text("html").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
