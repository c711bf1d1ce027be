"""Main text of web pages by a tree-structured graphical model over the DOM.

Every node of the page (element or text) is content or not. Node potentials are linear in features
of the node (tag, words of its class, id and role, size and link share of its text); parent-child
potentials are a 2 x 2 table for each kind of child. Sum-product messages go up from the leaves and
down from the root once and give exact marginals; a text whose marginal is 1/2 or more is content.

The weights are fitted by gradient ascent on the exact likelihood of labelled pages: at most about
`SAMPLE` distinct pages of the table, whose article or main element labels them, each also in variants
that do not rely on it: with the container under other, unknown or no names and elements of the usual
other kinds (`OTHER`) put in and labelled as not content, as menus of links around unnamed elements, as
pages of a few plain blocks, and as short articles. Words of variants are the page's own. The bound is
`SAMPLE`; everything else runs over all rows and whole pages.

Defined results: null or empty html gives an empty text; a page that never ends what it begins is
read to its end; with no labelled page at all the variants are made from a page of one word; repeated
rows give equal rows; other columns are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import small_batches, table
from lexiloom.llm.dom_tree import Page, block_texts, read_page

SAMPLE = 160
VARIANTS = 9
EPOCHS = 10
RATE = 0.4
DECAY = 1e-4

#: Elements that are put into training pages as what is not content: start tags by kind.
OTHER = [
    "<nav>", "<header>", "<footer>", "<aside>", "<form>", "<menu>", '<div class="nav">', '<div class="menu">',
    '<div class="sidebar">', '<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">',
    '<div class="banner">', '<div class="sponsored">', '<div class="promo">', '<div class="cookie">', '<div class="cookie notice">',
    '<div class="consent">', '<div class="notice">', '<div class="alert">', '<div class="popup">', '<div class="newsletter">',
    '<div class="subscribe">', '<div class="share">', '<div class="social">', '<div class="related">', '<div class="comments">',
    '<section id="comments">', '<div class="comment">', '<ul class="comments">', '<div class="header">', '<div id="header">',
    '<div class="footer">', '<div id="footer">', '<div class="breadcrumb">', '<ul class="pagination">', '<div class="widget">',
    '<div class="login">', '<div class="search">', '<div role="navigation">', '<div role="banner">', '<div role="contentinfo">',
    '<div role="complementary">', '<section class="respond">', '<div class="copyright">', '<div class="legal">', '<div class="toolbar">',
]
#: Elements that hold what readers say, and how they sign it: {0} for the name, {1} for the words.
COMMENTS = [
    '<div class="discussion">', '<section class="responses">', '<div class="replies">', '<section id="reactions">', '<div id="comments">',
    '<ol class="comments">', '<div class="feedback">',
]
SIGNED = ["<div><b>{0}:</b> {1}</div>", "<p><b>{0}</b> {1}</p>", "<div><span>{0}</span><p>{1}</p></div>", "<li>{0}: {1}</li>", "<p>{0}: {1}</p>"]
#: Names under which the container of the main text goes.
CONTAINERS = [
    "<article>", "<main>", '<div class="article">', '<div class="content">', '<div id="content">', '<div class="post">',
    '<div class="entry">', '<div role="main">', '<section class="story">', '<div class="main">', "<article class=\"post\">",
]
#: Blocks that main text is made of, {} for the words.
BLOCKS = [
    "<p>{}</p>", "<p>{}", "<h1>{}</h1>", "<h2>{}</h2>", "<h3>{}</h3>", "<p><b>{}</b></p>", "<ul><li>{}</li><li>{}</li></ul>", "{}", "<div>{}</div>",
    "<blockquote>{}</blockquote>", "<p>{} <a href='#'>{}</a></p>", "<table><tr><td>{}</td><td>{}</td></tr></table>",
    "<section><p>{}</p></section>", "<figure><figcaption>{}</figcaption></figure>", "<pre>{}</pre>", "<p>{} <em>x</em> {}</p>",
]
#: Labels given by markup: these hold the main text, unless one of the others is in between.
_MAIN = frozenset({"article", "main"})
_NOT = frozenset({"nav", "header", "footer", "aside", "form", "menu", "dialog"})


def _bucket(n: int) -> int:
    return min(8, n.bit_length())


def node_features(page: Page) -> list[list[str]]:
    """Names of the features that hold at each node."""
    n = len(page.tag)
    size, linked, stops = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.tag[i] == "#text":
            text = page.text[i].strip()
            size[i] = len(text)
            stops[i] = text.count(". ") + text.count("? ") + text.count("! ") + (text[-1:] in (".", "!", "?"))
        if page.tag[i] == "a":
            linked[i] = size[i]
        up = page.parent[i]
        size[up] += size[i]
        linked[up] += linked[i]
        stops[up] += stops[i]
    out = []
    for i, tag in enumerate(page.tag):
        if tag == "#text":
            out.append([f"in={page.tag[page.parent[i]]}", f"size={_bucket(size[i] // 8)}", f"stops={min(2, stops[i])}"])
        else:
            links = 4 * linked[i] // size[i] if size[i] else 5
            part = 4 * size[i] // size[0] if size[0] else 0
            out.append(
                [f"tag={tag}", f"links={links}", f"span={_bucket(size[i] // 32)}", f"part={part}", f"prose={min(3, stops[i])}"]
                + [f"cue={c}" for c in page.cues[i]]
            )
    return out


_TOP = frozenset({"#page", "html", "body"})


def edge_kind(tag: str, cues: tuple[str, ...], parent: str) -> str:
    """The kind of a child, and whether it stands at the top, which its parent-child potential depends on."""
    if tag == "#text":
        kind = "text"
    else:
        kind = "named" if cues else "section" if tag in _NOT or tag in _MAIN or tag in ("section", "div", "body", "html") else "plain"
    return kind + "@top" if parent in _TOP else kind


class TreeModel:
    """Weights of node features (log-odds of content) and 2 x 2 tables of parent-child kinds."""

    def __init__(self, nodes: dict[str, float] | None = None, edges: dict[str, list[float]] | None = None) -> None:
        self.nodes = nodes if nodes is not None else {}
        self.edges = edges if edges is not None else {}

    def _passes(self, page: Page, feats: list[list[str]]) -> tuple[list[float], list[float], list[float]]:
        """Upward beliefs of nodes, upward messages to parents, full beliefs; all as log-odds."""
        get, n = self.nodes.get, len(page.tag)
        up = [0.0] * n
        for i, fs in enumerate(feats):
            up[i] = sum(get(f, 0.0) for f in fs)
        kinds = [edge_kind(t, c, page.tag[u]) for t, c, u in zip(page.tag, page.cues, page.parent)]
        tables = [self.edges.get(k, (0.0, 0.0, 0.0, 0.0)) for k in kinds]
        message = [0.0] * n
        for i in range(n - 1, 0, -1):
            message[i] = _through(up[i], *tables[i])
            up[page.parent[i]] += message[i]
        full = up[:]
        for i in range(1, n):
            e00, e01, e10, e11 = tables[i]
            outside = full[page.parent[i]] - message[i]
            full[i] = up[i] + _through(outside, e00, e10, e01, e11)
        return up, message, full

    def marginals(self, page: Page) -> list[float]:
        """Probability of content at each node."""
        _, _, full = self._passes(page, node_features(page))
        return [_logistic(x) for x in full]

    def chosen(self, page: Page) -> list[bool]:
        _, _, full = self._passes(page, node_features(page))
        return [x >= 0.0 for x in full]

    def learn(self, page: Page, labels: list[int], rate: float) -> None:
        """One step up the log-likelihood of the labels."""
        feats = node_features(page)
        up, message, full = self._passes(page, feats)
        nodes, edges = self.nodes, self.edges
        step: dict[str, float] = {}
        steps: dict[str, list[float]] = {}
        for i, fs in enumerate(feats):
            g = labels[i] - _logistic(full[i])
            for f in fs:
                step[f] = step.get(f, 0.0) + g
            if i:
                kind = edge_kind(page.tag[i], page.cues[i], page.tag[page.parent[i]])
                table_ = edges.get(kind, (0.0, 0.0, 0.0, 0.0))
                outside = full[page.parent[i]] - message[i]
                score = [table_[0], table_[1] + up[i], table_[2] + outside, table_[3] + outside + up[i]]
                top = max(score)
                p = [math.exp(x - top) for x in score]
                total = sum(p)
                s = steps.setdefault(kind, [0.0] * 4)
                s[2 * labels[page.parent[i]] + labels[i]] += 1.0
                for k in range(4):
                    s[k] -= p[k] / total
        scale = rate / math.sqrt(len(feats))
        for f, g in step.items():
            nodes[f] = nodes.get(f, 0.0) * (1 - DECAY) + scale * g
        for k, g4 in steps.items():
            old = edges.get(k, (0.0, 0.0, 0.0, 0.0))
            edges[k] = [o * (1 - DECAY) + scale * g for o, g in zip(old, g4)]


def _logistic(x: float) -> float:
    return 1.0 / (1.0 + math.exp(-x)) if x > -700 else 0.0


def _through(x: float, e00: float, e01: float, e10: float, e11: float) -> float:
    """Log-odds that a neighbour of log-odds x sends through a table (receiver, sender)."""
    return _plus(e10, e11 + x) - _plus(e00, e01 + x)


def _plus(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def labels_by_markup(page: Page) -> list[int]:
    """1 for nodes inside an article or main element and in nothing of another kind in it."""
    out: list[int] = []
    for i, tag in enumerate(page.tag):
        inside = out[page.parent[i]] if i else 0
        if "other" in page.cues[i] or tag in _NOT:
            inside = 0
        elif tag in _MAIN or "maintext" in page.cues[i]:
            inside = 1
        out.append(inside)
    return out


_MARKS = ("other", "maintext")


def variant(source: str, rng: random.Random) -> tuple[Page, list[int]]:
    """A labelled page made of a page's words, in one of four ways."""
    words = read_words(source) or ["text"]
    way = rng.random()
    if way < 0.55:
        html_ = _renamed(source, words, rng)
    elif way < 0.75:
        html_ = _nameless(words, rng)
    elif way < 0.9:
        html_ = _bare(words, rng)
    else:
        html_ = _wrap(_marked(rng.choice(["<article>", "<main>"]), "maintext") + _short(words, rng, 2) + rng.choice(["</article>", "</main>", ""]), rng)
    page = read_page(html_)
    labels = labels_by_markup(page)
    page.cues = [tuple(c for c in cs if c not in _MARKS) for cs in page.cues]
    return page, labels


def _renamed(source: str, words: list[str], rng: random.Random) -> str:
    """Other elements put in at random, the container under another name."""
    lines = source.replace("<article>", "\0<article>").replace("</article>", "</article>\0")
    head, _, rest = lines.partition("\0")
    body, _, tail = rest.partition("\0")
    name = rng.choice(CONTAINERS)
    inner = body.removeprefix("<article>").removesuffix("</article>") if rng.random() < 0.5 else _short(words, rng)
    cuts = inner.split("<p>")
    for _ in range(rng.randrange(4)):
        cuts[rng.randrange(len(cuts))] += _other(words, rng)
    body = _marked(name, "maintext") + "<p>".join(cuts) + _end(name)
    for _ in range(rng.randrange(5)):
        if rng.random() < 0.5:
            head += _other(words, rng)
        else:
            tail = _other(words, rng) + tail
    if rng.random() < 0.25:
        tail = _comments(words, rng) + tail
    if rng.random() < 0.3:
        head, tail = head + "<div>", "</div>" + tail
    return head + body + tail


def _comments(words: list[str], rng: random.Random) -> str:
    """Signed blocks of readers behind the main text."""
    start, form = rng.choice(COMMENTS), rng.choice(SIGNED)
    said = [form.replace("{0}", _run(words, rng, 2)).replace("{1}", _run(words, rng, rng.choice([12, 60])) + ".") for _ in range(1 + rng.randrange(6))]
    return _marked(start, "other") + "".join(said) + _end(start)


def _nameless(words: list[str], rng: random.Random) -> str:
    """Links and labels around prose, in elements whose names tell nothing."""
    other = lambda: _element(rng.choice(["<div>", "<div>", "<ul>", "<table>", "<section>"]), "other", _links(words, rng), rng)
    main = _element(rng.choice(["<div>", "<div>", "<section>", "<article>", "<main>"]), "maintext", _prose(words, rng), rng)
    parts = [other() for _ in range(rng.randrange(3))] + [main] + [other() for _ in range(rng.randrange(3))]
    if rng.random() < 0.3:
        parts = ["<div>", *parts, "</div>"]
    return _wrap("".join(parts), rng)


def _bare(words: list[str], rng: random.Random) -> str:
    """Blocks of main text with no container, now and then beside links."""
    blocks = []
    for _ in range(1 + rng.randrange(6)):
        start = rng.choice(["<p>", "<p>", "<h1>", "<h2>", "<blockquote>"])
        blocks.append(_marked(start, "maintext") + _run(words, rng, rng.choice([6, 20, 60])) + _end(start))
    if rng.random() < 0.4:
        blocks.insert(rng.choice([0, len(blocks)]), _element(rng.choice(["<nav>", "<ul>", "<div>", "<footer>"]), "other", _links(words, rng), rng))
    return _wrap("".join(blocks), rng)


def _wrap(inner: str, rng: random.Random) -> str:
    return rng.choice(["<html><head><title>t</title></head><body>{}</body></html>", "<body>{}</body>", "{}"]).replace("{}", inner)


def _run(words: list[str], rng: random.Random, most: int) -> str:
    at = rng.randrange(len(words))
    text = " ".join(words[at : at + 1 + rng.randrange(most)])
    return text + "." if rng.random() < 0.5 and text[-1:].isalnum() else text


def _prose(words: list[str], rng: random.Random) -> str:
    head = f"<h1>{_run(words, rng, 8)}</h1>" if rng.random() < 0.5 else ""
    return head + "".join(rng.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"]).replace("{}", _run(words, rng, 60) + ".") for _ in range(1 + rng.randrange(5)))


def _links(words: list[str], rng: random.Random) -> str:
    link = lambda: f'<a href="#">{_run(words, rng, 4)}</a>'
    form = rng.choice(["{}", "<li>{}</li>", "<p>{}</p>", "<span>{}</span>"])
    label = f"<h3>{_run(words, rng, 3)}</h3>" if rng.random() < 0.3 else ""
    return label + rng.choice(["", " ", " | "]).join(form.replace("{}", link()) for _ in range(1 + rng.randrange(7)))


def _element(start: str, mark: str, inner: str, rng: random.Random) -> str:
    """The element under a made-up name, or none."""
    if rng.random() < 0.6:
        name = "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
        start = start[:-1] + f' class="{name}">'
    return _marked(start, mark) + inner + _end(start)


def _end(start: str) -> str:
    return f"</{start[1:].split('>')[0].split()[0]}>"


def _short(words: list[str], rng: random.Random, most: int = 7) -> str:
    """Content of a few blocks of any kind and of any length."""
    out = []
    for _ in range(1 + rng.randrange(most)):
        out.append(rng.choice(BLOCKS).replace("{}", _run(words, rng, rng.choice([4, 12, 60]))))
    return "".join(out)


def _marked(start: str, mark: str) -> str:
    """The start tag with the mark among its names, behind what it has."""
    return start[:-1] + f' id="{mark}">'


def _other(words: list[str], rng: random.Random) -> str:
    start = rng.choice(OTHER)
    parts = []
    for _ in range(1 + rng.randrange(3)):
        text = _run(words, rng, rng.choice([4, 12, 60]))
        parts.append(rng.choice([f"<p>{text}</p>", text, f'<a href="#">{text}</a>', f"<ul><li>{text}</li></ul>", f"<h3>{text}</h3>"]))
    return _marked(start, "other") + "".join(parts) + _end(start)


def read_words(source: str) -> list[str]:
    page = read_page(source)
    return " ".join(block_texts(page, [True] * len(page.tag))).replace("<", " ").replace("&", " ").split()


def fit(sources: list[str]) -> TreeModel:
    """Weights from labelled pages and their variants, in a fixed order."""
    rng = random.Random(17)
    sources = [s for s in sources if "<article>" in s or "<main>" in s] or ["<article><p>text</p></article>"]
    pages = []
    for s in sources:
        page = read_page(s)
        pages.append((page, labels_by_markup(page)))
        pages += [variant(s.replace("<main>", "<article>").replace("</main>", "</article>"), rng) for _ in range(VARIANTS)]
    model = TreeModel()
    for epoch in range(EPOCHS):
        rng.shuffle(pages)
        for page, labels in pages:
            model.learn(page, labels, RATE / (1 + 0.3 * epoch))
    return model


def train(pages: DataFrame, html_col: str = "html") -> TreeModel:
    """Fit on at most about SAMPLE pages, picked by a hash of the page."""
    small_batches(pages.sparkSession)
    source = pages.select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html")).filter("html IS NOT NULL")
    total = source.agg(F.approx_count_distinct("h", 0.01)).first()[0]
    share = min(1.0, SAMPLE / max(1, total))
    # Equal pages are one, and meet as partial aggregates.
    sample = source.filter(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).groupBy("h").agg(F.first("html").alias("html"))
    sample = sample.withColumn("one", F.lit(0))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        model = fit(sorted(set(pdf["html"])))
        rows = [("node", k, [v]) for k, v in model.nodes.items()] + [("edge", k, list(v)) for k, v in model.edges.items()]
        return pd.DataFrame(rows, columns=["what", "name", "weights"])

    got = sample.groupBy("one").applyInPandas(one, "what string, name string, weights array<double>").collect()
    if not got:
        return fit([])
    return TreeModel(
        {r["name"]: r["weights"][0] for r in got if r["what"] == "node"},
        {r["name"]: list(r["weights"]) for r in got if r["what"] == "edge"},
    )


def main_text(pages: DataFrame, model: TreeModel, html_col: str = "html") -> Column:
    """A string column for `pages`: blocks of the main text joined by two newlines."""
    shared = pages.sparkSession.sparkContext.broadcast((model.nodes, model.edges))

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = TreeModel(*shared.value)
        for sources in batches:
            out = []
            for s in sources:
                page = read_page(s)
                out.append("\n\n".join(block_texts(page, m.chosen(page))))
            yield pd.Series(out)

    return extract(F.col(html_col))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = main_text(pages, train(pages))
    return pages.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
