import html
import random
import re

import pytest

from lexiloom.llm import page_text as P
from lexiloom.llm.dom_tree import block_texts, read_page


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def model(pages):
    return P.fit(pages[:40])


def text(model, source):
    page = read_page(source)
    return "\n\n".join(block_texts(page, model.chosen(page)))


def by_pattern(source):
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", source, re.DOTALL)[1]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(p for p in parts if p)


def test_pages_of_the_table(spark, sf_dir, pages):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = df.select("page_id", P.main_text(df, P.train(df)).alias("t")).orderBy("page_id").collect()
    assert [r["t"] for r in got] == [by_pattern(s) for s in pages]


def test_pages_not_seen_in_training(model, pages):
    rng = random.Random(4)
    wrong = total = 0
    for source in pages[40:] * 8:
        page, labels = P.variant(source, rng)
        chosen = model.chosen(page)
        texts = [i for i, tag in enumerate(page.tag) if tag == "#text"]
        wrong += sum(chosen[i] != bool(labels[i]) for i in texts)
        total += len(texts)
    assert wrong <= 0.04 * total


#: Pages built otherwise than those of the table and its variants, and their main text.
OTHERWISE = [
    ("<body><article><p>See here it is a long sentence of words.</p></article></body>", "See here it is a long sentence of words."),
    ("<html><body><h1>A title of this page</h1><p>The first paragraph says something about it.</p><p>And the second one ends it here.</p></body></html>",
     "A title of this page\n\nThe first paragraph says something about it.\n\nAnd the second one ends it here."),
    ('<body><div class="masthead"><a href="/">Home</a> <a href="/b">News</a></div><div class="prose"><h2>The title is here</h2><p>One paragraph '
     'with a sentence or two. It goes on.</p><p>Another paragraph of text follows after that one.</p></div><div class="rail"><ul><li><a href="#">More</a>'
     '</li><li><a href="#">Top ten</a></li></ul></div></body>',
     "The title is here\n\nOne paragraph with a sentence or two. It goes on.\n\nAnother paragraph of text follows after that one."),
    ("<p>Only one sentence stands on this page.</p>", "Only one sentence stands on this page."),
    ("<div><div>Text in a div that is not named at all, with some words.</div></div>", "Text in a div that is not named at all, with some words."),
    ("<article><p>See <math><mi>x</mi></math> and <object>more</object> of the words.</p></article>", "See x and more of the words."),
    ("<nav><a href=a>One</a><a href=b>Two</a></nav><main><p>Real text is here for the reader.</p></main><footer>Imprint 2020</footer>",
     "Real text is here for the reader."),
    ('<article><p>Real text is here for the reader to see.</p></article><div class="comments"><p>Nice post, I like it.</p></div>',
     "Real text is here for the reader to see."),
    ('<table><tr><td><a href="#">a</a><br><a href="#">b</a></td><td><p>A page laid out as a table has its text here. It is still the text.</p></td></tr></table>',
     "A page laid out as a table has its text here. It is still the text."),
    ('<section class="xq"><h3>Heading of it</h3><p>First of the paragraphs, quite short.</p></section><ul class="yq"><li><a href="#">go</a></li><li><a href="#">on</a></li></ul>',
     "Heading of it\n\nFirst of the paragraphs, quite short."),
]


def test_other_skeletons(model):
    right = sum(text(model, source) == expected for source, expected in OTHERWISE)
    assert right >= 0.9 * len(OTHERWISE), [text(model, s) for s, e in OTHERWISE if text(model, s) != e]


def test_nameless_and_bare_pages(pages, model):
    rng = random.Random(6)
    wrong = total = 0
    for source in pages[40:] * 4:
        words = P.read_words(source)
        for made in (P._nameless(words, rng), P._bare(words, rng)):
            page = read_page(made)
            labels = P.labels_by_markup(page)
            page.cues = [tuple(c for c in cs if c not in P._MARKS) for cs in page.cues]
            chosen = model.chosen(page)
            texts = [i for i, tag in enumerate(page.tag) if tag == "#text" and page.text[i].strip()]
            wrong += sum(chosen[i] != bool(labels[i]) for i in texts)
            total += len(texts)
    assert wrong <= 0.05 * total


def test_empty_tables_repeated_rows_and_clashing_columns(spark):
    page = "<article><p>One text of this page, and a little more.</p></article>"
    rows = [(1, "u", page, "x", 5), (1, "u", page, "x", 5), (2, "v", None, "y", 6), (2, "v", "", None, None), (None, None, page, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, h string, one long")
    got = df.select("page_id", P.main_text(df, P.train(df)).alias("t")).collect()
    assert sorted((str(r["page_id"]), r["t"]) for r in got) == sorted(
        [("1", "One text of this page, and a little more.")] * 2 + [("2", "")] * 2 + [("None", "One text of this page, and a little more.")]
    )
    empty = df.limit(0)
    assert empty.select(P.main_text(empty, P.train(empty)).alias("t")).count() == 0


def test_markup(model):
    source = (
        "<html><head><title>T</title><style>p{}</style></head><body><header><a href='/'>Home</a></header><nav><ul><li><a>x</a></ul></nav>"
        "<article><h1>Head &amp; line</h1><p>One <b>bo</b>ld &#233;&nbsp;word.<p>Two\n\n lines<br>here &lt;i&gt;<!-- no --><script>var a='</p>';</script>"
        "<table><tr><td>c1<td>c2</table></article><section id=comments><p>Nice post</p></section><footer>&copy; me</footer>"
    )
    assert text(model, source) == "Head & line\n\nOne bold é word.\n\nTwo lines here <i>\n\nc1\n\nc2"


def test_broken_and_empty_pages(make, model):
    for source in (None, "", "   ", "<", "<article", "</p></p>", "<script>", "<!--", "&amp;", "<a href='", "<p" * 50):
        assert isinstance(text(model, source), str)
    assert text(model, None) == "" == text(model, "<script>x</script>")


def test_deep_and_long_pages(model):
    assert read_page("<div>" * 5000 + "x").tag.count("div") == 5000
    long = "<article>" + "<p>word word word</p>" * 20000 + "</article>"
    assert text(model, long).count("\n\n") == 19999


def test_messages_give_exact_marginals():
    """Against enumeration of all labellings of a small tree."""
    import itertools
    import math

    page = read_page("<div class=x><p>a b<b>c</b></p><ul><li>d</ul></div>")
    model = P.TreeModel({"tag=p": 0.7, "in=b": -1.1, "tag=ul": 0.4, "cue=x": 0.3}, {k + top: [0.9, -0.4, 0.2, 1.1 + 0.1 * len(top)] for k in ("text", "named", "section", "plain") for top in ("", "@top")})
    feats = P.node_features(page)
    n = len(page.tag)
    mass, total = [0.0] * n, 0.0
    for ys in itertools.product((0, 1), repeat=n):
        s = sum(y * sum(model.nodes.get(f, 0.0) for f in fs) for y, fs in zip(ys, feats))
        s += sum(model.edges[P.edge_kind(page.tag[i], page.cues[i], page.tag[page.parent[i]])][2 * ys[page.parent[i]] + ys[i]] for i in range(1, n))
        w = math.exp(s)
        total += w
        mass = [m + w * y for m, y in zip(mass, ys)]
    assert model.marginals(page) == pytest.approx([m / total for m in mass])


def plain(source):
    page = read_page(source)
    return block_texts(page, [True] * len(page.tag))


@pytest.mark.parametrize(
    "script", ['var s="<!--";', "for(i=0;i<n;i++){} // don't", "x = '<![CDATA[';", 'document.write("<p class=\'a>");', "if (a<b && c>d) {}"]
)
@pytest.mark.parametrize("name", ["script", "style", "textarea", "title"])
def test_what_looks_like_markup_in_hidden_elements(script, name):
    source = f"<article><{name}>{script}</{name}><p>Hello it's me.</p><!-- a --><p>Second one.</p></article>"
    assert plain(source) == ["Hello it's me.", "Second one."]


def test_text_for_pages_without_scripts_is_text():
    assert plain("<article><noscript><p>Shown without scripts.</p></noscript><p>End.</p></article>") == ["Shown without scripts.", "End."]


def test_open_elements_take_linear_time():
    import time

    took = []
    for n in (5_000, 20_000):
        began = time.perf_counter()
        assert len(plain("<b>" * n + "<p>x" * n + "</i>" * n)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_reader_comments_beside_the_article(model):
    comments = "".join(f"<div><b>{n}:</b> I liked this article very much, thank you.</div>" for n in ("Bob", "Ann", "Eve"))
    for start, end in (('<div class="discussion">', "</div>"), ('<section class="responses">', "</section>")):
        article = "<p>The first paragraph of it. It has two sentences.</p><p>And one more of them, which is long enough to be read.</p>"
        page = read_page(f"<html><body><article><h1>A heading</h1>{article}</article>{start}{comments}{end}</body></html>")
        told = "\n".join(block_texts(page, model.chosen(page)))
        assert "first paragraph" in told and "liked" not in told
