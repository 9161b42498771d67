import html
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pages_by_hand import PAGES

from fieldloom.llm import htmltree


@pytest.fixture(scope="module")
def model():
    return htmltree.train(htmltree.labelled_pages())


def by_hand(source):
    """Blocks of the article of a page of the plain layout."""
    found = re.search("<article>(.*)</article>", source, re.S)
    parts = re.split("</?(?:p|h1|article)>", found[1]) if found else []
    return "\n\n".join(x for x in (" ".join(html.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in parts) if x)


def pages():
    r = random.Random(7)
    word = lambda: "".join(r.choices("abc def gh é".split(), k=3))
    out = []
    for k in range(40):
        text = [" ".join(word() for _ in range(r.choice([1, 2, 9, 60]))) for _ in range(r.choice([0, 1, 3, 9]))]
        body = f"<h1>{word()} &amp; {word()}</h1>" + "".join(f"<p><b>{t}<br><p>{word()}&nbsp;x</p>" if r.random() < 0.3 else f"<p>{t}\n  {word()}</p>" for t in text)
        out.append(f"<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul>{''.join(f'<li><a href=/{k}>{word()}</a></li>' for k in range(4))}</ul></nav><!-- ad --><div class=\"ad\">{word()} {word()}. {word()}</div><article>{body}</article><footer>&copy; {word()} {word()}.\n{word()}</footer>" + ("</body></html>" if k % 3 else ""))
    return out


def test_plain_layout(model):
    every = pages()
    assert model.texts(every) == [by_hand(x) for x in every]


def test_unseen_labelled_pages(model):
    trees = [htmltree.Page(x) for x in htmltree.labelled_pages(150, seed=77)]
    forest = htmltree.Forest(trees)
    kept = htmltree.marginals(forest, model.node, model.edge)[0] > 0.5
    own = np.concatenate([t.own for t in trees]) > 0
    gold = np.concatenate([np.array(t.gold) for t in trees])
    assert (kept == gold)[own].mean() > 0.98


def test_marginals_against_enumeration():
    page = htmltree.Page("<div><p>a<b>c</b></p><ul><li>d</ul></div>")
    forest = htmltree.Forest([page])
    r = np.random.default_rng(1)
    node, edge = r.normal(size=htmltree.FEATURES), r.normal(size=htmltree.EDGES * 4)
    n, pair = len(page.kinds), edge.reshape(htmltree.EDGES, 2, 2)
    total, one = 0.0, np.zeros(n)
    for code in range(2**n):
        x = [code >> k & 1 for k in range(n)]
        weight = np.exp(sum(x[k] * (forest.x[k] @ node) for k in range(n)) + sum(pair[forest.edge[k], x[page.parents[k]], x[k]] for k in range(1, n)))
        total += weight
        one += weight * np.array(x)
    assert np.allclose(htmltree.marginals(forest, node, edge)[0], one / total)


def test_odd_pages(spark, model):
    deep = "<article>" + "<b>" * 3000 + "deep text" + "</b>" * 3000 + "</article>"
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<article><p>a &lt;b&gt; c</p></article><script>x"), (3, "u", "<article><p>a &lt;b&gt; c</p></article><script>x"), (4, "u", deep), (5, "u", "<<<>>> < a < b"), (6, None, "<nav><a href=x>n</a></nav>")]
    df = spark.createDataFrame(rows, "page_id long, text string, html string")
    found = {r.page_id: r.text for r in htmltree.extract(df, model).collect()}
    assert found[1] == found[2] == "" and found[3] == "a <b> c" and found[4] == "deep text" and found[6] == ""
    assert htmltree.extract(df, model).columns == ["page_id", "html", "text"] and htmltree.extract(df.limit(0), model).count() == 0


@pytest.mark.parametrize("odd", ["<svg class=i/>", "<svg class=\"a>b\" />", "<svg><path d=M0/></svg>", "<button>", "<select>", "<object>", "<noscript>", "<canvas>", "<button-row>b</button-row>", "<select-box>", "<title-bar>"])
def test_unclosed_self_closed_and_custom_elements(model, odd):
    long = "words of the article that go on, and on, for a while. " * 4
    text = model.texts([f"<body><article><p>one {long} {odd} two</p><p>three {long}</p></article></body>"])[0]
    assert text.startswith("one words") and "two" in text and "three words" in text


@pytest.mark.parametrize("depth", [100, 260, 3000])
def test_menus_are_told_at_any_depth(model, depth):
    long = "words of the article that go on, and on, for a while. " * 4
    menu = "<nav class=menu><ul>" + "".join(f"<li><a href=/{k}>go there</a></li>" for k in range(5)) + "</ul></nav>"
    text = model.texts([f"<body><article><p>{long}</p>" + "<div>" * depth + menu + "</div>" * depth + f"<p>{long}</p></article></body>"])[0]
    assert "go there" not in text and text.count("words of the article") == 8


@pytest.mark.parametrize("piece", ["<a ", "<p>x</b>", "<!--", "<script", "<i><p>"])
def test_time_goes_with_length(piece):
    def took(n):
        began = time.perf_counter()
        htmltree.Page(piece * n)
        return time.perf_counter() - began

    took(1000)
    assert min(took(80_000) for _ in range(2)) < 6 * max(min(took(20_000) for _ in range(3)), 0.02)


def test_text_after_the_last_tag(model):
    assert htmltree.Page("<p>one</p> a < b and <c <!-- d").blocks[-1][0][1].strip() == "a < b and <c"
    assert not any(text.strip() for block in htmltree.Page("<script>var x = 1; y < z").blocks for _, text in block)


def test_pages_labelled_by_hand(model):
    """F1 of words over layouts that the generator of training pages doesn't make."""
    shared = found = gold = 0
    for source, blocks in PAGES:
        got, want = Counter(model.texts([source])[0].split()), Counter(" ".join(blocks).split())
        shared, found, gold = shared + (got & want).total(), found + got.total(), gold + want.total()
    assert 2 * shared / (found + gold) >= 0.9
