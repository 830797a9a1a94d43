"""Main text of pages: made layouts, a plain density walk on random trees, broken markup, whole tables."""

from __future__ import annotations

import random
import re
import time
from html import escape, unescape
from math import e, log

import pandas as pd
import pytest

from tests.conftest import SMALL
from tests.llm.test_operators import AWKWARD, tables
from tidewatch.llm import density, queries

PROSE = ["The first paragraph of the story says a good deal about its matter, and then some more.",
         "Another paragraph goes on with the same story and does not stop before its end is reached.",
         "Short one.", "The last paragraph closes the story, as last paragraphs do, with a remark on the weather."]
STORY = " ".join(PROSE)
PARAGRAPHS = "".join(f"<p>{p}</p>" for p in PROSE)
LINKS = "<ul>" + "".join(f"<li><a href='/{i}'>Section number {i}</a></li>" for i in range(12)) + "</ul>"
BOX = "Buy the finest shoes of the town today and get a second pair for nothing at all, only this week."

LAYOUTS = [
    f"<html><body><nav>{LINKS}</nav><article>{PARAGRAPHS}</article><footer>{BOX}</footer></body></html>",
    f"<body><div class='menu'>{LINKS}</div><div class=content>{PARAGRAPHS}</div><div id=footer>{BOX}</div>",
    f"<body><div>{LINKS}</div><div><div>{PARAGRAPHS}</div></div><div>{LINKS}</div>",
    f"<div id=page><header><h1>Site</h1>{LINKS}</header><main><section><p>{PROSE[0]}<p>{PROSE[1]}</section>"
    f"<section><p>{PROSE[2]}</p><p>{PROSE[3]}</p></section></main><aside>{BOX}</aside></div>",
    f"<body><div class='x'>{PARAGRAPHS}<div class='comments'><p>{BOX}</p><p>{BOX}</p></div></div>",
    f"<body><article>{PARAGRAPHS}<section id=comments><article class=comment><p>{BOX}</p></article></section></article>",
    f"<body><div class='cookie-notice'><p>{BOX}</p></div><div class='post no-sidebar'>{PARAGRAPHS}</div>",
    f"<body class='has-sidebar'><form><p>{BOX}</p><input></form><div class='block'><p>{PROSE[0]}</p><p>{PROSE[1]}</p></div>"
    f"<div class='block'><p>{PROSE[2]}</p><p>{PROSE[3]}</p></div><div class='sidebarLeft'><p>{BOX}</p></div>",
    f"<body><div hidden><p>{BOX}</p></div><div style='display: none'>{BOX}</div><div aria-hidden=true>{BOX}</div>"
    f"<div role=complementary>{BOX}</div><div>{PARAGRAPHS}</div><script>var a = '<p>{BOX}</p>'</script>",
    f"<head><title>{BOX}</title><style>p {{}}</style><p>{PROSE[0]}</p><p>{' '.join(PROSE[1:])}",
]


@pytest.mark.parametrize("number", range(len(LAYOUTS)))
def test_layouts(number):
    assert density.main_text(LAYOUTS[number]) == STORY


def test_text_of_blocks_references_and_breaks():
    page = ("<article><p>a<b>b</b>c <i>d</i><br>e&amp;f &lt;p&gt; &#233;&nbsp;g &am<b>p;</b></p>h\n\t i<ul><li>j<li>k</ul>"
            "<table><tr><td>l<td>m<tr><td>n</table><!-- x --><![CDATA[y]]>o</article>")
    assert density.main_text(page) == "abc d e&f <p> é g &amp; h i j k l m n o"
    assert [density.main_text(x) for x in (None, "", "   ", "<p></p>", "<nav>menu</nav>")] == [""] * 5
    assert density.main_text("plain text < 3") == "plain text < 3"


def random_tree(draw, depth=0):
    """A tag and its children; text is a child that is a string."""
    kids = []
    for _ in range(draw.randint(1, 4)):
        if depth > 3 or draw.random() < 0.45:
            kids.append(" ".join(draw.choice(["word", "longer", "a", "remarkable"]) for _ in range(draw.randint(1, 12))))
        else:
            kids.append(random_tree(draw, depth + 1))
    return draw.choice(["div", "section", "a", "blockquote"]), kids


def plain_choice(tree):
    """The subtree with the largest sum of child densities, by recursion over the tree itself."""
    def measure(node, linked=False):
        tag, kids = node
        linked = linked or tag == "a"
        c = lc = t = lt = 0
        for kid in kids:
            if isinstance(kid, str):
                n = len("".join(kid.split()))
                c, lc = c + n, lc + n * linked
            else:
                kc, kt, klc, klt = measure(kid, linked)
                c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt + (kid[0] == "a")
        return c, t, lc, lt

    body = measure(tree)
    share = body[2] / max(body[0], 1)

    def dense(node, linked):
        c, t, lc, lt = measure(node, linked)
        if not c:
            return 0.0
        base = log(c / max(c - lc, 1) * lc + share * c + e)
        adjusted = 1 if base <= 1 else max(0.0, log(c / max(lc, 1) * max(t, 1) / max(lt, 1)) / log(base))
        return c / max(t, 1) * adjusted

    found = []

    def walk(node, path, linked):
        inside = linked or node[0] == "a"
        total = float(sum(len("".join(k.split())) for k in node[1] if isinstance(k, str)))
        total += sum(dense(k, inside) for k in node[1] if not isinstance(k, str))
        found.append((total, -len(found), path + [(node, dense(node, linked), linked)]))
        for kid in node[1]:
            if not isinstance(kid, str):
                walk(kid, path + [(node, dense(node, linked), linked)], inside)

    walk(tree, [], False)
    path = max(found, key=lambda x: (round(x[0], 9), x[1]))[2]
    threshold = min(d for _, d, _ in path)
    top = path[-1][0]
    for (up, _, linked), (node, _, _) in zip(path, path[1:]):
        inside = linked or up[0] == "a"
        alike = [k for k in up[1] if not isinstance(k, str) and k[0] == node[0] and measure(k)[0]
                 and dense(k, inside) >= threshold]
        if len(alike) > 1:
            top = up
            break
    return top


def written(node):
    tag, kids = node
    return f"<{tag}>" + "".join(escape(k) if isinstance(k, str) else written(k) for k in kids) + f"</{tag}>"


def words(node):
    out = []
    for kid in node[1]:
        if isinstance(kid, str):
            out.append(kid)
        else:
            inner = words(kid)
            out.append(inner if kid[0] == "a" else f" {inner} ")
    return "".join(out)


def test_random_trees_equal_the_plain_walk():
    draw, whole = random.Random(5), 0
    for _ in range(300):
        tree = "body", [random_tree(draw) for _ in range(draw.randint(1, 4))]
        top = plain_choice(tree)
        assert density.main_text(written(tree)) == " ".join(words(top).split())
        whole += top is tree
    assert 20 < whole < 280


def test_broken_and_deep_pages_take_linear_time():
    for unit in ("<b>", "<i><div>", "<a '", "<!--", "<script>", "<", "</", "<p class=\"", "<li>", "x &", "<div>t</p>"):
        start = time.perf_counter()
        density.main_text(unit * (300_000 // len(unit)))
        assert time.perf_counter() - start < 10, unit


def test_query_equals_a_plain_version(spark):
    def article(html):
        inner = re.search("(?s)<article>(.*?)</article>", html)[1]
        return " ".join(unescape(re.sub(r"<[a-z/][^>]*>", " ", re.sub(r"</?b>", "", inner))).split())

    pages = pd.read_parquet(f"{SMALL}/pages.parquet")
    rows = [tuple(r) for r in queries.op11_main_text(spark, SMALL).select("page_id", "url", "text", "n_chars").collect()]
    expected = [(k, u, t, len(t)) for k, u, t in zip(pages.page_id, pages.url, map(article, pages.html))]
    assert sorted(rows) == sorted(expected) and len(rows) > 20


def test_awkward_pages(spark, tmp_path):
    pages = [(1, None, None), (2, "u", ""), (3, "u", PARAGRAPHS), (3, "u", PARAGRAPHS), (None, "v", "<p>" + "x " * 300_000),
             (4, "w", "\x00<p>a\x00b</p>")]
    folder = tables(tmp_path, AWKWARD, pages=pages)
    rows = queries.op11_main_text(spark, folder)
    assert rows.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r.page_id, r.url, r.n_chars) for r in rows.collect()), key=repr)
    assert got == sorted([(1, None, 0), (2, "u", 0), (3, "u", len(STORY)), (3, "u", len(STORY)), (None, "v", 599_999),
                          (4, "w", 5)], key=repr)
