import random
import re
from html import unescape

import pytest

from keyspan.llm import html_wrapper as h


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    return {(r.page_id, r.url): r for r in h.extract_main_text(df).collect()}


def test_whole_table_against_a_plain_reading(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in h.extract_main_text(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", p.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        plain = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x))).strip() for x in parts]
        want = [x for x in plain if x]
        assert got[p.page_id].text.replace(" ", "") == "\n\n".join(want).replace(" ", "")
        assert got[p.page_id].n_chars == len(got[p.page_id].text) and got[p.page_id].url == p.url


@pytest.mark.parametrize(
    "html,want",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; text", "plain <b> text"),
        ("a < b and 2 <3", "a < b and 2 <3"),
        ("<p>one<p>two &amp; three&nbsp;\n four</p>tail", "one\n\ntwo & three four\n\ntail"),
        ("<ul><li>x<li>y</ul>", "x\n\ny"),
        ("<body><header>h</header><main><p>m</p><form>f</form></main><footer>f</footer>", "m"),
        ("<article><p>a</p><div class='comments'><p>c</p></div><section id=share-bar>s</section></article>", "a"),
        ("<div class='cookie-notice'>n</div><div class=content><h1>T</h1><p>b<script>x</p></script>c</div>", "T\n\nbc"),
        ("<!-- c --><p>a<!-- <p>b</p> --></p><div hidden>no</div><div style='display: none'>no</div>", "a"),
        ("<article><h1>T<p>in<em>li</em>ne<br>next</article><aside>no", "T\n\ninline next"),
        ("<p>unclosed <b attr='>'>bold", "unclosed bold"),
        ("<article>" + "<div>" * 3000 + "deep", "deep"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<header><p>x</header><nav>m</nav><p>shadow</p><div class=shadow>kept</div>", "shadow\n\nkept"),
    ],
)
def test_single_pages(html, want):
    page = h.parse(html or "")
    articles = h._articles(page)
    assert "\n\n".join(h.blocks_of(articles or [page], set())) == want


def test_template_of_a_host_goes_and_varying_slots_stay(spark):
    page = "<div><span>The Daily Site</span></div><div class=c><p>story {0} begins</p><p>and ends {0}</p></div><div>All rights</div>"
    rows = [(i, f"http://one.example/{i}", page.format(i)) for i in range(12)]
    rows += [(50, "http://two.example/", page.format(50)), (None, None, page.format(51)), (60, "http://one.example/x", None)]
    rows += [(61, "http://one.example/y", "<div><span>Other head</span></div><p>other page</p>" + "<p>long</p>" * 3000)]
    got = run(spark, rows + rows[:2])
    assert got[3, "http://one.example/3"].text == "story 3 begins\n\nand ends 3"
    assert got[50, "http://two.example/"].text.startswith("The Daily Site")
    assert got[None, None].text.startswith("The Daily Site")
    assert got[60, "http://one.example/x"].text == ""
    assert got[61, "http://one.example/y"].text.startswith("Other head\n\nother page\n\nlong")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert h.extract_main_text(df.union(df.limit(2))).count() == len(rows) + 2
    assert h.extract_main_text(df.limit(0)).count() == 0


def test_tree_matching_finds_the_largest_common_tree():
    a = h.parse("<div><p>1</p><ul><li>x</ul></div><p>2</p>")
    b = h.parse("<p>0</p><div><ul><li>y</ul></div><p>9</p>")
    matched = h.match_trees(a, b, 40_000)
    assert sorted(n.tag for n in matched.values()) == ["#root", "div", "li", "p", "ul"]


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article><p>text</p><article class=comment><p>reader</p></article></article>", "text"),
        ("<div><p>the long main text of a page</p></div><article class=comment>reader</article>", "the long main text of a page"),
        ("<div><p>the long main text of a page</p></div><article>teaser</article>", "the long main text of a page\n\nteaser"),
        ("<article class='related post'><p>an article of any name</p></article>", "an article of any name"),
        ('<h2 title="a hidden gem">Gem</h2><section data-x="the hidden cost"><p>b</p></section>', "Gem\n\nb"),
        ("<h2 title='x' hidden>no</h2><p hidden=''>no<p HIDDEN>no<p data-hidden>b", "b"),
        ('<article><section aria-label="Legal history"><p>of the notice</p></section></article>', "of the notice"),
    ],
)
def test_names_alone_take_no_text(spark, html, want):
    assert run(spark, [(1, "http://one.example/", html)])[1, "http://one.example/"].text == want


def tree(rng, size):
    node = h.Node("div", label=rng.choice("ab"))
    for _ in range(rng.randrange(4) if size > 0 else 0):
        node.children.append(tree(rng, size - 1))
    node.shape = hash((node.tag, node.label, *(c.shape for c in node.children)))
    node.size = 1 + sum(c.size for c in node.children)
    return node


def largest(a, b):
    """Nodes of the largest common ordered top-down tree, by its definition."""
    if a.label != b.label:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), largest(x[0], y[0]) and largest(x[0], y[0]) + best(x[1:], y[1:]))

    return 1 + best(a.children, b.children)


def test_tree_matching_against_the_definition():
    rng = random.Random(5)
    for _ in range(400):
        a, b = tree(rng, 3), tree(rng, 3)
        matched = h.match_trees(a, b, 40_000)
        assert len(matched) == largest(a, b)
        nodes = {id(n): n for n in h.nodes_in_order(a)}
        assert all(nodes[k].label == n.label for k, n in matched.items())
        assert len(h.match_trees(a, b, 0)) <= len(matched)


def test_deep_and_wide_pages():
    page = "<article>" + "<div>" * 450 + "<p>deep</p>" + "</div>" * 450 + "<p>later para</p></article>"
    assert h.content_blocks(h.parse(page), set()) == ["deep", "later para"]
    deep = h.parse("<div>" * 50_000 + "x"), h.parse("<div>" * 49_999 + "<p>y")
    assert len(h.match_trees(*deep, 40_000)) == 50_000
    wide = h.parse("<p>a</p>" * 210), h.parse("<h2>b</h2>" + "<p>a</p>" * 211)
    assert len(h.match_trees(*wide, 100)) == 211
    cells = [f"<p class=c{i}>{i}</p>" for i in range(3000)]
    other = ["<h1>t</h1>", *cells[:1000], "<h2>u</h2>", *cells[1500:], "<h3>v</h3>"]
    found = h.match_trees(h.parse("<i>s</i>" + "".join(cells)), h.parse("".join(other)), 40_000)
    assert len(found) == 1 + 2500


def test_template_inside_of_articles(spark):
    page = "<article><h1>Story {0}</h1><p>Subscribe for more</p><p>what happened {0} times in one town and not in another</p><div>Written by our desk</div></article>"
    rows = [(i, f"http://one.example/{i}", page.format(i)) for i in range(12)]
    copy = "<article><h1>One</h1><p>the same story</p></article>"
    rows += [(100 + i, f"http://two.example/{i}", copy) for i in range(12)]
    rows += [(-1, "http://one.example/e", None), (-2, "http://one.example/f", "<p>error")]
    got = run(spark, rows)
    assert got[4, "http://one.example/4"].text == "Story 4\n\nwhat happened 4 times in one town and not in another"
    assert got[104, "http://two.example/4"].text == "One\n\nthe same story"
    assert got[-2, "http://one.example/f"].text == "error"
