"""Wrapper induction on small sites with known articles."""

import random

import pytest
from conftest import DATA

from sliceweave.llm import html_extract as h
from sliceweave.llm import queries


def site(pages, host="site.example", seed=0):
    """Pages without helpful markup: only the comparison of pages tells template from content."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    out = []
    for i in range(pages):
        paragraphs = [" ".join(word() for _ in range(12)) for _ in range(rnd.randrange(1, 6))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        out.append((i, f"https://{host}/page/{i}", f"<body><div><b>Site title</b><p>Welcome to our site</p></div><div>{body}</div><div><p>All rights kept</p></div></body>", "\n".join(paragraphs)))
    return out


PLAIN = [
    ("<p>One &amp; two&nbsp;\n three<p>Four <b>bold <i>both</i></b> end", "One & two three\nFour bold both end"),
    ("<nav><p>x</p></nav><article><h1>T</h1><p>a<br>b</p><script>var t='</p>';</script><div class='comments'><p>no</p></div></article><footer>f</footer>", "T\na b"),
    ("<div>before<ul><li>1<li>2</ul>after</div>", "before\n1\n2\nafter"),
    ("<p>a<!-- <p>no</p> -->b</p><style>p{}</style>", "ab"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("text &lt;b&gt; &#233; &#x1F642; &unknown; &am", "text <b> é 🙂 &unknown; &am"),
    ("<article><p>x</b></div>y</p></article>", "xy"),
    ("<p hidden>no</p><p style='display: none'>no</p><aside>no</aside><form>no</form><p title='a>b'>yes", "yes"),
    ("<main><header><h1>Title</h1></header><p>Body</p></main><header><p>Site</p></header>", "Title\nBody"),
    ("<", "<"), ("<p", ""), ("a < b > c", "a < b > c"), ("<!-- open", ""), ("<script>open", ""), ("<p></p>", ""),
]


@pytest.mark.parametrize("page, text", PLAIN)
def test_reading_one_page(page, text):
    assert h.read(page) == text


def test_template_is_learnt_from_the_host(spark):
    pages = site(50)
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    assert got == {p[0]: p[3] for p in pages}
    alone = h.extract(df.where("page_id = 3")).first()
    assert "Welcome" in alone.text  # one page tells nothing about its template


def test_copies_do_not_become_template(spark):
    page = site(1)[0]
    df = spark.createDataFrame([(i, f"https://site.example/{i}", page[2]) for i in range(40)], "page_id long, url string, html string")
    assert all(page[3] in r.text for r in h.extract(df).collect())


def test_varying_paragraphs_of_an_article_stay(spark):
    """Near copies with their own headings and menus, and paragraphs that some pages share, do not empty the others."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    line = lambda: " ".join(word() for _ in range(12))
    common, shared, rows, wanted = "Read more stories on this site", [line() for _ in range(3)], [], {}
    for i in range(40):
        title, own = f"Heading {word()}", [line()] if i % 4 == 0 else []
        paragraphs = own + [line() for _ in range(3)] if i % 4 == 0 else shared
        menu = "".join(f"<li><a href=x>{word()}</a>" for _ in range(8))
        links = "".join(f"<li><a href=x>{word()}</a>" for _ in range(3))
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        html = f"<div><ul>{menu}</ul></div><article><h1>{title}</h1>{body}<ul>{links}</ul><p>{common}</p></article>"
        rows.append((i, f"https://near.example/{i}", html))
        wanted[i] = [title, *paragraphs]
    got = {r.page_id: r.text.split("\n") for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, texts in wanted.items():
        assert got[i][:len(texts)] == texts and len(got[i]) >= len(texts) + 3  # the list of links stands inside the article


def test_constant_text_goes_and_its_neighbours_stay(spark):
    rows = [(i, f"https://same.example/{i}", f"<article><h1>Title {i}</h1><p>Share this story</p><p>Own words of number {i}</p><p>Print it</p><p>Save it</p></article>") for i in range(30)]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nOwn words of number {i}" for i in range(30)}


def test_matching_keeps_labels_and_order():
    tree = lambda *paths: h._tree([{"path": p, "texts": [1], "chars": 1, "links": 0} for p in paths])
    size, pairs = h.match(tree(">a>p", ">b>p", ">c>p"), tree(">b>p", ">a>p", ">c>p"))
    assert size == 1 + 2 + 2 and {p.label for p, _ in pairs} >= {"c", "p"}
    assert h.match(tree(">a"), tree(">b"))[0] == 1


def test_edge_cases(spark):
    rows = [(1, None, "<p>a"), (1, "no url", "<p>b"), (None, "http://x.y/", None), (2, "http://x.y/", ""), (3, "http://x.y/", "<p>" + "w " * 200_000), (3, "http://x.y/", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = h.extract(df).collect()
    assert len(got) == len(rows) and sorted(len(r.text) for r in got) == [0, 0, 1, 1, 4, 399_999]
    assert all(r.n_chars == len(r.text) for r in got)
    assert h.extract(df.where("false")).count() == 0


def test_query_reads_the_article(spark):
    got = {r.page_id: r for r in queries.QUERIES["op5_wrapper_extraction"](spark, DATA).collect()}
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inside = page.html.split("<article>")[1].split("</article>")[0]
        blocks = [b for b in (h.read(part) for part in inside.replace("</p>", "<p>").replace("</h1>", "<p>").split("<p>")) if b]
        assert got[page.page_id].text == "\n".join(blocks)


def test_deep_pages_of_one_host(spark):
    """Nesting has no limit: pages of one host are aligned however deep they are."""
    deep = [(i, "http://deep.example/", "<div>" * 5000 + f"<p>own text {i}" + "</div>" * 5000) for i in range(4)]
    got = h.extract(spark.createDataFrame(deep, "page_id long, url string, html string")).select("page_id", "text").collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"own text {i}") for i in range(4)]


def longest(x, y):
    """Matched nodes of two trees by trying every choice (brute force)."""
    if x.label != y.label:
        return 0

    def best(left, right):
        if not left or not right:
            return 0
        return max(best(left[1:], right), best(left, right[1:]), longest(left[0], right[0]) + best(left[1:], right[1:]))

    return 1 + best(list(x.children.values()), list(y.children.values()))


def test_tree_matching():
    rnd = random.Random(4)
    for _ in range(200):
        trees = [h._tree([{"path": ">" + ">".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 4)))} for _ in range(rnd.randrange(6))]) for _ in range(2)]
        found, pairs = h.match(*trees)
        assert found == len(pairs) == longest(*trees) and all(x.label == y.label for x, y in pairs)
