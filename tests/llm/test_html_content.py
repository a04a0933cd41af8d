import html
import re

import pytest

from tessera.llm import html_content as h
from tessera.llm.queries import op9_html_content

PAGE = "<html><head><title>T {i}</title><style>p{{}}</style></head><body><nav><ul><li>Home<li>About</ul></nav><div id='cookie-notice'>We use cookies</div>{main}<footer>&copy; x</footer></body></html>"


def pages(spark, rows, url="http://a.example/{}"):
    return spark.createDataFrame([(i, url.format(i), x) for i, x in enumerate(rows)], "page_id long, url string, html string")


def texts(df):
    return {r["page_id"]: r["text"] for r in h.main_text(df).collect()}


def parsed(source):
    blocks = h.parse(source)[1]
    best = max((b.container for b in blocks), default=0)
    return "\n\n".join(b.text for b in blocks if b.container == best)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b<br>c", "a\n\nb c"), ("<article><h1>A &amp; B</h1><p>x &lt; y&nbsp; z</p></article><p>no", "A & B\n\nx < y z"),
        ("<article>a<script>var t='</p>';</script>b<!-- c --><style>d</style><b>e</b></article>", "abe"),
        ("<article><p>yes<aside>no</aside><form><p>no</form><div class='ad-box'>no</div><div class=shadow>yes</div><div class='comments'><article>no</article></div></article>", "yes\n\nyes"),
        ("<main class='has-sidebar'><p>yes</p><div role=navigation>no</div></main><div>no</div>", "yes"), ("<article><p>open <i>italics<p>next", "open italics\n\nnext"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table></article>", "1\n\n2\n\na\n\nb\n\nc"), ("</div></p><article>x</article></article>y", "x"), ("<article>a < b > c <3</article>", "a < b > c <3"),
        ("<article><p title=\"a>b\">x</p><p hidden>no</p><script>never closed <p>no", "x"), ("<p>\n  a \t b  </p>", "a b"), ("<article>unfinished &am", "unfinished &am"), ("<article><select><option>no</select>x<p/>y</article>", "x\n\ny"),
    ],
)
def test_one_page(spark, source, want):
    assert parsed(source or "") == want
    assert texts(pages(spark, [source])) == {0: want}


def test_template_without_an_article(spark):
    rows = [PAGE.format(i=i, main=f"<div><p>Share this page</p><p>Story {i} has its own words</p><p>{i * i} more</p></div>") for i in range(12)]
    assert texts(pages(spark, rows)) == {i: f"Story {i} has its own words\n\n{i * i} more" for i in range(12)}


def test_passages_that_articles_share_stay(spark):
    rows = [PAGE.format(i=i, main=f"<article><p>Story {i}</p>{'<p>A common passage</p>' if i % 2 else ''}</article>") for i in range(12)]
    assert texts(pages(spark, rows)) == {i: f"Story {i}" + ("\n\nA common passage" if i % 2 else "") for i in range(12)}


def test_copies_of_a_page_are_not_a_template(spark):
    rows = [PAGE.format(i=0, main="<div><p>the same story</p></div>")] * 20
    assert set(texts(pages(spark, rows)).values()) == {"the same story"}


def test_hosts_are_apart_and_odd_urls(spark):
    rows = [(1, None, "<p>a"), (2, "not a url", "<p>b"), (3, "HTTP://X.Example:80/p", "<p>c"), (3, "http://x.example/q", "<p>c"), (None, "http://x.example/q", "<p>d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    from pyspark.sql import functions as F

    df = df.withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash")).withColumn("blocks", F.lit("clash"))
    assert [r["text"] for r in h.main_text(df).orderBy("text").collect()] == ["a", "b", "c", "c", "d"]
    assert {r[0] for r in df.select(h.host_of(F.col("url"))).collect()} == {"", "x.example"}
    assert h.main_text(df.where("page_id > 9")).count() == 0


def test_very_long_page(spark):
    body = "".join(f"<p>paragraph {i}</p>" for i in range(30_000))
    assert texts(pages(spark, [f"<article>{body}</article>"]))[0].count("\n\n") == 29_999


def test_deep_nesting_and_stray_tags():
    deep = "<div><section>" * 20_000 + "x" + "</div></section></b>" * 20_000
    tree, blocks = h.parse(deep)
    assert [b.text for b in blocks] == ["x"]
    assert h.simple_tree_matching(tree.shape(), tree.shape())[-1] == (h.DEPTH, h.DEPTH)


def test_matching_keeps_order_and_is_largest():
    a = ["r", ["x", ["p"]], ["y"], ["z"]]
    b = ["r", ["y"], ["x", ["p"]], ["z"]]
    assert h.simple_tree_matching(a, a) == [(i, i) for i in range(5)]
    assert h.simple_tree_matching(a, b) == [(0, 0), (1, 2), (2, 3), (4, 4)]
    assert h.simple_tree_matching(["r"], ["s"]) == []


def test_query_against_a_plain_reading(spark, small):
    def plain(source):
        body = re.sub("</?b>", "", re.search("(?s)<article>(.*?)(?:</article>|<footer>|$)", source)[1])
        blocks = [" ".join(html.unescape(x.replace("<br>", " ")).split()) for x in re.split("</?(?:p|h1)>", body)]
        return "\n\n".join(x for x in blocks if x)

    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = op9_html_content(spark, small).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: plain(x) for i, x in rows.items()} and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article class='post has-sidebar'><p>yes</p></article><p>no", "yes"), ("<article id='social-housing'><p>yes</p></article>", "yes"), ("<div id=page class='no-comments'><article>yes</article></div><div>no</div>", "yes"),
        ("<div class=widget><div class=related><main><p>yes</p></main></div><p>no</p></div>", "yes"), ("<div id=social-page><article>yes<div class=share>no</div></article><div class=comments><article>no</article></div></div>", "yes"),
        ("<article>yes</article><section id=comments><article class=comment>no</article></section>", "yes"), ("<div class='content has-sidebar'><p>yes</p></div><div class=sidebar>no</div>", "yes"), ("<div class=search><p>all there is</p></div>", "all there is"),
        ("<div class=widget role=\"main\"><p>yes</p></div><p>no</p>", "yes"), ("<nav><div class=menu><article>no</article></div></nav><p>yes</p>", "yes"),
    ],
)
def test_words_do_not_take_the_main_text(source, want):
    assert parsed(source) == want


def test_long_passages_that_few_pages_share_stay(spark):
    passage = "A paragraph that some of the pages share, and that is far too long to be an entry of a menu or a button."
    rows = [PAGE.format(i=i, main=f"<div><p>Share this page</p><p>Story {i}</p>{f'<p>{passage}</p>' if i % 2 else ''}</div>") for i in range(6)]
    assert texts(pages(spark, rows)) == {i: f"Story {i}" + (f"\n\n{passage}" if i % 2 else "") for i in range(6)}


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<article><p title="the hidden valley">text</p></article>', "text"), ('<article><div class="content has-sidebar"><p>text</p></div></article>', "text"), ('<article><section id="social-studies"><p>text</p></section></article>', "text"),
        ('<article><p class="notice-of-death">text</p></article>', "text"), ('<article><h1 class="article-header">A</h1><p>text</p></article>', "A\n\ntext"), ("<article><p>Press <button>OK</button> to go on.</p></article>", "Press to go on."),
        ("<article><p>a <button><div>OK</div></button> b</p></article>", "a b"), ("<article><header><h1>A</h1></header><p>b</p></article>", "A\n\nb"), ("<article><p data-x='class=ad'>a</p><p class='ad'>no</p></article>", "a"), ("<article><p>kept <svg><p>no", "kept"),
        ("<article><p>a</p><div class='comments-section-2'>no</div><ul class='site-footer'><li>no</ul></article>", "a"), ("<article><div class='advertising-history'><p>a</p></div></article>", "a"),
    ],
)
def test_names_and_inline_parts(spark, source, want):
    assert parsed(source) == want
    assert texts(pages(spark, [source])) == {0: want}


def test_the_alignment_decides_about_plain_menus_and_doubtful_names(spark):
    menu = "<div><span>Home</span></div><div><ul><li>News<li>Sport<li>About us</ul></div>"
    doubt = lambda t: f"<div class='social-studies'><p>{t}</p></div>"
    rows = [f"<body>{menu}<div><p>Story {i} has its own words</p>{doubt(f'An essay {i}')}<div class='share-this-story'><p>Tell {'your' if i % 2 else 'a'} friend</p></div></div></body>" for i in range(12)]
    want = {i: f"Story {i} has its own words\n\nAn essay {i}" for i in range(12)}
    assert texts(pages(spark, rows)) == want
    off = {r["page_id"]: r["text"] for r in h.main_text(pages(spark, rows), use_template=False).collect()}
    assert all("Sport" in off[i] and "friend" in off[i] for i in off)


def test_menus_of_links(spark):
    links = "".join(f"<li><a href=/{k}>entry {k}</a>" for k in range(4))
    assert texts(pages(spark, [f"<div><ul>{links}</ul></div><div><p>Read <a href=/x>this</a> story</p><p><a href=/y>One link</a></p></div>"])) == {0: "Read this story\n\nOne link"}
    assert texts(pages(spark, [f"<article><ul>{links}</ul></article>"]))[0].count("entry") == 4


def test_many_sibling_labels():
    from time import perf_counter

    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    source = lambda step: "<article>" + "".join(f"<div class=x{name(k)}>t{k}</div>" for k in range(0, 30_000, step)) + "</article>"
    began = perf_counter()
    (one, blocks), (two, _) = h.parse(source(3)), h.parse(source(2))
    pairs = h.simple_tree_matching(one.shape(), two.shape())
    assert len(blocks) == 10_000 and len(pairs) == 2 + 5_000 and perf_counter() - began < 10


def test_matching_is_the_largest_by_brute_force():
    import random

    def tree(r, depth=0):
        return [r.choice("abc") if depth else "r", *[[x, *tree(r, depth + 1)[1:]] for x in r.sample("abcde", r.randint(0, 4))]] if depth < 3 else ["r"]

    def size(a, b):
        if a[0] != b[0]:
            return 0
        m = [[0] * len(b) for _ in a]
        for i in range(1, len(a)):
            for j in range(1, len(b)):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + size(a[i], b[j]))
        return m[-1][-1] + 1

    for seed in range(200):
        r = random.Random(seed)
        a, b = tree(r), tree(r)
        assert len(h.simple_tree_matching(a, b)) == size(a, b)
