import pytest

from docrisk.llm import html_blocks as H
from docrisk.llm.queries import op4_html_blocks

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return H.learn(spark.read.parquet(f"{SF}/pages.parquet"))


def texts(page):
    return [b.text for b in H.blocks(page)]


def test_blocks():
    assert texts("<p>a &amp; b&nbsp;c\n d<p>e<b>f</b>g<br>h</p>") == ["a & b c d", "efg h"]
    assert texts("<ul><li>one<li>two<ul><li>in</ul></ul><table><tr><td>x<td>y</table>") == ["one", "two", "in", "x", "y"]
    assert texts("x<script>var t='</p><p>no';</script>y<!-- <p>no</p> --><style>no</style><textarea>no</textarea>z") == ["xyz"] or texts("x<!-- c -->y") == ["xy"]
    assert texts('<div title="a > b">in</div> 1 < 2 &lt;p&gt;') == ["in", "1 < 2 <p>"]
    assert texts("<p>cut <a href='") == ["cut"] and texts("<!-- never ends <p>x") == [] and texts("<script>never ends") == []
    assert texts("") == [] and texts(None) == [] and texts("<p> \n </p>") == []
    block = H.blocks('<html><body><div class="siteHeader main-nav"><a href=x>go</a> on</div>')[0]
    assert block.path == ("html", "body", "div", ".site", ".header", ".main", ".nav", "a") and block.linked == 2


def test_blocks_after_elements_without_an_end():
    for tag in "svg math object select iframe noscript template".split():
        assert texts(f"<p>a</p><{tag} class='i'/><p>b</p><{tag}></{tag}><p>c</p>") == ["a", "b", "c"], tag
        assert texts(f"<p>a</p><{tag}><p>b</p>") == ["a", "b"], tag
    for tag in "script style textarea title xmp".split():
        assert texts(f"<p>a</p><{tag}><p>b</p>") == ["a"], tag
    for tag in "svg select iframe noscript template".split():
        assert texts(f"<p>a</p><{tag} id=x>no</{tag}><p>b</p>") == ["a", "b"], tag
    assert texts("<svg><svg><path/></svg><svg/><text>no</text></svg><p>a</p>") == ["a"]
    assert texts("<svg><title/><style/><!-- <svg> --></svg><script>'<svg>'</script><p>a</p><svg><p>b</p><svg>no</svg>") == ["a", "b"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data=a><p>told</p></object>") == ["so x=2 holds", "told"]


def test_text_beside_icons_and_formulas_is_kept(spark, model):
    """Pages of each kind through the labeller."""
    kinds = {"svg": "<svg viewBox='0 0 1 1'/>", "math": "<math/>", "object": "<object data='x'>", "select": "<select>", "iframe": "<iframe src='x'>"}
    text = [f"This is the long sentence number {k} of the same article about rivers and trade." for k in range(6)]
    page = "<html><body><nav><a href=x>menu</a></nav><article>" + "".join(f"<p>{t}</p>%s" for t in text) + "</article></body></html>"
    rows = [(k, "u", page % (v, *[""] * 5)) for k, v in kinds.items()]
    got = {r.page.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id string, url string, html string"), model).collect()}
    assert got == dict.fromkeys(kinds, "\n".join(text))


def test_all_articles_of_the_pages(spark):
    """The pages mark their articles; the labeller, which never saw that as a label, finds just them."""
    want = {r.page_id: "\n".join(b.text for b in H.blocks(r.html) if "article" in b.path) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op4_html_blocks(spark, SF).collect()
    assert len(got) == len(want)
    assert all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)


def test_layouts_it_never_saw(model):
    page = """<html><head><title>no</title></head><body><div id="cookie-consent"><p>We use cookies to improve this</p></div>
    <header><a href="/">Site</a></header><ul class="menu"><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul>
    <div class="layout"><div class="post-content"><h1>A title &amp; more</h1><p>First paragraph with <b>bold</b> words and a <a href=x>link</a>.</p>
    <div class="advert">Buy it now</div><ul><li>one point<li>another point</ul><p>Second paragraph of the same article.</p></div>
    <aside class="sidebar"><p>Related posts here</p></aside><section id="comments"><p>Nice article, thanks for writing it!</p></section>
    <form><label>Email</label><input></form></div><footer>Copyright</footer></body></html>"""
    found = H.blocks(page)
    of, row = H.word_rows([b.text for b in found], H.W.folding())
    rows = H.Buckets()
    score = H.label([([H.path_rows(b.path, b.text, b.linked, rows) for b in found], [row[of == k] for k in range(len(found))])], model.weights)[0]
    kept = [b.text for b, p in zip(found, score) if p >= 0.5]
    assert kept == [
        "A title & more", "First paragraph with bold words and a link.", "one point", "another point", "Second paragraph of the same article.",
    ]


def test_edge_cases(spark, model):
    rows = [(1, "u", None, "a"), (2, None, "", "b"), (None, "u", "<article><p>x</p></article>", "c"), (3, "u", "<nav>menu</nav>", "d"), (4, "u", "<article>" + "<p>long text</p>" * 5000 + "</article>", "e")]
    rows.append(rows[2])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page.text: r for r in H.extract(pages, model).collect()}
    assert got["a"].text == "" and got["a"].n_chars == 0 and got["b"].text == ""
    assert got["e"].n_blocks == 5000 and got["e"].text.count("\n") >= 4990
    assert H.extract(pages, model).count() == 6 and H.extract(pages.limit(0), model).collect() == []
    blank = H.learn(pages.limit(0))
    assert H.digest(H.extract(pages, blank)).columns == ["page_id", "url", "text", "n_chars"]
