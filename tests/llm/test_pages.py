import html
import re

from pyspark.sql import functions as F

from mailshift.llm import pages, queries

ARTICLE = re.compile(r"<article>(.*?)(?:</article>|<footer|$)", re.S)


def brute(page):
    """The article of a page of the test tables, which hold nothing odd within it."""
    m = ARTICLE.search(page or "")
    inside = re.sub(r"<!--.*?-->|<script.*?</script>", "", m[1], flags=re.S) if m else ""
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inside)).split())


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op9_pages(spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r.text == brute(source[r.page_id]) and r.n_chars == len(r.text)


def test_parts_that_are_not_the_article():
    page = """<!doctype html><body class='has-sidebar'><div id=wrap><nav>x</nav><article class=post><header><h1>Title</h1></header><p>a<p>b &lt;c&gt; d<b>e</b>f
    <ul><li>1<li>2</ul><div class='cookie-notice'>n</div><div class='comments'>bad</div><aside>no</aside><form>f <textarea>t</textarea></form><footer>z</footer></article></div>
    <div class=ad>x</div><section id=comments><article class=comment>c</article></section><script>var a='</article><p>no'</script><style>p{}</style><div role=alert>w</div>"""
    assert pages.main_text(page) == "Title a b <c> def 1 2"
    assert pages.main_text("<div class='page-with-sidebar'><main><p>in</main><div class=sidebar>out</div></div>") == "in"


def test_odd_markup():
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<p> \n") == ""
    assert pages.main_text("<p>only &amp; <i>one</i>\n two<!-- x --><table><tr><td>a<td>b<tr><td>c</table>") == "only & one two a b c"
    assert pages.main_text("a < b <br> c") == "a < b c"
    assert pages.main_text("<div title='a>b' x=\"<p>\">x&nbsp;y&#233;</div>") == "x yé"
    assert pages.main_text("before<script>never closed <p>lost") == "before"
    assert pages.main_text("<p>" * 3000 + "deep" + "<div>" * 3000 + "er") == "deep er"
    assert pages.main_text("x" * 200_000 + "<" * 2000) == "x" * 200_000 + "<" * 2000


def made(spark, n, body):
    rows = [(k, f"http://one.example/{k}", f"<html><body><div class=x{k}><span>same words here</span> always</div>{body(k)}<div class=last>the end {k % 2}</div></body></html>", 1)
            for k in range(n)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, low int")


def test_repeated_branches_of_a_host_are_removed(spark):
    table = made(spark, 60, lambda k: f"<div class=body><h2>Head {k}</h2><p>story number {k} of many</p></div>")
    for r in pages.with_main_text(table.drop("low")).collect():
        assert r.text == f"Head {r.page_id} story number {r.page_id} of many"
    salted = pages.with_main_text(table.drop("low"), small=0).collect()
    assert all(r.text == f"Head {r.page_id} story number {r.page_id} of many" for r in salted)


def hosted(spark, bodies):
    table = spark.createDataFrame([(k, f"http://hot.example/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)], "page_id bigint, url string, html string")
    return {r.page_id: r.text for r in pages.with_main_text(table).collect()}


def test_a_third_of_near_copies_on_a_hot_host(spark):
    def title(k):
        return "The one title" if k % 3 == 0 else f"Title {k}"

    for tag in ("article", "div class=story"):
        got = hosted(spark, [f"<div class=top>Site of stories</div><{tag}><h1>{title(k)}</h1><p>body {k} of many</p></{tag.split()[0]}>" for k in range(330)])
        assert got == {k: f"{title(k)} body {k} of many" for k in range(330)}
    # Where most pages say the same, what the others say stays.
    got = hosted(spark, [f"<div class=lead>{'Our usual line' if k % 4 else f'Lead {k}'}</div><p>body {k} of many</p>" for k in range(80)])
    assert got == {k: f"{'' if k % 4 else f'Lead {k} '}body {k} of many" for k in range(80)}


def test_recurring_subheadings_stay(spark):
    for tag in ("article", "div class=story"):
        got = hosted(spark, [f"<div class=top><h2>Menu</h2><p>Site of stories</p></div><{tag}><h1>Title {k}</h1><h2>Background</h2><p>the body {k} of many</p><h3>In short {k % 3}</h3><p>end {k}</p></{tag.split()[0]}>" for k in range(60)])
        assert got == {k: f"Title {k} Background the body {k} of many In short {k % 3} end {k}" for k in range(60)}


def test_short_articles_beside_a_long_unmarked_block(spark):
    legal = "all rights in these pages are held by their owners " * 20
    for body in ("<div class=story><p>short story {k}</p></div><div>{legal}</div>", "<div>short story {k}</div><div>{legal}</div>",
                 "<div class=story>short story {k}</div><div><p>{legal}</p><p>{legal} too</p></div>"):
        assert hosted(spark, [body.format(k=k, legal=legal) for k in range(100)]) == {k: f"short story {k}" for k in range(100)}


def test_few_pages_and_copies_have_no_say(spark):
    few = pages.with_main_text(made(spark, 5, lambda k: f"<p>story {k}</p>").drop("low")).collect()
    assert all("same words here" in r.text for r in few)
    copies = pages.with_main_text(made(spark, 60, lambda k: "<article><p>one and the same story, copied everywhere</p></article>").drop("low")).collect()
    assert {r.text for r in copies} == {"one and the same story, copied everywhere"}


def test_hard_rows(spark):
    rows = [(1, None, "<p>a", 1), (2, "odd", None, 1), (None, "http://h/x", "", None), (4, "http://h/x", "<p>b", 1), (4, "http://h/x", "<p>b", 1)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int")
    out = pages.with_main_text(table)
    assert out.columns == [*table.columns, "text"]
    assert sorted((str(r.page_id), r.text) for r in out.collect()) == [("1", "a"), ("2", ""), ("4", "b"), ("4", "b"), ("None", "")]
    assert pages.with_main_text(spark.createDataFrame([], table.schema)).count() == 0


def test_host(spark):
    urls = ["HTTP://A.Example.com/x", "https://b.example?q", "nothing", None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(pages.host_of(F.col("url"))).collect()
    assert [r[0] for r in got] == ["a.example.com", "b.example", "", ""]


def test_a_name_is_not_enough():
    m = pages.main_text
    assert m("<article><p>a long opening of the piece</p><section class='reply-to-critics'>what he says to them</section></article>") == "a long opening of the piece what he says to them"
    assert m("<div class='header-note'>Note</div><p>text of the page</p>") == "Note text of the page"
    assert m("<main><p>some text is here</p><div class='share-prices'>rose by 2</div></main>") == "some text is here rose by 2"
    assert m("<div id='login-guide'><h1>How to log in</h1><p>First do this</p></div>") == "How to log in First do this"
    assert m("<div id=login>all there is</div>") == "all there is"
    # With other evidence it goes: a minor part, or beside the article of a page whose host has no say.
    assert m("<p>text of the page, quite long</p><div class='cookie-notice'>we use some</div>") == "text of the page, quite long"
    assert m("<article>short</article><div class='ad banner'>an advert that is longer than the article by far</div>") == "short"


def test_a_teaser_is_not_the_article():
    assert pages.main_text("<article>Teaser</article><div><p>The main text is much longer than that.</p></div>") == "Teaser The main text is much longer than that."
    assert pages.main_text("<article>The article is the longer one</article><div>beside it</div>") == "The article is the longer one"


def test_the_tree_decides_within_articles_and_over_names(spark):
    def page(k):
        return (f"<article><h1>Title {k}</h1><p>story {k} of many</p><div class=tail>always the same end of it</div><div class='post-comments'><p>reader {k} says so</p></div></article>")

    got = hosted(spark, [page(k) for k in range(60)])
    assert got == {k: f"Title {k} story {k} of many" for k in range(60)}
    # Alone, a page gives no such evidence.
    assert pages.main_text(page(1)) == "Title 1 story 1 of many always the same end of it reader 1 says so"


def test_rows_of_the_given_table_that_the_tree_decides(spark):
    """Adverts that outweigh their article: their name alone does not remove them where the host has a say, the fixture does."""
    sf = "/root/testdata/sf0.1"
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op9_pages(spark, sf).collect()
    assert all(r.text == brute(source[r.page_id]) for r in rows)
    assert sum(r.text != pages.main_text(source[r.page_id], say=True) for r in rows) == 3


def test_clashing_columns_on_either_path(spark):
    rows = [(k, f"http://one.example/{k}", f"<p>text {k}", "s", "k", "t", "h") for k in range(12)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, salt string, known string, text string, host string")
    for small in (0, 10**6):
        out = pages.with_main_text(table, small=small)
        assert out.columns == ["page_id", "url", "html", "salt", "known", "host", "text"]
        assert {(r.salt, r.known, r.host, r.text) for r in out.collect()} == {("s", "k", "h", f"text {k}") for k in range(12)}
