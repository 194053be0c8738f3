from tastegrid.llm import html_extract as hx

SCHEMA = "page_id long, url string, html string, text string, host int, template string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "old", 1, "t") for i, u, h in rows], SCHEMA)


def texts(spark, rows):
    return {r.page_id: r.text for r in hx.extract(pages(spark, rows)).collect()}


def test_article_without_the_rest(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><header>Logo</header><nav><ul><li><a>Home</a></ul></nav>"
        "<!-- ad --><div class='ad'>Buy</div><div id='cookieNotice'>We use</div><aside>More</aside>"
        "<article><h1>Title &amp; more</h1><p>First <b>bold</b>line.<br>next<p>Second\n  line &lt;b&gt;<form>Send</form><div class='comments'><p>reader</div><ul><li>x<li>y</ul></article>"
        "<footer>&copy; site</footer></body>"
    )
    assert texts(spark, [(1, "http://h/1", page)]) == {1: "Title & more First boldline. next Second line <b> x y"}


def test_recurring_subtrees_go_where_no_name_tells(spark):
    rows = [
        (i, f"http://Site.example:80/{i}", f"<div class='q1'><div>Home</div><div>About</div></div><div class='q2'><p>Story {i} of the day.</p><p>Common words.</p></div><div class='q3'>Write to us</div>")
        for i in range(12)
    ]
    got = texts(spark, [*rows, (99, "http://other.example/", rows[0][2])])
    assert got[3] == "Story 3 of the day."
    assert got[99] == "Home About Story 0 of the day. Common words. Write to us"


def test_running_text_of_an_article_is_never_template(spark):
    rows = [(i, "http://a/", f"<article><h1>Same title</h1><p>Same words.</p><p>{i}</p><div>Follow us</div></article>") for i in range(10)]
    assert texts(spark, rows)[4] == "Same title Same words. 4"


def test_odd_pages(spark):
    long = "<article>" + "<div>" * 3000 + "deep" + "<p>word " * 20_000
    rows = [(1, None, None), (2, "", ""), (3, "no url", "<p>a"), (None, "http://x/", "plain"), (3, "no url", "<p>a"), (4, None, long), (5, None, "<a href='x>broken"), (6, None, "a < b &am &#169; &nbsp;c<script>x")]
    got = hx.extract(pages(spark, rows))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    assert (by[1].text, by[2].text, by[3].text, by[None].text) == ("", "", "a", "plain")
    assert by[4].text == "deep" + " word" * 20_000 and by[4].n_chars == len(by[4].text)
    assert by[6].text == "a < b &am © c"
    assert hx.extract(pages(spark, [])).count() == 0


def test_hashes_tell_subtrees_apart():
    keys = lambda h: set(hx.block_keys(h))
    assert keys("<div><p>a</p></div>") & keys("<section><p>a</p></section>") and not keys("<div>a</div>") & keys("<div>b</div>")


def test_attributes_by_their_whole_names_and_empty_raw_elements():
    def text(body):
        return hx.main_text(f"<html><body>{body}</body></html>", set())

    assert text("<article><p>see <a href='/hidden-gems'>the gems</a></p><p data-hidden='false'>two</p><p title='class=\"menu\"'>three</p></article>") == "see the gems two three"
    assert text("<article><p>one</p><svg/><p>two</p><script/><p>three</p></article>") == "one two three"
    assert text("<article><p>one</p><svg><path/></svg><script>x</script><p hidden>no</p><p>two</p></article>") == "one two"
    assert text("<div class='layout has-sidebar'><article class='post no-comments'><p>one</p></article></div><div class='sidebar'><p>no</p></div>") == "one"


def test_reader_comments_in_articles_and_main_beside_articles():
    def text(body, template=()):
        return hx.main_text(f"<html><body>{body}</body></html>", set(template))

    story = "<article class='post comments-open'><p>story</p></article>"
    assert text(story + "<ol class='commentlist'><li><article class='comment-body'><p>reader</p></article></li></ol>") == "story"
    assert text(story + "<section><article class='comment depth-2'><p>reader</p></article></section>") == "story"
    assert text("<article><p>story</p><article id='comment-7'><p>reader</p></article></article>") == "story"
    assert text("<main><p>intro</p><article>card</article><aside>no</aside></main><div>no</div>") == "intro card"
    assert text("<main><div class='x'>More stories</div><article><p>story</p></article></main>") == "story"
    assert text("<main><p> </p><article><p>story</p></article></main>") == "story"
    assert text("<div role='main'><p>one</p><div>two</div></div><div>no</div>") == "one two"
    assert text("<article hidden><p>no</p></article><main><p>yes</p></main>") == "yes"


def test_recurring_text_beside_an_article_is_template(spark):
    rows = [(i, "http://a/", f"<main><p>Read more of us.</p><article><p>Same words.</p><p>{i}</p></article></main>") for i in range(6)]
    rows += [(10 + i, "http://a/", f"<main><p>Read more of us.</p><p>Own {i}.</p><article><p>Same words.</p></article></main>") for i in range(6)]
    got = texts(spark, rows)
    assert got[3] == "Same words. 3" and got[13] == "Own 3. Same words."


def test_references_are_read_within_a_run_of_text():
    def text(body):
        return hx.main_text(f"<article>{body}</article>", set())

    assert text("a<b>&</b>lt;b &l<!-- -->t; &amp;lt; &#xe9;t&eacute;") == "a&lt;b &lt; &lt; \u00e9t\u00e9"
    assert text("one&nbsp;two&#32;<br>three") == "one two three"


def test_templates_against_plain_counts(spark):
    """The hashes counted by Spark are those of blocks that recur, counted here page by page."""
    rows = [(n, f"http://h{n % 3}/", f"<div><p>Menu {n % 3}</p></div><section><p>Text {n}</p><div>Part {n % 4}</div></section>") for n in range(30)]
    seen = {}
    for n, url, page in rows:
        for key in hx.block_keys(page):
            seen.setdefault((f"h{n % 3}", key), set()).add(n)
    want = {h: set() for h in ("h0", "h1", "h2")}
    for (h, key), pages_with in seen.items():
        if len(pages_with) >= 4 and len(pages_with) >= 0.3 * 10:
            want[h].add(key)
    got = {r.host: set(r.template) for r in hx.templates(pages(spark, rows), 0.3, 4).collect()}
    assert got == want and all(want.values())
