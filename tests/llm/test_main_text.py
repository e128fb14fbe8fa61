import pytest

from trajframe.llm import main_text as mt

SCHEMA = "page_id long, url string, html string, host string, template string, text string"


def extract(spark, rows):
    frame = spark.createDataFrame([(*r, "h", "t", "x") for r in rows], SCHEMA)
    return {r.page_id: r for r in mt.main_text(frame).collect()}


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("   ", ""), ("just text", "just text"), ("<p>a &lt; b &amp;amp; c&nbsp;d", "a < b &amp; c d"),
    ("<article><h1>T</h1><p><b>one<br>two<p>three</article><footer>f</footer>", "T\n\none two\n\nthree"),
    ("<header><h1>Site</h1></header><nav><ul><li>A<li>B</ul></nav><main><p>x</p><aside>s</aside><form><p>f</form></main>", "x"),
    ("<div class='cookie-notice'>c</div><article class=post><header><h2>H</h2></header><p>p<div class=ad>buy</div><section id=comments><p>no</section></article>", "H\n\np"),
    ("<article><p>a<script>var x='</p><p>';</script>b</p><!-- c --><style>p{}</style><button>go</button></article>", "ab"),
    ("<article><p>open <span class='ad'>buy</span> end", "open end"),
    ("<body class='has-sidebar'><div id='page-with-sidebar'><article><p>kept</p></article></div></body>", "kept"),
    ("<div class=\"x>oops <p>para</p>", "oops\n\npara"),
])
def test_pages(spark, html, text):
    assert "\n\n".join(mt.Page(html).main(frozenset())) == text


def test_template_of_a_host_goes_and_articles_stay(spark):
    body = "<div>Welcome to our site</div><div>Call us today</div><div>All rights reserved</div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{body}<div><p>Own text number {i} of this page.</p><p>More of {i}.</p></div></body>") for i in range(8)]
    rows += [(20 + i, f"http://b.example/{i}", "<body><nav>m</nav><article><p>The same article.</p><p>On every page.</p><p>End.</p></article></body>") for i in range(6)]
    rows += [(40, None, "<article><p>no url</p></article>"), (41, "nonsense", None), (40, None, "<article><p>no url</p></article>"),
             (None, "http://c.example/", "<article><p>" + "long " * 50000 + "</p></article>")]
    got = extract(spark, rows)
    for i in range(8):
        assert got[i].text == f"Own text number {i} of this page.\n\nMore of {i}."
    assert all(got[20 + i].text == "The same article.\n\nOn every page.\n\nEnd." for i in range(6))
    assert got[40].text == "no url" and got[41].text == "" and got[None].n_chars == len("long " * 50000) - 1
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_empty_table(spark):
    assert mt.main_text(spark.createDataFrame([], SCHEMA)).collect() == []


def test_template_decides_inside_articles(spark):
    again = "<p>Follow us every day.</p><p>Send us your story.</p><p>Printed in our own house.</p>"
    rows = [(i, f"http://d.example/{i}", f"<article><h1>Title {i}</h1><h2>Summary</h2><p>{f'The report number {i} tells of something new. ' * 4}</p>{again}</article>") for i in range(8)]
    near = "".join(f"<p>Paragraph {j} of a story that was sent to many papers.</p>" for j in range(6))
    rows += [(20 + i, f"http://n.example/{i}", f"<article><p>Edition {i}</p>{near}</article>") for i in range(6)]
    same = "<div><p>One text.</p><p>Without an article.</p><p>On six pages.</p></div>"
    rows += [(40 + i, f"http://s.example/{i}", f"<body>{same}</body>") for i in range(6)]
    got = extract(spark, rows)
    for i in range(8):
        assert got[i].text == f"Title {i}\n\nSummary\n\n" + f"The report number {i} tells of something new. " * 3 + f"The report number {i} tells of something new."
    assert all(got[20 + i].text.count("\n\n") == 6 for i in range(6))
    assert all(got[40 + i].text == "One text.\n\nWithout an article.\n\nOn six pages." for i in range(6))


def test_without_article_all_slots_stay():
    long, short = "The longer part of the text. " * 20, "The shorter part of the text. " * 10
    page = mt.Page(f"<div><h1>Title</h1><p>lead</p><div class=text><p>{long}</p></div></div>")
    assert page.main(frozenset()) == ["Title", "lead", long.strip()]
    page = mt.Page(f"<div><p>{short}</p></div><div><p>{long}</p><p>See <a href=x>a long list of many sources</a></p></div>")
    assert page.main(frozenset()) == [short.strip(), long.strip(), "See a long list of many sources"]


def test_template_of_each_type_of_page(spark):
    rows = []
    for i in range(30):                                  # three types, each on a third of the host
        kind = ["news", "shop", "forum"][i % 3]
        rest = f"<div><span>{kind} hours</span></div><div>{kind} rules</div><div>{kind} offers</div>"
        rows.append((i, f"http://t.example/{i}", f"<body><div class={kind}>{rest}<p>Own text {i}.</p></div><div>{kind} office</div><p>More {i}.</p></body>"))
    got = extract(spark, rows)
    assert [got[i].text for i in range(30)] == [f"Own text {i}.\n\nMore {i}." for i in range(30)]


LONG = "Much is told here about the matter at hand. " * 10


@pytest.mark.parametrize("inner, gone", [
    ("<div class='entry-header'><h1>Title</h1></div>", False), ("<div class='header'><h1>Title</h1></div>", False), ("<section id='search'><p>" + LONG + "</p></section>", False),
    ("<section id='social-history'><h2>History</h2><p>short</p></section>", False), ("<p class='notice-text'>Take note.</p>", False),
    ("<div id='ad-2024-report'><p>The report.</p></div>", False), ("<p data-id='ad' data-class='menu'>kept</p>", False), ("<p itemprop='comment'>kept</p>", False),
    ("<p>a <span class='notice-text'>word</span> b</p>", False), ("<div class='related'><h2>Related work</h2><p>" + LONG + "</p></div>", False),
    ("<div class='share'>Tell others</div>", True), ("<div class='share-buttons'><a href=a>Post it</a> <a href=b>Mail it</a></div>", True),
    ("<div id='comments' class='comments-area'><h3>Two comments</h3><p>" + LONG + "</p></div>", True), ("<section id='cookies'><h2>Baking</h2><p>" + LONG + "</p></section>", False),
    ("<div class='comments'><h3>Two comments</h3><p>" + LONG + "</p></div>", True), ("<div class='ad'>" + LONG + "</div>", True),
])
@pytest.mark.parametrize("root", ["article", "main"])
def test_names_inside_content(root, inner, gone):
    text = mt.Page(f"<{root}><p>first</p>{inner}<p>last</p></{root}>").main(frozenset())
    assert (text == ["first", "last"]) if gone else (len(text) > 2 and text[0] == "first" and text[-1] == "last")
    if "<h" in inner and not gone:
        assert text[1] in ("Title", "History", "Related work", "Baking")
