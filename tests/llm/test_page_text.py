import html
import random
import re

from shared import SF, prose, table_rows

from fansieve.llm import page_text as pt


def plain(page):
    """The given pages have one article with headings, paragraphs and line breaks."""
    m = re.search(r"<article>(.*?)(?:</article>|\Z)", page or "", re.DOTALL)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|li|br)\b[^>]*>", m[1] if m else "")]
    return "\n".join(b for b in blocks if b)


def test_the_query_agrees_with_a_plain_version(spark):
    pages = {p: (u, h) for p, u, h in table_rows(spark, "pages", "page_id, url, html")}
    found = pt.op6_page_text(spark, SF).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in found} == {p: (u, plain(h), len(plain(h))) for p, (u, h) in pages.items()}
    assert len(found) == len(pages)


SITE = (
    '<html><head><title>T &amp; t</title><style>p{{}}</style></head><body class="with-sidebar"><div class="top header"><a href="/">Home</a></div>'
    '<ul class="menu"><li><a>One</a><li><a>Two</a></ul><div class="cookie-notice">We use cookies.</div><div id="main-col" class="story">{main}'
    '<form><p>Your mail<input></form><div class="ad">Buy!</div><script>if (a < b) document.write("</p><p>no")</script></div>'
    '<div class="sidebar"><p>Side</div><section id="comments"><p>First!</p></section><div class="footer">&copy; us</div></body></html>'
)


def test_a_host_without_article_elements(spark):
    r = random.Random(1)
    texts = {k: [f"Paragraph {k} {i} of some length, {r.random()}" for i in range(r.randrange(1, 9))] for k in range(40)}
    rows = [(k, "https://news.example.org/x", SITE.format(main="".join(f"<p>{x}" for x in t))) for k, t in texts.items()]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert [r.hearts for r in pt.wrappers(df).collect()] == ['["div.col.main.story"]']
    assert {r.page_id: r.text for r in pt.main_texts(df).collect()} == {k: "\n".join(t) for k, t in texts.items()}


def test_blocks():
    page = """<body><nav>menu</nav><article class=post><header>by me</header><h1>A &lt;b&gt;&nbsp; title</h1><p>One <b>bo</b>ld&#33;
      <i>two</i><p>three<ul><li>four<li>five</ul><div class="share">tweet</div><aside>six</aside><!-- <p>no</p> --><pre>a  b
      c</pre><table><tr><td>x<td>y</table><div class="comments"><article>nice</article></div><p>last<textarea>no</textarea></article><p>after<footer>f"""
    assert pt.main_text(page, ["article.post"]) == "A <b> title\nOne bold! two\nthree\nfour\nfive\na b c\nx\ny\nlast"
    assert pt.main_text("just &amp; text <", []) == "just & text <"
    assert pt.main_text("<div><p title='a>b'>x</p><script>never closed", []) == "x"
    assert pt.main_text("", []) == "" and pt.main_text("</p></div>", []) == ""


def test_wrappers_are_aligned():
    a, b, c = (pt.items(f"<body><h2>{t}</h2>{'<p>x</p>' * n}{more}</body>") for t, n, more in (("A", 1, ""), ("B", 4, "<div>d</div>"), ("B", 2, "")))
    line = pt.align(pt.align(a, b), c)
    assert [pt._shape(x) for x in line] == ["body", ("h2", "#", "/h2"), ("p", "#", "/p"), ("div", "#", "/div"), "/body"]
    assert [x[pt.PAGES] for x in line] == [3, 3, 3, 1, 3]  # the last group is optional
    title, paragraph = line[1][0][1], line[2][0][1]
    assert title[pt.VARIES] and not paragraph[pt.VARIES] and paragraph[pt.CHARS] == 7
    # A sequence that occurs three times is a repeated group.
    cards = pt.items("<body>" + "<div><h3>t</h3><p>u</p></div>" * 3 + "</body>")
    assert [pt._shape(x) for x in cards] == ["body", ("div", ("h3", "#", "/h3"), ("p", "#", "/p"), "/div"), "/body"]
    assert pt.align([], a) == a and pt.align(a, []) == a
    many = [[f"x{k}", 1 + (k > 900), 0, 0, False, ""] for k in range(1000)]
    assert len(pt.align(many, [])) <= pt.MOST_ITEMS


def test_awkward_rows(spark):
    long = "<article>" + "<p>word &amp; word</p>" * 20_000
    rows = [(1, None, "<article><p>a</article>", 1), (2, "no url", None, 1), (3, "http://h", "", 1), (4, "http://h:80/x", long, 1), (4, "http://h:80/x", long, 1), (None, "http://u@h?x", "<main>m</main>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    found = sorted(((r.page_id or 0, r.text, r.n_chars) for r in pt.main_texts(df).collect()), key=str)
    whole = "\n".join(["word & word"] * 20_000)
    assert found == sorted([(1, "a", 1), (2, "", 0), (3, "", 0), (4, whole, len(whole)), (4, whole, len(whole)), (0, "m", 1)], key=str)
    assert pt.main_texts(df.limit(0)).collect() == []


def test_an_article_after_very_many_items_is_found():
    def page(k):
        r = random.Random(k)
        # Tables of other shapes on each page, then the article.
        listing = "".join(f'<{t}>entry {r.randrange(99)}</{t}><hr>' if r.random() < 0.5 else f'<{t}>x<b>y</b></{t}>some' for t in (r.choice(["h4", "dd", "pre", "dt", "h5"]) for _ in range(700)))
        return f'<body><div class="listing">{listing}</div><div class="story">' + "".join(f"<p>{prose(100 * k + i, 150)}</p>" for i in range(12)) + "</div></body>"

    wrapper = pt.Wrapper()
    for k in range(3):
        wrapper.add(page(k))
    line = wrapper.settle()
    slots = list(pt._texts(line))
    assert len(line) <= pt.MOST_ITEMS + 1
    assert sum(x[pt.CHARS] for _, x in slots) == sum(x[pt.CHARS] for k in range(3) for _, x in pt._texts(pt.items(page(k))))
    assert pt.heart(line) == ["div.story"]
