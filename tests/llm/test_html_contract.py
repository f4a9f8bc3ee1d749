"""What goes and what stays inside articles, what ends a block, and hosts with many layouts: exact texts."""

import random

import pytest

from lectern.llm import html_wrapper

BODY = "The first paragraph of a story goes on for a while so that it is long.</p><p>The second one tells of something else entirely, and at some length."


def text_of(html):
    page = html_wrapper.parse(html)
    return "\n".join(t for t, _ in html_wrapper.blocks(page, {}))


def want():
    return BODY.replace("</p><p>", "\n")


@pytest.mark.parametrize("part", [
    '<div class="notice">N</div>', '<div class="cookie-consent">C</div>', '<div class="promo-box">P</div>', '<div class="ad-slot">A</div>', '<ins class="adsbygoogle">A</ins>',
    '<div class="related"><a>R</a></div>', '<section id="comments"><p>c</p></section>', '<article class="comment"><p>c</p></article>', '<ol class="commentlist"><li>c</li></ol>',
    '<div class="user-comments">c</div>', '<div class="nav">n</div>', '<div class="social-links">s</div>', "<p hidden>h</p>", '<p hidden="">h</p>', '<div id="disqus_thread">d</div>', '<div class="ad1">x</div>',
    f'<section class="comments"><p>{"many words " * 80}</p></section>', '<aside>a</aside>', '<div role="navigation">n</div>',
])
def test_furniture_inside_an_article_goes(part):
    for main in ("article", "main"):
        assert text_of(f"<body><{main}><h1>Title</h1><p>{BODY}</p>{part}<p>end</p></{main}></body>") == f"Title\n{want()}\nend"
        assert text_of(f"<body><{main}><h1>Title</h1>{part}<p>{BODY}</p></{main}></body>") == f"Title\n{want()}"


@pytest.mark.parametrize("mark", ['class="comments-open post"', 'class="social-science"', 'class="widget-body"', 'data-x="hidden"', 'class="hidden-figures"', 'hidden="until-found"', 'class="shared adage"', 'title="a hidden place"'])
def test_what_holds_the_text_stays_whatever_its_name(mark):
    assert text_of(f"<body><article><div {mark}><p>{BODY}</p></div></article></body>") == want()


def test_a_single_word_of_the_text_is_no_furniture():
    assert text_of('<article><p>one <span class="term">two</span> <a class="share-of">three</a></p><p class="adjacent">four</p></article>').startswith("one two")


def test_only_blocks_end_blocks():
    inner = "<script>x</script>", "<style>y</style>", "<svg><text>z</text></svg>", "<button>b</button>", "<select><option>o</option></select>", "<textarea>t</textarea>", "<noscript>n</noscript>", "<iframe>i</iframe>", "<!-- c -->"
    for x in inner:
        assert text_of(f"<article><p>one {x}two {x} three</p></article>") == "one two three"
    assert text_of("<p>one <script>x</script>two <svg/>three <button>b</button> four</p>") == "one two three four"
    assert text_of("<article><p>one<form>f</form>two</p></article>") == "one\ntwo"


@pytest.mark.parametrize("layouts", [3, 12, 20])
def test_no_layout_of_a_host_keeps_its_template(spark, layouts):
    """Each layout nests its story and its own standing line in other elements; a page tells its number and its story."""
    rng = random.Random(layouts)
    tags = ["div", "section", "ul", "table", "dl", "blockquote", "figure", "center", "details", "fieldset", "pre", "ol", "h2", "address", "hgroup", "p", "h4", "h5", "h6", "h3"]
    rows, expected = [], {}
    for k in range(layouts):
        for i in range(5):
            story = " ".join(rng.choice(["river", "house", "tree", "stone"]) + str(rng.randrange(10**6)) for _ in range(12))
            tag = tags[k]
            rows.append((1000 * k + i, f"http://one.example/{k}/{i}", f"<body><{tag}>Standing line of layout {k}</{tag}><div><{tag}><span>{story}</span></{tag}></div></body>"))
            expected[1000 * k + i] = story
    rows += [(-1, "http://one.example/x", None), (-2, "http://one.example/y", ""), (-3, "http://one.example/z", "<p>alone with a text of its own</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(df).collect()}
    assert {k: v for k, v in got.items() if k >= 0} == expected
    assert got[-1] == got[-2] == "" and got[-3] == "alone with a text of its own"
