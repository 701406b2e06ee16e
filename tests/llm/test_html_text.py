import html
import random
import re
import time

from strandline.llm import html_text


def inside_article(page):
    body = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    body = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\0", body)))
    return "\n".join(y for y in (" ".join(html.unescape(b).split()) for b in body.split("\0")) if y)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    theirs = {r.page_id: inside_article(r.html) for r in pages.collect()}
    found = html_text.extract(pages).collect()
    assert {r.page_id: r.text for r in found} == theirs
    assert all(r.n_chars == len(r.text) for r in found)


def test_without_article():
    page = """<html><head><title>T</title></head><body><nav><a>Home</a><a>About us all</a></nav><div class="content"><h1>Head</h1><p>One two &amp; three
    four five six.<p>Seven eight nine ten eleven.<div class="ad">Buy now</div><p>Last words of it all.</p></div>
    <div id="comments"><p>First! I agree with all of this and more words</p></div><footer>(c) us</footer></body>"""
    assert html_text.main_text(page, {}) == "Head\nOne two & three four five six.\nSeven eight nine ten eleven.\nLast words of it all."


def test_broken():
    for page in (None, "", "<", "<p", "<!-- x", "<script>var a='<p>'", "<p class='x", "a<b", "</p></p>", "<nav>only menu</nav>"):
        html_text.main_text(page, {})
    assert html_text.main_text("<nav>only menu</nav>", {}) == ""
    assert html_text.main_text("plain words", {}) == "plain words"


def test_awkward(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>a b c</p>", None), (2, "v", "", "t"), (3, "w", "<article>" + "<p>x y</p>" * 5000 + "</article>", "t")]
    found = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in found) == [(0, 5), (1, 0), (1, 0), (2, 0), (3, 5000 * 4 - 1)]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_names_around_articles():
    """Names on what holds an article don't make it boilerplate, and parts of names mark nothing."""
    text = "One two three four five six seven.\nEight nine ten."
    inner = "<p>One two three four five six seven.</p><p>Eight nine ten.</p>"
    for page in (
        f'<body class="has-sidebar"><article>{inner}</article></body>',
        f'<body class="no-sidebar has-header sidebar"><div>{inner}</div></body>',
        f'<article class="post comments-open">{inner}</article>',
        f'<div class="post comments-open">{inner}</div>',
        f'<div class="elementor-widget elementor-widget-theme-post-content">{inner}</div>',
        f'<div class="sidebar"><div id="related"><main class="banner">{inner}</main></div></div>',
        f'<form id="page"><div data-role="banner" class="share notice"><article>{inner}</article></div></form>',
    ):
        assert html_text.main_text(page, {}) == text, page
    for mark in ("sidebar", "post ads", "cookie-notice", "comments-area"):
        assert html_text.main_text(f'<article>{inner}<div class="{mark}"><p>Not of it</p></div></article>', {}) == text
    comments = '<div id="comments"><article class="comment"><p>I like it</p></article></div>'
    assert html_text.main_text(f"<article>{inner}{comments}</article>", {}) == text


def test_long_aside():
    """Boilerplate inside an article costs neither the part before it nor the part behind it."""
    words = lambda word, n: " ".join(f"{word}{k}" for k in range(n))
    weights = {"in p": 1.0, "in boilerplate p": -2.0, "in boilerplate aside": -2.0}
    for before, behind in ((500, 200), (200, 500), (40, 40)):
        a, b = words("a", before), words("b", behind)
        for aside in (f"<aside><p>{words('x', 300)}</p></aside>", f"<aside>{words('x', 900)}</aside>", f'<div><div class="sidebar"><p>{words("x", 300)}</p></div></div>', f"<form><p>{words('x', 300)}</p></form>"):
            for page in (
                f"<article><p>{a}</p>{aside}<p>{b}</p></article>",
                f"<body><p>{a}</p>{aside}<p>{b}</p></body>",
                f"<div><nav>{words('n', 50)}</nav><div><section><p>{a}</p></section>{aside}<section><ul><li>{b}</ul></section></div></div>",
                f"<div><div>{a}</div>{aside}<div>{b}</div></div>",
            ):
                assert html_text.main_text(page, weights) == f"{a}\n{b}", page
    # Boilerplate between the content and something else still separates them.
    page = f"<body><div><p>Not of it</p></div><nav>{words('n', 50)}</nav><div><p>{words('a', 60)}</p></div></body>"
    assert html_text.main_text(page, {}) == words("a", 60)


def test_learned_boilerplate(spark):
    page = "<body><nav>a b c d</nav><article><p>w w w</p><aside>x x x x</aside><p>w w</p></article><aside>y</aside></body>"
    weights = html_text.learn_weights(spark.createDataFrame([(k, page) for k in range(9)], "page_id long, html string"), "page_id", "html")
    assert weights["in boilerplate nav"] == -2.0
    assert weights["in boilerplate aside"] == 0.0


def test_unclosed_and_self_closed():
    """What has no end tag, or needs none, takes no text with it."""
    for odd in ("<svg/>", '<svg viewBox="0 0 1 1" />', "<iframe src='x'/>", "<iframe src='x'>", "<object data='x'/>", "<svg><path d='M0'/><g></svg>", "<button/>", "<svg><svg/><title>x</title></svg>"):
        assert html_text.main_text(f"<article><p>One two {odd}three</p><p>Four five</p></article>", {}) == "One two three\nFour five", odd
    for odd in ("<button>Go", "<select><option>A<option>B", "<object data='x'>no", "<noscript>none", "<template>t", "<svg><path d='M0'>"):
        for page in (f"<article><p>One two {odd}</p><p>Four five</p></article>", f"<article><p>One two</p>{odd}<p>Four five</p></article>", f"<div>One two <span>{odd}</span><p>Four five</div>"):
            assert html_text.main_text(page, {}) == "One two\nFour five", page
            assert html_text.main_text(page + "<footer><button>x</button><svg></svg></footer>", {}) == "One two\nFour five", page
    page = "<article><p>One two</p><button><div>Share</div> it</button><noscript><p>none</p></noscript><p>Four five</p></article>"
    assert html_text.main_text(page, {}) == "One two\nFour five"


def test_scan_is_best():
    """One scan finds what a search of all regions finds."""
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice((-3, -2, -1, -0.5, 0, 1, 2)) for _ in range(rng.randrange(0, 40))]
        start, end = html_text.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0)
        assert sum(scores[start:end]) == max(best, 0)


def test_time_grows_with_length():
    n = 60_000
    for page in ("<div>" * n + "one two", "<b>x" * n, "<b></i>" * n, "<section><aside>a</aside>x y" * (n // 4), "<p><i>" * n, "<svg>" * n + "<p>a b", "<iframe>" * n, "<!" * n, "<div><nav>m</nav>" * (n // 4), "<li>" * n, "<a '" * n):
        began = time.perf_counter()
        html_text.main_text(page, {})
        assert time.perf_counter() - began < 20, page[:20]


MENU = "<nav><ul><li><a>Home page</a><li><a>About us here</a></ul></nav>"
TAIL = "<footer><p>Copyright all rights to us</p></footer>"
BODY = [f"Sentence number {k} of the text goes on for quite a while and then ends." for k in range(12)]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in BODY)


def layouts():
    """Pages unlike the generated ones, all with the same article."""
    half = len(BODY) // 2
    first, second = ("".join(f"<p>{x}</p>" for x in part) for part in (BODY[:half], BODY[half:]))
    aside = "<aside><p>" + "related story link " * 120 + "</p></aside>"
    form = "<form class='newsletter'><label>Your mail</label><input><button>Send it now</button></form>"
    comments = "<section id='comments'><h2>Replies</h2>" + "<div class='comment'><p>I agree with that</p></div>" * 6 + "</section>"
    yield f"<body>{MENU}<main>{PARAGRAPHS}</main>{TAIL}"
    yield f"<body><header><h1>Site</h1>{MENU}</header><article>{first}{aside}{second}</article>{comments}{TAIL}"
    yield f"<body>{MENU}<div class='wrap'><div class='post'>{first}{form}{second}</div><div class='sidebar'><p>Most read now</p></div></div>{TAIL}"
    yield f"<body>{MENU}<div id=content>{'<br><br>'.join(BODY)}</div>{comments}{TAIL}"
    yield f"<body>{MENU}<table><tr><td>{PARAGRAPHS}</td></tr></table>{TAIL}"
    yield f"<body>{MENU}<main><section>{first}</section><section>{second}</section>{aside}</main>{TAIL}"
    yield f"<body class=has-sidebar>{MENU}<article class='entry social-history'>{first}<svg viewBox='0 0'/>{second}{comments}</article>{TAIL}"
    yield f"<body><div role=banner>Our site</div>{MENU}<div><div><div>{PARAGRAPHS}</div></div></div><div class=ads>Buy this now</div>{TAIL}"
    yield f"<body>{MENU}<blockquote>{first}</blockquote><ul>{''.join(f'<li>{x}' for x in BODY[half:])}</ul>{TAIL}"


def test_other_layouts():
    """Recall and precision of words over layouts that the test tables don't have."""
    wanted = " ".join(BODY).split()
    for page in layouts():
        found = html_text.main_text(page, {}).split()
        assert found == wanted, page[:200]


def learned(spark, sf_dir):
    return html_text.learn_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")


def prose(word, n):
    return " ".join(f"{word}{k}" for k in range(n))


def test_nothing_inside_an_article_is_lost(spark, sf_dir):
    """What stands in an article besides prose ends no region, whatever the weights."""
    links = lambda n: "".join(f"<li><a href='#{k}'>Section {k}</a></li>" for k in range(n))
    shown = lambda n: "\n".join(f"Section {k}" for k in range(n))
    a, b, c = prose("a", 60), prose("b", 200), prose("c", 20)
    thumbs = "<div>" + "".join(f"<a href='{k}'><img src='{k}.png'></a>" for k in range(30)) + "</div>"
    cells = "<table>" + "<tr><td></td><td></td><td></td></tr>" * 60 + "</table>"
    inside = {
        f"<p>{a}</p><ul>{links(30)}</ul><p>{b}</p>": f"{a}\n{shown(30)}\n{b}",
        f"<p>{a}</p>{thumbs}<p>{b}</p>": f"{a}\n{b}",
        f"<p>{a}</p>{cells}<p>{c}</p>": f"{a}\n{c}",
        f"<p>{a}</p><h2>References</h2><ol>{links(20)}</ol>": f"{a}\nReferences\n{shown(20)}",
        f"<ul>{links(20)}</ul><p>{c}</p>": f"{shown(20)}\n{c}",
    }
    for weights in ({}, learned(spark, sf_dir)):
        for page, text in inside.items():
            for tag in ("article", "main"):
                assert html_text.main_text(f"<body>{MENU}<{tag}>{page}</{tag}>{TAIL}", weights) == text, page[:60]
        two = f"<body>{MENU}<div><article><p>{a}</p></article><aside>{prose('x', 80)}</aside><article><p>{c}</p></article></div>{TAIL}"
        assert html_text.main_text(two, weights) == f"{a}\n{c}"


def test_nothing_between_paragraphs_is_lost(spark, sf_dir):
    a, b = prose("a", 40), prose("b", 40)
    links = "<ul>" + "".join(f"<li><a href='#{k}'>Section {k}</a></li>" for k in range(40)) + "</ul>"
    shown = "\n".join(f"Section {k}" for k in range(40))
    for weights in ({}, learned(spark, sf_dir)):
        assert html_text.main_text(f"<body>{MENU}<p>{a}</p>{'<div></div>' * 200}<p>{b}</p>{TAIL}", weights) == f"{a}\n{b}"
        assert html_text.main_text(f"<body>{MENU}<div><div>{a}</div>{links}<div>{b}</div></div>{TAIL}", weights) == f"{a}\n{shown}\n{b}"


def test_names_of_comments_and_bars(spark, sf_dir):
    marks = ["class='comment-list'", "class='reader-comments'", "id='respond'", "class='comments_section'", "class='page-header'", "class='page-footer'", "class='adsbygoogle'", "class='gdpr-bar'", "id='article-comments'", "class='commentlist'"]
    for weights in ({}, learned(spark, sf_dir)):
        for mark in marks:
            for tag in ("section", "div"):
                page = f"<body>{MENU}<div>{PARAGRAPHS}</div><{tag} {mark}><p>{prose('x', 60)}</p></{tag}>{TAIL}"
                assert html_text.main_text(page, weights).split() == " ".join(BODY).split(), mark
        for mark in ("has-comments", "no-comments", "comments-open"):
            assert html_text.main_text(f"<body>{MENU}<div class='post {mark}'>{PARAGRAPHS}</div>{TAIL}", weights).split() == " ".join(BODY).split(), mark


def test_time_of_nested_paragraphs():
    n = 20_000
    for page in ("<div>a b c d e f g h i" * n, "<article><ul>" + "<li><a>b" * n, "<section><p>a</p>" * n, "<div><p>a</p><div></div><p>b</p>" * n):
        began = time.perf_counter()
        html_text.main_text(page, {})
        assert time.perf_counter() - began < 20, page[:20]
