import random

from attestor.llm import htmltext as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=top><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad <p>x</p> -->
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div><article><header><h1>Title &amp; more</h1><p>By X</p></header>
<p><b>First &lt;b&gt;   line<br>goes on.<br><p>Second&nbsp;&#233;<div class="share-links">Share</div><form><p>Mail</p><input></form>
<table><tr><td>a</td><td>b</td></tr></table><aside>More</aside><section class="comments"><article><p>Nice!</p></article></section></article>
<div class="sidebar">S</div><footer>&copy; us</footer></body></html>"""


def lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_article_without_the_rest():
    assert H.main_text(PAGE, None) == "Title & more\nFirst <b> line goes on.\nSecond é\na b"


def test_truncated_and_broken_pages():
    for at in range(0, len(PAGE), 7):
        H.main_text(PAGE[:at], None)
    assert H.main_text("<p>a < b <c", None) == "a < b <c"
    assert H.main_text('<p title="x>y">t</p', None) in ("t", "t</p") and H.main_text(None, None) == "" == H.main_text("", None)


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(12)
    for _ in range(1500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(12))] for _ in range(2))
        s = H.shared_lines(a, b)
        assert len(s) == lcs(a, b) == lcs([a[i] for i in s], b)


def test_pages_without_article_lose_what_their_nearest_page_shares(spark):
    page = lambda i: f"<body><div>Welcome</div><p>Text {i} of this page</p><div>Imprint</div></body>"
    rows = [(i, f"http://h.example/{'a' if i < 3 else 'b'}/{i}", page(i)) for i in range(6)] + [(10, "http://alone.example/", page(10)), (11, None, None), (11, None, None), (12, "http://[bad", "<p>x"), (None, "u", "<p>y")]
    df = spark.createDataFrame([(*r, 1, "h") for r in rows], "page_id long, url string, html string, th long, host string")
    got = [(r.page_id, r.text, r.n_chars) for r in H.extract(df).collect()]
    assert len(got) == len(rows)
    texts = {i: t for i, t, _ in got}
    assert all(texts[i] == f"Text {i} of this page" for i in range(6))
    assert texts[10] == "Welcome\nText 10 of this page\nImprint" and texts[11] == "" and texts[12] == "x" and texts[None] == "y"
    assert all(n == len(t) for _, t, n in got)
    assert H.extract(df.limit(0)).count() == 0


def test_neighbours_do_not_depend_on_partitions(spark):
    r = random.Random(13)
    lines = ["<p>" + r.choice("abcdef") * 3 + "</p>" for _ in range(40)]
    rows = [(i, f"http://h.example/{r.randrange(50)}/{i}", "".join(r.choice(lines) for _ in range(8))) for i in range(80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "7", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted((x.page_id, x.text) for x in H.extract(df).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] == seen[2]


def test_copies_and_versions_of_a_page_keep_their_text(spark):
    body = " ".join(f"word{i}" for i in range(40))
    page = lambda text, more="": f"<body><div>Welcome</div><p>{text}</p>{more}<div>Imprint</div></body>"
    rows = [(1, "http://h.example/a/1", page(body)), (2, "http://h.example/a/1", page(body)), (3, "http://h.example/a/1?print", page(body))]
    rows += [(4, "http://h.example/a/2", page(body, "<p>changed</p>")), (5, "http://h.example/z", page("Another"))]
    rows += [(6, "http://copies.example/", page("Alone")), (7, "http://copies.example/", page("Alone"))]
    notice = " ".join(f"legal{i}" for i in range(40))
    rows += [(10 + i, f"http://many.example/{i}", page(f"Text {i}", f"<p>{notice}</p>")) for i in range(8)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == got[3] == body and got[4] == f"{body}\nchanged" and got[5] == "Another"
    assert got[6] == got[7] == "Welcome\nAlone\nImprint"
    assert all(got[10 + i] == f"Text {i}" for i in range(8))


def test_layout_elements_do_not_take_the_article_with_them():
    for name in ("layout has-sidebar", "content-with-sidebar", "no-comments", "main-widget-area", "page-skip-nav", "has-header", "sidebar-layout", "widget", "header-image"):
        for tag in ("main", "article"):
            assert H.main_text(f"<body><div class='{name}'><{tag}><p>The text</p></{tag}></div><footer>f</footer></body>", None) == "The text"
    for name in ("has-sidebar", "no-comments", "has-header"):
        assert H.main_text(f"<div class='{name}'><p>The text</p></div>", None) == "The text"
    assert H.main_text("<article class='post no-comments'>The text</article>", None) == "The text"
    assert H.main_text("<form id=aspnetForm><input><main><p>The text</p></main><p>x</p></form>", None) == "The text"


def test_what_is_marked_goes_still():
    for name in ("sidebar", "cookie-notice", "shareLinks", "tag-cloud", "sign-in", "comments"):
        assert H.main_text(f"<div class='{name}'>x</div><p>The text</p>", None) == "The text"
    comments = "<section class=comments><article><p>A comment that is longer than the text</p></article></section>"
    assert H.main_text(f"<article>The text{comments}</article>", None) == H.main_text(f"<article>The text</article>{comments}", None) == "The text"
    assert H.main_text("<p>The text of the page</p><div class=related><article>Teaser</article></div>", None) == "The text of the page"
    assert H.main_text("<div style='display:none'><main>x</main></div><p>The text</p>", None) == "The text"


def nearest(rows):
    """By brute force: each page's nearest different page of its host."""
    first = {}
    for page, host, path, lines in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        first.setdefault((host, tuple(lines)), (path, page))
    out = {}
    for (host, lines), (path, page) in first.items():
        others = sorted((p, i, x) for (h, x), (p, i) in first.items() if h == host)
        at = others.index((path, page, lines))
        near = [others[j] for j in (at - 1, at + 1) if 0 <= j < len(others)]
        same = lambda p: next((k for k, (x, y) in enumerate(zip(p, path, strict=False)) if x != y), min(len(p), len(path)))  # noqa: B023, E731
        out[host, lines] = max(near, key=lambda n: same(n[0]))[2] if near else ()
    return out


def test_unmarked_pages_match_brute_force_pairing(spark):
    r = random.Random(21)
    pool = [f"line {c}{k}" for c in "abcdef" for k in range(3)]
    rows = []
    for i in range(120):
        host, path = f"h{r.choice('0001')}.example", f"/{r.choice('xyz')}{r.randrange(9)}/{r.randrange(40)}"
        rows.append((i, host, path, ["Welcome to the site", *r.sample(pool, r.randrange(6)), f"own {i}" if i % 5 else "twice", "Imprint"]))
    html = lambda lines: "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    df = spark.createDataFrame([(i, f"http://{h}{p}", html(x)) for i, h, p, x in rows], "page_id long, url string, html string")
    got = {x.page_id: x.text.split("\n") if x.text else [] for x in H.extract(df).collect()}
    # on the large host, lines that few pages share stay; none is long
    pairs = nearest(rows)
    sizes = {h: len({tuple(x) for _, g, _, x in rows if g == h}) for _, h, _, _ in rows}
    assert max(sizes.values()) >= H.MANY_PAGES > min(sizes.values())
    for i, host, _, lines in rows:
        near = pairs[host, tuple(lines)]
        on = {x: len({tuple(y) for _, h, _, y in rows if h == host and x in y}) for x in lines}
        rare = {x for x in lines if sizes[host] >= H.MANY_PAGES and 2 <= on[x] <= H.FEW_PAGES}
        gone = len(lines) - len(got[i])
        assert lcs([x for x in lines if x not in rare], near) <= lcs(lines, near)
        assert lcs(got[i], lines) == len(got[i])
        if not rare:
            assert gone == lcs(lines, near)
        assert "Welcome to the site" not in got[i] and "Imprint" not in got[i] and (i % 5 == 0 or f"own {i}" in got[i])


def test_ignoring_the_difference_would_change_the_text(spark):
    body = lambda i: f"<body><div>Site of all news</div><p>Article {i} says something of its own</p><p>Read the rules</p></body>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", body(i)) for i in range(4)], "page_id long, url string, html string")
    for row in H.extract(df).collect():
        assert row.text == f"Article {row.page_id} says something of its own" != H.main_text(body(row.page_id), None)
    assert H.main_text(body(0), [0, 2]) == "Article 0 says something of its own"


def test_marks_protect_and_unmarked_text_needs_length():
    long = " ".join(f"w{i}" for i in range(H.LONG_WORDS))
    page = f"<div>short</div><div>{long}</div><article><p>a</p><p>b</p></article>"
    assert H.main_text(page, [2, 3]) == f"{long}\na\nb" and H.main_text(page, [1]) == "a\nb"


def test_layout_that_holds_nearly_all_text_stays():
    text = "<p>The text of the page is here</p><p>and goes on</p>"
    for name in ("sidebar-layout-page sidebar", "widget", "related"):
        assert H.main_text(f"<div class='{name}'>{text}</div><p>x</p>", None) == "The text of the page is here\nand goes on\nx"
    assert H.main_text(f"<div class='comments'>{text}</div><p>x</p>", None) == "x"


def test_time_is_in_proportion_whatever_the_markup():
    import time

    def taken(make, n):
        began = time.process_time()
        H.blocks(make(n))
        return time.process_time() - began

    for make in (lambda n: "<div>" * n + "</p>" * n, lambda n: '<a b="' * n, lambda n: "<select>" + "<div>" * n + "<option>x</option>" * n, lambda n: "<ul><li>" * n):
        assert taken(make, 40_000) < 20 * max(taken(make, 10_000), 0.02)


def test_long_pages_and_lines_on_many_hosts(spark):
    r = random.Random(3)
    words = [" ".join(r.choice("abcdefgh") * r.randrange(1, 8) for _ in range(30)) for _ in range(3000)]
    big = "<body>" + "".join(f"<p>{w} {i}</p>" for i, w in enumerate(words)) + "</body>"
    rows = [(0, "http://long.example/1", big), (1, "http://long.example/2", big + "<p>more</p>")]
    rows += [(2 + i, f"http://h{i % 40}.example/{i}", f"<body><div>On every host</div><p>Text {i}</p></body>") for i in range(200)]
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].count("\n") == 2999 and got[1].endswith("more")
    assert all(got[2 + i] == f"Text {i}" for i in range(200))
