import random
import time

import pytest

from rankloom.llm import html_text as H


def test_blocks_of_markup():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <!-- note --><header><h1>Site</h1></header><nav><a href=/a>A</a></nav><div class="ad big">Buy</div>
    <main><h1>Head &lt;1&gt;</h1><p>One <b>two<br>three</p><p title="a > b">Caf&eacute;&nbsp; &#x41;&amp;amp; 1 < 2</P>
    <form><input value="x">Search</form><aside>Side</aside><p hidden>no</p><div style="display: none">no</div>
    <ul><li>x<li>y<li class=share>z</ul><table><tr><td>1</td><td>2</td></tr></table><section id="comments"><article class="comment"><p>Nice!</p></article></section></main>
    <footer>&copy; us</footer></body></html>"""
    text = H.main_text(H.blocks(page), [])
    assert text == "Head <1>\nOne two three\nCafé A&amp; 1 < 2\nx\ny\n1 2"


def test_cut_off_and_odd_markup():
    assert H.blocks(None) == H.blocks("") == []
    assert [t for t, _ in H.blocks("a < b <i>c</i><p>d &am")] == ["a < b c", "d &am"]
    assert [t for t, _ in H.blocks("x<script>y")] == ["x"]
    assert [t for t, _ in H.blocks("x<p class='a")] == ["x"]
    assert [t for t, _ in H.blocks("x</nope><3 <!-- y")] == ["x<3"]
    assert H.blocks("<" * 1000)
    assert H.blocks("<a " * 20000) == []


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(3)

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        found = sorted(H.shared(a, b))
        assert len(found) == length(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in found)


PAGE = "<html><body><div>{nav}</div><div><p>{a}</p><p>{b}</p></div><div>{foot}</div></body></html>"


def test_differencing_between_pages(spark):
    rows = [(i, f"http://h.example.com/a/{i:03d}", PAGE.format(nav="Home | All", a=f"own {i}", b="Read more of us", foot="All rights"), "x") for i in range(40)]
    rows += [(100, "http://alone.example.com/", PAGE.format(nav="Home | All", a="own", b="two", foot="All rights"), "x"), (101, None, None, None), (102, "no url", "", "")]
    rows += [(200 + i, "http://copy.example.com/p", PAGE.format(nav="n", a="same", b="text", foot="f"), "") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == (f"own {i}", len(f"own {i}")) for i in range(40))
    assert got[100][0] == "Home | All\nown\ntwo\nAll rights" and got[101] == got[102] == ("", 0)
    assert got[200][0] == got[201][0] == "n\nsame\ntext\nf"  # copies tell nothing of the template
    assert H.extract(df.limit(0)).collect() == []


def test_differencing_decides_on_marked_pages(spark):
    page = "<body><div>Home | All</div><article><p>{a}</p><p>Follow us</p><p>{q}</p></article><div><p>{b}</p></div><div>All rights</div></body>"
    rows = [(i, f"http://m.example.com/a/{i:03d}", page.format(a=f"card {i}", q="quoted" if i in (5, 6) else f"end {i}", b=f"own {i}")) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r["page_id"]: r["text"] for r in H.extract(df).collect()}
    pages = [H.blocks(r[2]) for r in rows]
    # a line of every page goes even inside <article>, a quotation stays; unmarked text of its own stays
    assert H.main_text(pages[5], [pages[4], pages[6]], further=[pages[3], pages[7]]) == "card 5\nquoted\nown 5"
    assert all("Home" not in x and "All rights" not in x and f"own {i}" in x and f"card {i}" in x for i, x in got.items())
    # two pages are too few to tell
    assert H.main_text(pages[0], [pages[1]], further=[pages[2]]) == "card 0\nFollow us\nend 0\nown 0"


def hosts(n, menus, marked):
    """Pages of some hosts: a menu that changes every ``menus`` pages, a story, a line that all share, copies and repeated rows."""
    rng = random.Random(n)
    body = "<article><p>{a}</p><p>{b}</p><p>Follow us</p></article>" if marked else "<div><p>{a}</p><p>{b}</p><p>Follow us</p></div>"
    page = "<body><div class='x1'>{m}</div>" + body + "<div class='y2'>{ad}</div><div>All rights</div></body>"
    rows = []
    for i in range(n):
        b = "quoted" if rng.random() < 0.2 else f"end {i}"
        rows.append((i, f"http://h{i % 3}.example.com/a/{rng.randrange(n):04d}", page.format(m=f"Menu {i // menus}", a=f"own {i}", b=b, ad=f"Ad {rng.randrange(4)}")))
    rows += [rows[5], rows[5], (n, None, page.format(m="m", a="a", b="b", ad="c")), (n + 1, "http://h0.example.com/a/0000", rows[7][2])]
    return rows


def brute(rows):
    """The whole query in plain loops: neighbours in the order of all pages, common subsequences by the table of lengths."""

    def common(a, b):
        n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                n[i][j] = n[i + 1][j + 1] + 1 if a[i] == b[j] else max(n[i + 1][j], n[i][j + 1])
        i = j = 0
        out = set()
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.add(i)
                i, j = i + 1, j + 1
            elif n[i + 1][j] >= n[i][j + 1]:
                i += 1
            else:
                j += 1
        return out

    def host_path(url):
        rest = (url or "").partition("://")[2].partition("#")[0].partition("?")[0]
        host, slash, path = rest.partition("/")
        return host.lower(), slash + path

    order = sorted(set(rows), key=lambda r: (*host_path(r[1]), r[0]))
    text = {}
    for at, row in enumerate(order):
        own = H.blocks(row[2])
        lines = [x for x, _ in own]
        size = sum(len(x) for x, k in own if k != H.SITE)
        around = sorted((abs(j - at), j) for j in range(len(order)) if 0 < abs(j - at) <= 4 and host_path(order[j][1])[0] == host_path(row[1])[0])
        told, near = [], []
        for d, j in around[:4]:
            other = [x for x, _ in H.blocks(order[j][2])]
            both = common(lines, other) if d == 1 else {i for i, x in enumerate(lines) if x in other}
            if sum(len(lines[i]) for i in both if own[i][1] != H.SITE) < 0.95 * size:
                told.append(both)
                near += [both] if d == 1 else []
        gone = set().union(*near)
        every = gone.intersection(*told) if len(told) >= 3 else set()
        text[row] = "\n".join(x for i, (x, k) in enumerate(own) if (k == H.PLAIN and i not in gone) or (k == H.ARTICLE and i not in every))
    return sorted((r[0], text[r]) for r in rows)


@pytest.mark.parametrize("marked", [True, False])
def test_whole_query_equals_brute_force(spark, marked):
    """The class names of these pages are in no list: what pages share decides."""
    rows = hosts(80, 9, marked)
    assert {k for r in rows for _, k in H.blocks(r[2])} == {H.PLAIN, *([H.ARTICLE] if marked else [])}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = brute(rows)
    got = {}
    for parts in (4, 40):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            got[parts] = sorted((r["page_id"], r["text"]) for r in H.extract(df.repartition(parts)).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[4] == got[40] == want
    # without neighbours most pages would have another text
    alone = sorted((r[0], H.main_text(H.blocks(r[2]), [])) for r in rows)
    assert sum(a != b for a, b in zip(alone, want, strict=True)) > 0.9 * len(rows)
    assert not any("All rights" in x for i, x in want if i < 80)


def test_hostile_pages_take_linear_time():
    pages = ["<div>" * 12_000 + "</span>" * 12_000, "<a \">" * 20_000, "<p x='" * 20_000 + ">", '<a "x>' + '" "x>' * 25_000, "<title>" * 15_000, "<div class='" * 10_000, "<div a=\"" * 10_000 + ">", "</div>" * 20_000, "&" * 100_000]
    for page in pages:
        start = time.perf_counter()
        H.blocks(page)
        assert time.perf_counter() - start < 1, page[:20]
    a, b = ["x", "y"] * 4000, ["y", "x"] * 8000
    start = time.perf_counter()
    assert len(H.shared(a, b)) == 8000
    assert len(H.shared(["x"] * 20_000 + ["z"], ["x", "w"] * 15_000)) == 15_000
    assert time.perf_counter() - start < 3


def test_query_on_test_tables(spark):
    import html
    import re

    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = H.op1_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r["page_id"]]["html"] or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
        want = [" ".join(html.unescape(re.sub(r"<[^>]*(?:>|$)", " ", x)).split()) for x in parts]
        assert r["text"].split("\n") == ([x for x in want if x] or [""])
        assert r["n_chars"] == len(r["text"])


def test_names_inside_an_article_count_as_a_whole(spark):
    """A name of which only a part is a mark loses no article text; elements that are marked by their whole name go."""
    kept = ("share-price", "menu-of-the-day", "comment-on-law", "ad-hoc", "related-work", "banner-of-freedom", "alert-level-story", "social-history")
    gone = ("share", "share-buttons", "ad", "ad-slot", "comments", "comments-section", "related-posts", "newsletter-signup", "disqus_thread", "ad-unit-3", "social-share-links")
    body = "".join(f'<div class="x {c}">text {c}</div><p id="{c}">line {c}</p>' for c in (*kept, *gone))
    page = f'<div class="share-price">outside</div><article><p>start</p>{body}<nav>n</nav><p role="alert">r</p></article>'
    want = ["start", *(x for c in kept for x in (f"text {c}", f"line {c}"))]
    assert H.main_text(H.blocks(page), []).split("\n") == want
    got = H.extract(spark.createDataFrame([(1, "http://h/a", page)], "page_id long, url string, html string")).first()
    assert got["text"].split("\n") == want and (got["aligned_away"], got["marked_away"]) == (0, 2 * len(gone) + 3)


def test_alignment_is_asked_before_the_marks(spark):
    """What near pages share is put down to the alignment, though it is marked too."""
    page = lambda i: f"<nav>menu</nav><div class=ad>only {i}</div><article><p>own {i} text of the page</p></article><p>plain shared</p>"
    df = spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(5)], "page_id long, url string, html string")
    rows = H.extract(df).orderBy("page_id").collect()
    assert [r["text"] for r in rows] == [f"own {i} text of the page" for i in range(5)]
    assert {(r["aligned_away"], r["marked_away"]) for r in rows} == {(2, 1)}
