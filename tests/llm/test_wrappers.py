"""HTML extraction: alignment rules, planted pages against their known article text, odd rows."""

import random
import re

import pytest

from lumiframe.llm.html_tree import parse
from lumiframe.llm.wrappers import Extractor, Node, _merged, fold, main_text, merge, page_node


def labels(items):
    return [(n.label, o, r) for n, o, r in items]


def node(page):
    return page_node(parse(page))


def test_repeated_children_fold():
    items = [[Node(x), False, False] for x in "h p b p p b q"]
    assert labels(fold([i for i in items if i[0].label != " "])) == [("h", False, False), ("p", False, True), ("b", True, True), ("q", True, True)]


def test_mismatches_become_slots_and_options():
    one, other = node("<div><h1>A</h1><p>x</p></div>"), node("<div><h1>B</h1><hr><p>x</p></div>")
    div = merge(one, other).items[0][0]
    assert labels(div.items) == [("h1", False, False), ("hr", True, False), ("p", False, False)]
    assert div.items[0][0].text is True and div.items[2][0].text == ["x"]


def test_merge_order_hardly_matters():
    rng = random.Random(1)
    pages = ["".join(rng.choice(["<p>a</p>", "<ul><li>x<li>y</ul>", "<b>z</b>", "<div class=c1>q</div>"]) for _ in range(rng.randrange(6))) for _ in range(30)]
    kinds = set()
    for _ in range(5):
        rng.shuffle(pages)
        total = node(pages[0])
        for p in pages[1:]:
            total = merge(total, node(p))
        kinds.add(frozenset(n.label for n, _, _ in total.items))
    assert len(kinds) == 1 and total.pages == 30


NOISE = {
    "top": '<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Menu {i}</a><li><a>More</a></ul></nav>',
    "ad": '<!-- ad {i} --><div class="ad-box">Buy {i} <b>now</b></div>',
    "notice": '<div class="cookie-notice" role="alert">We use cookies {i}</div>',
    "side": "<aside><p>Related {i}</p></aside><form><input value=x><label>Mail {i}</label></form>",
    "tail": '<section id="comments"><p>First! {i}</p></section><footer>&copy; {i}</footer>',
}


def page(i, article, parts="top ad notice side tail", closed=True):
    noise = {k: v.replace("{i}", str(i)) if k in parts.split() else "" for k, v in NOISE.items()}
    return (
        f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{a:b}}</style><script>var t='</p>';</script></head><body>"
        f"{noise['top']}{noise['ad']}{noise['notice']}{article}{noise['side']}{noise['tail']}" + ("</body></html>" if closed else "")
    )


def pages():
    rng = random.Random(2)
    out = []
    for i in range(60):
        words = [f"w{rng.randrange(99)}" for _ in range(40)]
        body = f"<h1>Title {i} &amp; Co</h1><p><b>{words[0]}</b>{words[1]}<br>{words[2]}<p>{' '.join(words[3:20])}</p>"
        text = f"Title {i} & Co {words[0]}{words[1]} {words[2]} {' '.join(words[3:20])}"
        if i % 3 == 0:
            body += f"<ul><li>{words[20]}<li>{words[21]}</ul><div class='ad'>x {i}</div><script>q('<p>')</script>"
            text += f" {words[20]} {words[21]}"
        if i % 4 == 0:
            body += "<p>a&lt;b &#233;&nbsp;&euro;\n\n c</p>"
            text += " a<b é € c"
        host = ["a.example.com", "b.example.org", "c.example.net"][i % 3 if i % 2 else 0]
        holder = "article" if host[0] != "b" else "div class='post-content'"
        article = f"<{holder}>{body}</{holder.split()[0]}>"
        out.append((i, f"https://{host}/p/{i}?x=1", page(i, article, closed=i % 5 > 0), text))
    return out


def test_pages(spark):
    rows = pages()
    df = spark.createDataFrame([(p, u, h, "x", 0) for p, u, h, _ in rows], "page_id bigint, url string, html string, text string, host int").repartition(5)
    found = {r.page_id: r for r in main_text(df).collect()}
    for p, u, _, text in rows:
        assert (found[p].url, found[p].text, found[p].n_chars) == (u, text, len(text))


def test_without_a_marked_region():
    bodies = [f"<div><div>Home</div><div>About us</div></div><p>story {i} of the day</p><p>more {i}</p>" for i in range(5)]
    import json

    packed = _merged(json.dumps(node(b).packed()) for b in bodies)
    assert [Extractor(packed).text(b) for b in bodies] == [f"story {i} of the day more {i}" for i in range(5)]


def test_odd_rows(spark):
    rows = [(None, None, None), (1, None, ""), (2, "no host", "plain text only"), (2, "no host", "plain text only"), (3, "http://x/", "<article>" + "<p>w</p>" * 30000), (4, "HTTP://X/?", "<a <b> < 3 & <article>x</article"), (5, "http://y", "<" * 50)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = main_text(df).collect()
    assert len(found) == len(rows)
    texts = {r.page_id: r.text for r in found}
    assert texts[None] == "" and texts[1] == "" and texts[2] == "plain text only" and texts[3] == " ".join(["w"] * 30000)
    assert main_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("html,text", [("<p>a</p></div>b", "a b"), ("x<!-- c --->y", "xy"), ("<script>1", ""), ("<P CLASS='Menu'>m</P>t", "t"), ("a<b>c</b>d", "acd"), ("<td>a<td>b", "a b")])
def test_broken_markup(html, text):
    import json

    assert Extractor(json.dumps(node(html).packed())).text(html) == text


def test_given_pages(spark, data):
    """The article element of the given pages, read by a pattern that only fits them."""
    import html as h

    pages = spark.read.parquet(f"{data}/pages.parquet")
    found = {r.page_id: r.text for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*)</article>", r.html or "", re.DOTALL)
        plain = re.sub(r"</?b>", "", inner[1]) if inner else ""
        assert found[r.page_id] == " ".join(h.unescape(re.sub(r"<[^>]*>", " ", plain)).split())


def extracted(spark, pages, url="https://site.example.com/"):
    """Texts of (page, ...) of one host, in order."""
    df = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").selectExpr("page_id", f"'{url}' url", "html")
    return [r.text for r in main_text(df).orderBy("page_id").collect()]


def test_pages_of_one_host_with_marks_of_their_own(spark):
    slugs = ["first", "second", "third", "fourth"]
    bodies = [f"<body class='home-{s}'><article id='my-{s}-post' class='post category-{s}'><p>text of {s}</p></article></body>" for s in slugs]
    other = ["<main><p>second template</p></main>", "<div class='entry-content'>third template</div>", "<p>no region</p>"]
    pair = ["<article class='post a'>one</article><div>between</div><article class='post b'>two</article>"]
    assert extracted(spark, bodies + other + pair) == [f"text of {s}" for s in slugs] + ["second template", "third template", "no region", "one two"]


def test_wrapper_does_not_grow_with_page_marks():
    marks = frozenset(["post"])
    total = page_node(parse("<article class='post'>x</article>"), marks)
    for i in range(200):
        slug = "".join(chr(97 + int(d)) for d in str(i))
        total = merge(total, page_node(parse(f"<article class='post {slug}'>{i}</article><x-{slug}>y</x-{slug}>"), marks))
    assert labels(total.items) == [("article post", False, False), ("x", True, False)]


def by_wrapper(bodies):
    """Texts of the pages of one host, all marks kept."""
    import json

    packed = _merged(json.dumps(node(b).packed()) for b in bodies)
    return [Extractor(packed).text(b) for b in bodies]


@pytest.mark.parametrize(
    "body",
    [
        "<body class='has-sidebar'><p>{}</p></body>",
        "<body class='no-sidebar'><article>{}</article></body>",
        "<article class='post comments-open'>{}</article>",
        "<article class='social'>{}</article>",
        "<article><p class='social-policy'>{}</p></article>",
        "<article><div class='share-price'>{}</div></article>",
        "<div class='layout-sidebar'><main>{}</main></div>",
        "<article><section class='related-work'>{}</section></article>",
        "<div class='widget'><article>{}</article></div>",
    ],
)
def test_a_word_in_a_name_cuts_no_text(body):
    assert by_wrapper([body.format(f"text {w}") for w in "abcd"]) == [f"text {w}" for w in "abcd"]


def test_a_compound_name_excludes_where_the_wrapper_agrees():
    same = "<article>{0}<div class='share-tools-x'>Tell others</div><div class='related-x'><a href=/{0}>See {0}</a></div></article>"
    assert by_wrapper([same.format(w) for w in "abcd"]) == list("abcd")
    assert by_wrapper(["<article>a<div class='cookie-notice'>x</div></article>", "<article>b<div class='ad-box'>y</div></article>"]) == ["a", "b"]


def test_the_outermost_region_is_read_whole():
    text = "title {0} lead {0} " + "most of it {0} " * 6 + "the rest {0} " * 3
    body = "<main><h1>title {0}</h1><p>lead {0}</p><div class='content'>" + "most of it {0} " * 6 + "</div><p>" + "the rest {0} " * 3 + "</p></main>"
    assert by_wrapper([body.format(w) for w in "abcd"]) == [text.format(w).strip() for w in "abcd"]
    replies = "<article>story {0}" + "<article class='reply'>an answer of some length {0}</article>" * 9 + "</article>"
    assert by_wrapper([replies.format(w) for w in "abcd"]) == [f"story {w}" for w in "abcd"]
    frame = "<div id='content'><p>Our motto</p><article>story {0}</article></div>"
    assert by_wrapper([frame.format(w) for w in "abcd"]) == [f"story {w}" for w in "abcd"]
    assert by_wrapper([frame.format(w) for w in "abcd"] + ["<div id='content'><p>alone</p></div>"])[-1] == "alone"


def test_copies_of_a_page_are_no_template():
    long = "a sentence that is repeated until it is long enough " * 3
    copy = f"<div><h2>The title</h2><p>{long}</p><div>A short block</div></div>"
    text = " ".join(f"The title {long} A short block".split())
    assert by_wrapper([copy] * 5) == [text] * 5
    others = [f"<table><tr><td>{w} {long}</table>" for w in "abc"]
    assert by_wrapper([copy] * 5 + others)[:5] == [text] * 5
    menus = [f"<div>Home</div><p>{w} {long}</p>" for w in "abc"]
    assert by_wrapper(menus) == [f"{w} {' '.join(long.split())}" for w in "abc"]


def test_deep_pages(spark):
    kinds = ["<div>", "<span>", "<font>", "<b>", "<i class=c>"]
    deep = [f"<article>{k * 5000}deep {i}</article>" for i, k in enumerate(kinds)] + ["<p>x</p>" + "<div>" * 5000 + "deep 5"]
    flat = ["<article>flat</article>"]
    assert extracted(spark, deep + flat) == [f"deep {i}" for i in range(5)] + ["x deep 5", "flat"]


def test_many_nested_groups():
    names = [f"zz{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    page = "".join(f"<{n}>x</{n}>" for n in [*names, *names[::-1]])
    assert by_wrapper([page] * 2) == ["x" * 1200] * 2


def on_host(bodies):
    """Texts of the pages of one host by its last wrapper."""
    import json

    packed = _merged((json.dumps(node(b).packed()) for b in bodies), last=True)
    return [Extractor(packed).text(b) for b in bodies]


STORY = "<p>story {0} of the day</p><p>more {0}</p>"


@pytest.mark.parametrize(
    "noise",
    [
        "<div>" + "Copyright of the publisher and its partners in all countries. " * 3 + "</div>",
        "<div>" + "".join(f"<div><a href=/{i}>Menu {i}</a></div>" for i in range(20)) + "</div>",
        "<div>" + "".join(f"<div><a href=/{i}>Menu {i}</a></div>" for i in range(400)) + "</div>",
        "<div>" * 20 + "Home" + "</div>" * 20,
        "<div>" * 60 + "Home" + "</div>" * 60,
        "<div>" * 60 + "Home<b>page</b>" + "</div>" * 60,
        "<span>" * 500 + "Home" + "</span>" * 500,
        "<div>Related stories<ul>" + "".join(f"<li><a href=/{i}>A further story {i} after {{0}}</a></li>" for i in range(9)) + "</ul></div>",
    ],
    ids=["long", "menu 20", "menu 400", "deep 20", "deep 60", "deep mixed", "deep 500", "related"],
)
def test_template_of_any_size_goes(noise):
    words = [f"w{chr(97 + i)}" for i in range(10)]
    expected = [f"story {w} of the day more {w}" for w in words]
    for page in (noise + "<div>" + STORY + "</div>", "<div>" + STORY + "</div>" + noise):
        assert on_host([page.format(w) for w in words]) == expected
    assert by_wrapper([(noise + STORY).format(w) for w in words]) == expected


def test_deep_text_that_differs_stays():
    pages = ["<div>" * 60 + f"<p>text {w}</p>" + "same" + "</div>" * 60 for w in "abcd"]
    assert on_host(pages) == [f"text {w}" for w in "abcd"]
    links = "<div><ul><li><a href=/1>one {0}</a><li><a href=/2>two {0}</a></ul></div>"
    assert on_host([links.format(w) for w in "abcd"]) == [f"one {w} two {w}" for w in "abcd"]


def test_order_of_blocks_does_not_make_a_template():
    """Blocks that pages order differently are those of two pages, not the repeated ones of one."""
    head, body = "<h1>Title {0}</h1>", "<pre>text {0}</pre>"
    pages = [(head + body).format("same")] * 3 + [(body + head).format(w) for w in "abcdef"]
    pages = [p + f"<p>page {chr(65 + i)}</p>" for i, p in enumerate(pages)]
    plain = [" ".join(re.sub("<[^>]*>", " ", p).split()) for p in pages]
    assert on_host(pages) == plain and on_host(pages[::-1]) == plain[::-1]


def test_depth_of_groups_changes_no_text(monkeypatch):
    rng = random.Random(5)
    parts = ["<p>a</p>", "<ul><li>x<li>y{0}</ul>", "<b>z</b>", "<div class=c>q</div>", "<h2>t{0}</h2>", "<pre>Home</pre>"]
    pages = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))).format(i) for i in range(20)]
    found = on_host(pages)
    monkeypatch.setattr("lumiframe.llm.wrappers.NESTED", 1)
    assert on_host(pages) == found
