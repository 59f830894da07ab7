import re
import time
from html import unescape

import pytest
from support import TESTDATA

from tessel.llm import html

ROWS = html.labelled(html.TABLE)
TREE = html.train(ROWS)


def w(n):
    return " ".join(f"w{i}" for i in range(n))


def path(x):
    """The features that decide on a block."""
    node, used = TREE, []
    while not isinstance(node, int):
        used.append(node[0])
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return used


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", ""),
        ("<article><h1>T &amp; U</h1><p>one  two\n three</p><p>x</p></article>", "T & U one two three x"),
        ("<nav><ul><li><a href=/a>Home</a></li></ul></nav><article><p>Text here.</p></article><footer>&copy; me</footer>", "Text here."),
        ("<article><p>a<b>b</b>c<br>d</p><div class='ad'>Buy</div><aside>More</aside><section class=comments><p>Nice post</p></section></article>", "abc d"),
        ("<article><header><h1>Own</h1></header><p>x</p></article><header>Site name</header>", "Own x"),
        ("<article><form><p>Your name</p><input></form><script>var t='</p>';</script><style>p{}</style><p>y</p></article>", "y"),
        ("<main><p>one</p></main><div id='cookie-banner'>We use cookies on this site to serve you</div>", "one"),
        ("<article><p><b>unclosed<br><p>next</p><p>cut off in the mid", "unclosed next cut off in the mid"),
        ("<article><p>a</p><!-- <p>no</p> --><p title='x > y'>b</p><!-- open", "a b"),
        ("<article><p>1 < 2 &lt;b&gt; &#233;&nbsp;&euro;</p></article>", "1 < 2 <b> é €"),
        ("<article><p>a</p><a hr", "a"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>see <a href='/x'>this <i>link</i></a> now</p></article>", "see this link now"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ],
)
def test_pages(page, expected):
    assert html.main_text(page, TREE) == expected


def test_pages_without_article():
    words = "word " * 30
    page = f"<div class=nav><a href=/>Home</a> <a href=/b>B</a></div><div><p>{words}</p><p>{words}</p></div><div><a href=/1>one</a> <a href=/2>two</a></div>"
    assert html.main_text(page, TREE) == " ".join((words + words).split())


#: Pages without an article element and without names, and what of them is content.
PLAIN = [
    (f"<div><a href=/>Home</a></div><div><a href=/b>B c</a></div><div>{w(40)}</div><div>{w(80)}</div><div><a href=/1>one</a></div><div><a href=/2>two x</a></div>", [w(40), w(80)]),
    (f"<ul><li><a href=/>Home</a><li><a href=/b>B c</a></ul><h1>{w(6)}</h1><p>{w(50)}<p>{w(5)}<p>{w(22)}<ul><li><a>x y</a><li><a>z</a></ul>", [w(6), w(50), w(5), w(22)]),
    (f"<div><a>In</a> | <a>Out</a></div><h2>{w(4)}</h2><div>{w(33)}</div><div>{w(12)}</div><div>{w(60)}</div><div><a>p</a> <a>q</a> <a>r</a></div>", [w(4), w(33), w(12), w(60)]),
    (f"<table><tr><td><a>a</a><td><a>b</a></table><p>{w(90)}</p><p>{w(14)}</p><p>{w(35)}</p><div><a>c</a></div>", [w(90), w(14), w(35)]),
    (f"<p>{w(9)}</p>", [w(9)]),
    (f"<div><a>{w(12)}</a> {w(2)}</div><div><a>x</a></div><div><a>y</a></div>", []),
]


@pytest.mark.parametrize("page, content", PLAIN)
def test_pages_without_telling_markup(page, content):
    assert html.main_text(page, TREE) == " ".join(content)


def test_words_and_links_decide():
    for page, _ in PLAIN:
        for x in html.features([b[1:] for b in html.blocks(page)]):
            assert path(x)[0] == 1 and x[8] == 0  # link density first; nothing is named
    used = {f for r in ROWS for f in path(r)}
    assert {0, 1, 2, 3, 4, 5} & used >= {1} and used & {3, 5} and used & {0, 2, 4}
    assert sum(html.decide(TREE, r[:-1]) == r[-1] for r in ROWS) >= 0.95 * len(ROWS)
    assert html.train([(1, 0), (2, 0)]) == 0 and html.train([(1, 0), (1, 1)]) == 1


@pytest.mark.parametrize("label", [html.TABLE.split("\n")[i] for i in range(1, 40, 3)])
def test_tree_on_pages_that_were_left_out(label):
    """A line's blocks as a tree decides them that didn't see the line."""
    tree = html.train(html.labelled(html.TABLE.replace(label, "")))
    rows = html.labelled(label)
    assert sum(html.decide(tree, r[:-1]) == r[-1] for r in rows) >= 0.7 * len(rows)


def test_blocks_have_link_density():
    assert html.blocks("<p>a b <a>c d</a></p>") == [("a b c d", 4, 0.5, 2, 0, 0)]
    assert [b[1:] for b in html.blocks("<article><h2>a</h2><ul><li>b c</ul></article><nav>d</nav>")] == [(1, 0.0, 3, 1, 0), (2, 0.0, 1, 1, 0), (1, 0.0, 0, -1, 0)]


def test_given_pages():
    """All text of the article elements, as a reader of its own finds it, and nothing else."""
    pq = pytest.importorskip("pyarrow.parquet")
    file = TESTDATA / "sf0.01" / "pages.parquet"
    if not file.exists():
        pytest.skip("no test data")
    for page in pq.read_table(file)["html"].to_pylist():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", page or "", re.S)
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br)[^>]*>", inside[1] if inside else ""))
        assert html.main_text(page or "", TREE) == " ".join(x for x in parts if x)


def test_frame(spark, rows):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<article><p>é</p></article>", "y"), (2, None, "<article><p>é</p></article>", "y"), (None, "v", "", "z"), (3, "w", "<article>" + "<p>ab</p>" * 50_000, "t")], "page_id long, url string, html string, text string")
    got = rows(html.extract(df))
    assert got == sorted([(1, "u", "", 0), (2, None, "é", 1), (2, None, "é", 1), (None, "v", "", 0), (3, "w", " ".join(["ab"] * 50_000), 149_999)], key=repr)
    assert rows(html.extract(df.where("false"))) == []


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<article><p class=notice>x<p>body one<p>two</article>", "body one two"),
        ("<article><p class=notice>x<div>body</div></article>", "body"),
        ("<article><ul><li class=ad>Buy<li>one<ul><li>in</ul><li>two</ul></article>", "one in two"),
        ("<article><dl><dt class=ad>Buy<dd>one</dl><table><tr><td class=ad>Buy<td>two<tr class=ad><td>Buy<tr><td>three</table></article>", "one two three"),
        ("<article><table><tr><td class=ad><table><tr><td>in</table>Buy<td>out</table></article>", "out"),
        *[(f"<article><p>a</p><{x}><p>b</p></article>", "a b") for x in ("noscript", "svg", "template", "object", "video", "audio", "canvas", "iframe")],
        ("<article><p>a</p><script>var x", "a"),
        ("<article><p>a<script src=/js/>var leak=1;</script></p><p>b</p><svg/><p>c</p></article>", "a b c"),
        ("<article><p>a <span class=ad>Buy this</span> b <span>c</span></p><p class=ad><a>Buy</a></p></article>", "a b c"),
        *[(f"<article><p>a</p><div class={x}>b c</div></article>", "a b c") for x in ("share-price", "popular-science", "alert", "ad-hoc", "commentary")],
        *[(f"<article><p>a</p><div class='x {x}'>b c</div></article>", "a") for x in ("comments", "ad", "ad-slot", "cookie-banner", "nav_menu", "comment-list-2")],
        ("<article><p>so <math><mi>x</mi></math> is</p><svg>kept", "so x is kept"),
        ("<article><p>so <math><mi>x</mi><annotation>tex</annotation></math> is</p></article>", "so x is"),
    ],
)
def test_implied_ends(page, expected):
    assert html.main_text(page, TREE) == expected


@pytest.mark.parametrize("piece", ["<svg><div>", "<div></p>", "<p><button><div>", "<li><b>", "<table><tr><td>", "<span class=x>", "<dl><dd><div>"])
def test_many_unclosed_elements_take_linear_time(piece):
    began = time.process_time()
    assert html.main_text("<article>" + piece * (100_000 // piece.count("<")) + "<p>x", TREE) == ("" if "button" in piece else "x")
    assert time.process_time() - began < 2


LEAKS = "user-comments post-comments disqus_thread responses left-sidebar site-footer cookie-consent gdpr-banner ad-slot-top ad_300x250 google-ad c-advert social-share related-posts newsletter-signup userComments AdSlot1".split()


@pytest.mark.parametrize("name", LEAKS)
def test_names_of_many_forms_go(name):
    assert html.main_text(f"<article><h1>{w(4)}</h1><p>{w(30)}</p><div class='{name}'>b c d</div></article>", TREE) == f"{w(4)} {w(30)}"
    assert html.main_text(f"<h1>{w(4)}</h1><p>{w(40)}</p><p>{w(30)}</p><div id={name}>b c d</div>", TREE) == f"{w(4)} {w(40)} {w(30)}"


@pytest.mark.parametrize("name", ["user-comments", "left-sidebar", "post-comments", "disqus_thread", "related-posts"])
def test_prose_in_what_is_no_article_goes(name):
    assert html.main_text(f"<article><p>{w(30)}</p><div class={name}><p>{w(45)}</p><p>{w(20)}</p></div></article>", TREE) == w(30)
    assert html.main_text(f"<div><p>{w(50)}</p><p>{w(30)}</p></div><div class={name}><p>{w(45)}</p></div>", TREE) == f"{w(50)} {w(30)}"


@pytest.mark.parametrize("markup", ["<div class=share-list>{}</div>", "<div class=search-section>{}</div>", "<p class=banner>{}</p>", "<div class=social><p>{}</p></div>"])
def test_words_decide_under_vague_names(markup):
    """Prose stays, what has few words or only links goes, whatever the name."""
    page = lambda inside: f"<article><h1>{w(4)}</h1><p>{w(30)}</p>{markup.format(inside)}<p>{w(25)}</p></article>"
    assert html.main_text(page(w(42)), TREE) == f"{w(4)} {w(30)} {w(42)} {w(25)}"
    assert html.main_text(page("Tell us"), TREE) == f"{w(4)} {w(30)} {w(25)}"
    assert html.main_text(page("<a href=/>tell a friend of it</a>"), TREE) == f"{w(4)} {w(30)} {w(25)}"


def test_word_features_decide_vague_blocks():
    for n in (3, 40):
        x = html.features([(4, 0.0, 3, 1, 0), (n, 0.0, 0, 1, 1), (25, 0.0, 2, 1, 0)])[1]
        assert set(path(x)) & {0, 2, 4} and html.decide(TREE, x) == (n > 20)


@pytest.mark.parametrize("name, said", [("ad-hoc", 0), ("share-price", 0), ("commentary", 0), ("popular-science", 0), ("advertising-history", 0), ("banner", 1), ("share-list", 1), ("navMenu", 2), ("", 0), ("123", 0), ("top", 0), ("ad-slot-top-300x250", 2)])
def test_names(name, said):
    assert html.says(name) == said
