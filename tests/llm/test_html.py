"""Main text of pages with known content."""

import random
from html import escape

import pytest

from mselect.llm.html import extract, main_text, smoothed, threshold

PARAS = [f"Paragraph number {i} goes on for quite a while, so that it has many more letters than marks around it." for i in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)
AROUND = """<nav><ul><li><a href=/a>Home</a><li><a href=/b>News about many things of the day</a></ul></nav><div class="cookie-notice">We use cookies on
this site, and here is a long sentence about them that looks like text.</div>"""
AFTER = """<aside><p>Related stories that are long enough to look like the article itself, or nearly so.</p></aside><div id="comments">
<article class=comment><p>Great article, I read it twice and liked it very much, as did all my friends.</p></article></div>
<form><label>Name</label><input><button>Send</button></form><footer>&copy; all rights reserved by someone at some time</footer>"""


@pytest.mark.parametrize("page", [
    f"<html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>'</script></head><body>{AROUND}<article><h1>A title</h1>{BODY}</article>{AFTER}",
    f"{AROUND}<main><header><h1>A title</h1></header>{BODY}<!-- no --></main>{AFTER}",
    f"<div class=ad>Buy &amp; sell<article><h1>A <b>title</h1><div class=advert>Buy this now</div>{BODY}</article>{AFTER}",
])
def test_pages_with_a_root(page):
    assert main_text(page) == "\n".join(["A title", *PARAS])


def test_page_without_a_root():
    assert main_text(f"<body>{AROUND}<div><h1>A title</h1>{BODY}</div>{AFTER}") == "\n".join(["A title", *PARAS])


def test_text_inside_blocks():
    page = "<article><p>a&nbsp;&lt;b&gt;  &eacute;\n\t&#x41;<br>next <i>x</i>y<span> z</span></p><ul><li>one<li>two</ul><p></p></article>"
    assert main_text(page) == "a <b> é A next xy z\none\ntwo"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<nav>menu</nav>", ""), ("<script>x", ""), ("<p>open <b", "open"),
                                       ("<!doctype html><!-- c", ""), ("<article><p>cut &am", "cut &am"), ("</p></div>a", "a"), ("<![CDATA[x]]>y", "y")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_long_pages_in_small_feeds():
    page = f"<article>{BODY * 200}</article>"
    assert main_text(page, feed=7) == main_text(page) == "\n".join(PARAS * 200)
    assert main_text("<div>" * 5000 + "deep text") == "deep text"


def test_smoothing_and_threshold():
    assert smoothed([2.0] * 9, 1.0) == pytest.approx([2.0] * 9)
    peak = smoothed([0, 0, 0, 9.0, 0, 0, 0], 1.0)
    assert peak[3] == max(peak) and peak[2] == pytest.approx(peak[4])
    assert 1 < threshold([0, 1, 0, 9, 10, 9]) < 9 and threshold([3, 3]) == 3


def test_table(spark):
    df = spark.createDataFrame([(1, "u", "<p>x y</p>", "a"), (None, None, None, "b"), (1, "u", "<p>x y</p>", "c")],
                               "page_id long, url string, html string, text string")
    assert sorted(map(tuple, extract(df).collect()), key=repr) == sorted([(1, "u", "x y", 3), (None, None, "", 0), (1, "u", "x y", 3)], key=repr)
    assert extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("block,text", [
    ('Hello there good reader <span class="share-count">3</span> this is the rest', "Hello there good reader this is the rest"),
    ('First part <i class="icon-share"></i> second part', "First part second part"),
    ('Read <a class="social-link">this page</a> and learn more', "Read this page and learn more"),
    ('Read <a class="social-link" hidden>this page</a> and learn more', "Read and learn more"),
    ('A <span class="share"><span>3</span> <b>shares <i class="icon-share">x</i></b> so far</span> text goes on', "A text goes on"),
    ('A <span class="ad"><b>left open</span> text goes on', "A text goes on"),
    ('Go <a class="share-a">to the <b>first</b><a class="share-b"> or second</a> of these many long pages', "Go to the first or second of these many long pages"),
    ('Share: <a class="share">on the one side</a> <a class="share">or on the other</a>', "Share:"),
    ('A script <script>var x = "<p>"</script>and a <svg><g><text>drawing</text></g></svg> or <button>button</button> between', "A script and a or between"),
    ('Text <select><option>a<option>b</select>with a choice', "Text with a choice"),
])
def test_inline_elements_leave_their_block_whole(block, text):
    for page in (f"<article><p>{block}</p>{BODY}</article>", f"<article><h1>T</h1><div>{block}</div>{BODY}</article>"):
        assert main_text(page).split("\n")[-6] == text
    assert main_text(f"{AROUND}<div>{BODY}<p>{block}{' and on' * 9}</p>{BODY}</div>{AFTER}").split("\n")[5].startswith(text.split("<")[0][:6])


def test_built_pages():
    """Pages put together from known blocks: what is said in the article's own blocks comes out, and nothing else."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg é&<", k=rng.randint(1, 8))).strip() or "x"
    for _ in range(300):
        blocks, want = [], []
        for _ in range(rng.randint(1, 12)):
            pieces, said = [], []
            for _ in range(rng.randint(1, 9)):
                w = word()
                shown = escape(w)
                kind = rng.randint(0, 7)
                if kind == 0:
                    pieces.append(f'<span class="{rng.choice(["share-count", "ad", "icon hidden"])}"><b>{shown}</b></span>')
                    continue
                if kind == 1:
                    shown = f"<b>{shown}</b>"
                elif kind == 2:
                    shown = f'<span class="note">{shown}</span>'
                pieces.append(shown)
                said.append(w)
            tag = rng.choice(["p", "h2", "blockquote", "pre", "div"])
            blocks.append(f"<{tag}>{' '.join(pieces)}</{tag}>")
            if said:
                want.append(" ".join(" ".join(said).split()))
        if want:
            assert main_text(f"<body>{AROUND}<article>{''.join(blocks)}</article>{AFTER}</body>") == "\n".join(want)
