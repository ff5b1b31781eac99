from __future__ import annotations

import html
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from landflux.llm import html_main  # noqa: E402

PAGE = "page_id bigint, url string, html string, text string"


def texts(spark, pages, host="h.test"):
    rows = [(i, f"http://{host}/{i}", p, "clash") for i, p in enumerate(pages)]
    got = sorted(html_main.main_text(spark.createDataFrame(rows, PAGE)).collect(), key=lambda r: r.page_id)
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == len(pages)
    return [r.text for r in got]


def plain_texts(pages):
    """The method over pages of one host by plain counts: nodes are tuples of names, digests the things themselves."""
    read = []
    for page in pages:
        found = html_main.runs(page or "")
        found = [r for r in found if r[1]] or found
        blocks = []
        for place, main, text in found:
            names = tuple(place.split("/")) if place else ()
            while names and names[-1] in {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}:
                names = names[:-1]
            kinds = [n.split(".")[0] for n in names]
            fixed = max((k + 1 for k, n in enumerate(kinds) if n in (("article", "main") if main else ("html", "body"))), default=0)
            blocks.append((names, fixed, text))
        read.append(blocks)
    layouts, contents, features, places = defaultdict(Counter), defaultdict(Counter), Counter(), Counter()
    for blocks in read:
        nodes = {names[:k] for names, fixed, _ in blocks for k in range(fixed + 1, len(names) + 1)}
        for node in nodes:
            below = [(names[len(node) :] + ("#",))[0] for names, fixed, _ in blocks if names[: len(node)] == node and len(node) > fixed]
            layouts[node][tuple(b for k, b in enumerate(below) if k == 0 or below[k - 1] != b)] += 1
            contents[node][tuple(t for names, fixed, t in blocks if names[: len(node)] == node and len(node) > fixed)] += 1
        features.update({(names, text) for names, _, text in blocks})
        places.update({names for names, _, _ in blocks})

    def share(counts):
        m = sum(counts.values())
        return -sum(c / m * math.log(c / m) for c in counts.values()) / math.log(m)

    low = {n for n, c in contents.items() if sum(c.values()) >= 8 and 0.1 * share(layouts[n]) + 0.9 * share(c) < 0.3}
    often = {(n, t) for (n, t), c in features.items() if c >= 8 and 1 - math.log(c) / math.log(places[n]) < 0.05}
    out = []
    for blocks in read:
        left = [b for b in blocks if not any(b[0][:k] in low for k in range(b[1] + 1, len(b[0]) + 1))] or blocks
        fewer = [b for b in left if (b[0], b[2]) not in often]
        if 2 * sum(len(b[2]) for b in fewer) >= sum(len(b[2]) for b in left):
            left = fewer
        out.append(" ".join(b[2] for b in left))
    return out


@pytest.mark.parametrize("marked", [True, False])
def test_style_tree_against_plain_counts(spark, marked):
    """Random pages of one template: constant, rarely changing and changing parts at several depths."""
    rng = random.Random(7)
    word = lambda n: f"w{rng.randrange(n)}"

    def page(i):
        parts = [f"<h1>Title {i}</h1><p>story {i} {word(10**6)} {word(10**6)} {word(10**6)}</p>"]
        parts += [f"<div class=k{k}><p>{word(n)}</p>" + f"<ul><li>{word(n)}<li>{word(2)}</ul>" * rng.randrange(3) + "</div>" for k, n in enumerate((1, 2, 3, 50))]
        parts += ["<p>Write to us at the desk.</p>"] * (rng.random() < 0.97)
        parts += ["<section class=deep><div><div><span>x</span><b>same</b></div><div>" + word(2) + "</div></div></section>"] * (i % 3 > 0)
        rng.shuffle(parts)
        return "<body>" + ("<article>{}</article>" if marked else "{}").format("".join(parts)) + "</body>"

    pages = [page(i) for i in range(60)] + [None, "", "<p>Write to us at the desk.</p>"]
    pages += [pages[0]] * 5
    got = texts(spark, pages)
    assert got == plain_texts(pages)
    assert any(g != " ".join(t for _, _, t in html_main.runs(p or "")) for g, p in zip(got, pages, strict=True))


def test_a_notice_repeated_in_articles_goes(spark):
    page = "<article><h1>Title {0}</h1><p>The story {0} of the day, long enough to read.</p><p>Subscribe to us.</p><p>End {0}</p></article>"
    got = texts(spark, [page.format(i) for i in range(20)])
    assert got == [f"Title {i} The story {i} of the day, long enough to read. End {i}" for i in range(20)]
    near = "<article><h1>Title</h1><p>" + "A story. " * 9 + "</p><p>Subscribe to us.</p><p>End {0}</p></article>"
    got = texts(spark, [near.format(i) for i in range(20)])  # near copies of one article lose nothing
    assert got == ["Title " + "A story. " * 9 + f"Subscribe to us. End {i}" for i in range(20)]


def test_names_decide_nothing_on_paragraphs_and_headings_of_a_marked_part():
    page = '<article><h2 id="related-work">Related work</h2><p class="notice-period">Notice period</p><div class="ad">x</div></article>'
    assert [t for _, _, t in html_main.runs(page)] == ["Related work", "Notice period"]
    assert html_main.runs('<body><p class="cookie-notice">x</p></body>') == []


def test_whole_table_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        article = r.html[r.html.index("<article") : r.html.index("</article>")]
        blocks = (" ".join(html.unescape(b).split()) for b in re.split("<[^>]*>", article))
        want[r.page_id] = " ".join(b for b in blocks if b)
    got = {r.page_id: r.text for r in html_main.main_text(pages).collect()}
    assert got == want


def test_odd_markup(spark):
    pages = [
        None,
        "",
        "plain &amp; text",
        "<article>A<script>var x='</p><article>no';</script>B</article>after",
        "<body><nav>menu</nav><p>One<p>Two &lt;b&gt; &#233;&nbsp;x<br>y</body>",
        "<main><header><h1>T</h1></header><div class='ad-box'>buy</div><p>text <b>bo</b>ld</p><section id=comments>me too</section></main>",
        '<div title="a > b">kept</div><!-- <p>no</p> --><form>f</form><aside>s</aside><footer>f</footer>',
        "<article><p>open <i>end",
        "<article>" + "<div>" * 2000 + "deep" + "</article>",
        "<p>a\n\t b</p>\n<p> </p><p>c</p>",
        "<article><p>x</p></article>" * 2,
        "<style>p{}</style><title>t</title><p>" + "w " * 100_000,
    ]
    got = texts(spark, pages)
    assert got[:11] == [
        "", "", "plain & text", "AB", "One Two <b> é\xa0x y", "T text bold", "kept", "open end", "deep", "a b c", "x x",
    ]
    assert len(got[11]) == 199_999


def test_branches_alike_on_every_page_go(spark):
    """Entropy alone: nothing in the names says what is noise."""
    page = "<body><div class='x1'>All rights here</div><div class='x2'>Story {} of the day {}</div><div class='x3'>Tel 1</div></body>"
    got = texts(spark, [page.format(i, i * i) for i in range(20)])
    assert got == [f"Story {i} of the day {i * i}" for i in range(20)]
    few = texts(spark, [page.format(i, i) for i in range(3)])
    assert few[0] == "All rights here Story 0 of the day 0 Tel 1"  # too few pages to tell


def test_copies_of_a_page_keep_their_article(spark):
    page = "<body><article><h1>Same</h1><p>story</p><div class=box>Follow the paper</div></article></body>"
    assert texts(spark, [page] * 12) == ["Same story"] * 12
    bare = "<body><div>only branch</div></body>"
    assert texts(spark, [bare] * 12) == ["only branch"] * 12


def test_empty_table(spark):
    assert texts(spark, []) == []


@pytest.mark.parametrize("tag", sorted(html_main.INLINE - html_main.VOID))
def test_inline_noise_ends_with_its_tag(tag):
    """Only what stands inside an inline element that is noise is left out, elements of its name within it included."""
    page = f'<article>one <{tag} class="ad">x <{tag}>y</{tag}> z</{tag}> two <p>three</p></article>'
    assert " ".join(t for _, _, t in html_main.runs(page)) == "one two three"
    plain = "<article>one <i>x</i> two</article>"
    assert [t for _, _, t in html_main.runs(plain)] == ["one x two"]


def test_labels_take_nothing_with_them():
    texts = lambda page: " ".join(t for _, _, t in html_main.runs(page))
    assert texts("<article><label>L</label> text <p>more</p></article>") == "text more"
    assert texts("<body><p>x</p><label>N</label><p>y</p>") == "x y"
    assert texts("<body><p>x <span class=ad>a<p>b</p></span></p><p>y</p>") == "x y"
    assert texts("<body><label>open<p>b</p>") == ""
