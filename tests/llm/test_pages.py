"""Main text of hand-made pages."""

import time

import pytest

from tallywood.llm import tag_paths


def lines(k, n):
    return [f"Part {k}, sentence {i}, with some words, and an end." for i in range(n)]


def p(k, n):
    return "".join(f"<p>{x}</p>" for x in lines(k, n))


GOLD = {
    "menu, title, advert, script": ('<title>t</title><nav><a>Home</a></nav><article><h1>Head</h1><p>One,  two; <b>three</b>.<p>A &amp; B<br>c.</article><div class="ad">Buy, now.</div><script>var x="</p>"</script>', ["Head", "One, two; three.", "A & B c."]),
    "a listed word on the body's wrapper": (f"<body><nav>Home</nav><div class='share-of-market'>{p('a', 6)}</div></body>", lines("a", 6)),
    "comments": (f"<body><article><h1>Head</h1>{p('a', 6)}</article><div class=comments>{p('b', 6)}</div></body>", ["Head", *lines("a", 6)]),
    "comments in the article": (f"<body><article><h1>Head</h1>{p('a', 6)}<section id=comments>{p('b', 5)}</section></article></body>", ["Head", *lines("a", 6)]),
    "list between": (f"<article>{p('a', 2)}<ul><li>One thing<li>Another</ul>{p('b', 2)}</article>", [*lines("a", 2), "One thing", "Another", *lines("b", 2)]),
    "list of sentences at the end": (f"<article>{p('a', 2)}<ul><li>One thing, with all that goes with it.<li>Another, as it is, and so on.</ul></article>", [*lines("a", 2), "One thing, with all that goes with it.", "Another, as it is, and so on."]),
    "calls at the end": (f"<article>{p('a', 3)}<ul><li>Buy now<li>Read next</ul></article>", lines("a", 3)),
    "link between": (f"<article>{p('a', 2)}<p><a href=x>Read this too</a></p>{p('b', 2)}</article>", [*lines("a", 2), *lines("b", 2)]),
    "link in a sentence": (f"<article><p>With a <a href=x>link, so</a> in it, and more words.</p>{p('b', 2)}</article>", ["With a link, so in it, and more words.", *lines("b", 2)]),
    "two articles": (f"<body><nav>Home</nav><main><article>{p('a', 6)}</article><article>{p('b', 4)}</article></main></body>", [*lines("a", 6), *lines("b", 4)]),
    "divs only": (f"<div id=menu>Home</div><div id=post><h1>Head</h1><div class=lead><p>The lead, as it is, in short.</p></div><div class=body>{p('c', 8)}</div></div>", ["Head", "The lead, as it is, in short.", *lines("c", 8)]),
    "modifiers": (f"<body><div class='page-with-comments has-sidebar'>{p('d', 3)}<div class='left-sidebar'>Other, things.</div></div></body>", lines("d", 3)),
    "notice and footer": (f"<div class='cookie-notice'>We use cookies, as all do. Accept.</div><div class=content>{p('a', 3)}</div><footer>Imprint, etc.</footer>", lines("a", 3)),
    "sidebar": (f"<div class=wrap><div class=content>{p('a', 4)}</div><div class='sidebar'><p>News, of the day, in brief.</p><p>More, of it, all day.</p></div></div>", lines("a", 4)),
    "aside": (f"<article>{p('a', 2)}<aside><p>By the way, this is aside.</p></aside>{p('b', 2)}</article>", [*lines("a", 2), *lines("b", 2)]),
    "form": (f"<article>{p('a', 2)}<form><label>Your name, please.</label><input></form></article>", lines("a", 2)),
    "table": (f"<article>{p('a', 2)}<table><tr><td>Year<td>Sum<tr><td>1999<td>12</table>{p('b', 2)}</article>", [*lines("a", 2), "Year", "Sum", "1999", "12", *lines("b", 2)]),
    "references": ("<article><p>A &amp; B, &#233;t&eacute;, &lt;tag&gt;.<br>Next\n line, here.</p></article>", ["A & B, été, <tag>. Next line, here."]),
    "title only": ("<html><head><title>T</title></head><body></body></html>", []),
    "no tags": ("Just text, 1 < 2, no tags at all.", ["Just text, 1 < 2, no tags at all."]),
    "hidden": (f"<body>{p('a', 3)}<p hidden>Not, to be seen.</p><div style='display: none'><p>Nor this, at all.</p></div></body>", lines("a", 3)),
    "headings": (f"<article><h1>Head</h1>{p('a', 2)}<h2>Second</h2>{p('b', 2)}</article>", ["Head", *lines("a", 2), "Second", *lines("b", 2)]),
    "quotation": (f"<article>{p('a', 2)}<blockquote><p>Quoted, as it was said, by them.</p></blockquote>{p('b', 1)}</article>", [*lines("a", 2), "Quoted, as it was said, by them.", *lines("b", 1)]),
    "headers": (f"<header><p>Site, the one.</p></header><article><header><h1>Head</h1></header>{p('a', 2)}</article>", ["Head", *lines("a", 2)]),
    "advert between": (f"<article>{p('a', 2)}<div class=ad>Buy this, now.</div>{p('b', 2)}</article>", [*lines("a", 2), *lines("b", 2)]),
    "markup comments": (f"<article>{p('a', 2)}<!-- <p>Not, this one.</p> --><script>var x='<p>a, b.</p>'</script></article>", lines("a", 2)),
    "stories": (f"<div class=content>{p('a', 3)}</div><div class=related><ul><li><a href=1>An older story, told again</a><li><a href=2>Another, as well</a></ul></div>", lines("a", 3)),
    "quoted signs": (f"<article><p title='a > b' data-x=\"</p>\">One, two, three.</p>{p('a', 2)}</article>", ["One, two, three.", *lines("a", 2)]),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", GOLD)
def test_gold(name):
    source, want = GOLD[name]
    assert tag_paths.main_text(source).split("\n") == (want or [""])


def test_a_small_block_does_not_outweigh_its_neighbours():
    """An advert of one sentence beside short paragraphs."""
    source = f"<div class=ad>Nicht aulich für sch erüver enau sch der.</div><article>{''.join(f'<p>Short {i}, so.</p>' for i in range(8))}</article>"
    assert tag_paths.main_text(source).split("\n") == [f"Short {i}, so." for i in range(8)]


@pytest.mark.parametrize("soup", ["<b>x, y. ", "<div>x, y. ", "<p><b>x, y. ", "<x \"' a=\">x, y. ", "<li>x, y. ", "</b><a href='>x, y. "])
def test_time_grows_with_the_page(soup):
    began = time.perf_counter()
    tag_paths.main_text(soup * (1_000_000 // len(soup)))
    assert time.perf_counter() - began < 20


def test_rows(spark):
    rows = [(1, "u", "<p>One, two.</p>"), (1, "u", "<p>One, two.</p>"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in tag_paths.extract(pages).collect()), key=repr)
    assert got == sorted([(1, "u", "One, two.", 9)] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=repr)
    assert tag_paths.extract(pages.limit(0)).count() == 0
