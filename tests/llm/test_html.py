"""Templates decide what the main text is; any text is read as HTML."""

import random
import time

from tessera.llm import htmltext


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_text_goes_from_articles(spark):
    rows = []
    for tag in ("article", "main", "div"):
        body = f"<{tag}><h1>Title {{0}}</h1><p>Tell your friends.</p><p>Story {{0}} begins.</p><div class=x>Read on tomorrow.</div></{tag}>"
        rows += [(len(rows) + i, f"https://{tag}.example/{i}", f"<html><body>{body.format(i)}</body></html>") for i in range(6)]
    copies = "<article><p>Same everywhere.</p><p>To the end.</p></article>"
    rows += [(100 + i, f"https://copies.example/{i}", copies) for i in range(6)]
    got = extracted(spark, rows)
    assert all(got[6 * k + i] == f"Title {i}\nStory {i} begins." for k in range(3) for i in range(6))
    assert all(got[100 + i] == "Same everywhere.\nTo the end." for i in range(6))


def test_template_alone_tells_the_text_of_bare_divs(spark, monkeypatch):
    """No tag and no class says what is what: only what the host's pages share."""
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    rows, want = [], {}
    for i in range(8):
        paragraphs = [line(rng.randint(12, 20)) for _ in range(rng.randint(3, 6))]
        page = (
            "<body><div class=a1><div>Home</div><div>Contact us</div></div><div class=a2>We use biscuits on this site.</div>"
            f"<div class=a3>{line(3)}</div><div class=a4><div class=a5>{''.join(f'<div class=a6>{x}</div>' for x in paragraphs)}</div></div>"
            "<div class=a7>All rights reserved.</div></body>"
        )
        rows.append((i, f"https://bare.example/{i}", page))
        want[i] = "\n".join(paragraphs)
    assert extracted(spark, rows) == want
    monkeypatch.setattr(htmltext, "templates", lambda parsed: parsed.selectExpr("host", "cast(null as array<struct<keys: bigint, class: bigint, place: double>>) as template").distinct())
    alone = extracted(spark, rows)
    assert all("Home" in t and "biscuits" in t and "All rights reserved." in t for t in alone.values())


def test_template_text_goes_wherever_it_stands_on_a_page(spark):
    page = "<body><div class=p><p>Read our paper.</p><p>Story {0} begins and goes on for so long that it outweighs what stands around it by far.</p><p>Try it free.</p><p>Read our paper.</p><p>Try it free.</p></div></body>"
    assert extracted(spark, [(i, f"https://r.example/{i}", page.format(i)) for i in range(5)])[3] == "Story 3 begins and goes on for so long that it outweighs what stands around it by far."


def test_copies_with_an_edit_keep_their_text(spark):
    own = "".join(f"<p>Paragraph number {k} of the text.</p>" for k in range(5))
    rows = [(i, f"https://c.example/{i}", f"<body><nav>Menu</nav><article>{own}<p>Edit {i}.</p></article></body>") for i in range(6)]
    assert extracted(spark, rows)[3] == "\n".join([*[f"Paragraph number {k} of the text." for k in range(5)], "Edit 3."])


def test_words_of_a_layout_do_not_hide_the_article(spark):
    page = (
        "<body class='has-sidebar'><div class='layout sidebar-left'><div class='widget-area'><article><p>Text {0} here.</p><div class='comment'>Nice {0}.</div></article></div>"
        "<div class='sidebar'><p>Side {0}.</p></div></div></body>"
    )
    rows = [(i, f"https://l.example/{i}", page.format(i)) for i in range(5)] + [(9, "https://alone.example/", page.format(9))]
    assert extracted(spark, rows) == {i: f"Text {i} here." for i in (0, 1, 2, 3, 4, 9)}


def test_teasers_in_articles_are_not_the_text(spark):
    page = "<body><div class=post><h1>Head {0}</h1><p>{1}</p></div><div class=related><article><p>Teaser {0}</p></article></div></body>"
    rows = [(i, f"https://t.example/{i}", page.format(i, f"long text {i} " * 20)) for i in range(5)]
    assert extracted(spark, rows)[2] == "Head 2\n" + ("long text 2 " * 20).strip()


def test_malformed_pages_are_read(spark):
    pages = {
        "<![x[ <p>after": "after", "<![foo bar><p>text": "text", "a < b & c &amp; d &#x41;": "a < b & c & d A", "<!-- open <p>x": "", "<script>p</p>": "", "": "", "plain": "plain",
        "<p title=\"x>y": "y", "<p>one<p>two</div></p>": "one\ntwo", "<head><title>T<b></title><p>body without end of head": "body without end of head", "</p></b>": "", "<": "<", "<p": "", "x<p hidden>gone</p>y": "x\ny",
        "<table><tr><td>a<td>b<tr><td>c</table>d": "a\nb\nc\nd", "<ul><li>x<li>y<ul><li>z</ul></ul>": "x\ny\nz", "a<br>b\n c&nbsp;d": "a b c d", "<p>e<span class=ad>buy</span>f</p>": "ef",
    }
    rows = [(i, f"https://h{i}.example/", html) for i, html in enumerate(pages)] + [(100, None, None)]
    assert extracted(spark, rows) == {i: t for i, t in enumerate(pages.values())} | {100: ""}


def test_work_grows_with_the_length_only():
    for unit in ("<div>", "<b>", "<p><li><ul>", '<a x="', "<p x='", "<svg>", "<!--", "<table><tr><td>", "<li>", "</div>", "<![x["):
        took = []
        for n in (10_000, 40_000):
            began = time.process_time()
            page = htmltext.Page(unit * n + "deep")
            took.append(time.process_time() - began)
        assert took[1] < 16 * took[0] + 0.5 and len(page.blocks) <= 1


def test_nothing_and_repeats(spark):
    assert extracted(spark, []) == {}
    docs = spark.createDataFrame([(1, "u", "<p>x", "t", 3)] * 2 + [(None, None, None, None, None)], "page_id long, url string, html string, text string, keys int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in htmltext.extract(docs).collect()) == [(0, "", 0), (1, "x", 1), (1, "x", 1)]


def test_very_long_pages(spark):
    text = "word " * 300_000
    got = extracted(spark, [(1, "https://x.example", f"<article><p>{text}</p></article>"), (2, "https://x.example", "<div>" * 50_000 + "deep")])
    assert got == {1: text.strip(), 2: "deep"}
