"""Main text: planted pages, noise by element and by hints, broken markup, linear time."""

import time

from quarry.llm import html_main as H

PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body>%s</body></html>"
ARTICLE = "<article><h1>Head &amp; line</h1><p>First   paragraph&nbsp;here\nwith words.</p><p><b>Second<br>one</b><p>Third</article>"
TEXT = "Head & line\nFirst paragraph here with words.\nSecond one\nThird"


def test_article_without_what_surrounds_it():
    noise = '<nav><ul><li><a href="/x">Menu</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy this now, it is cheap and good for you.</div>'
    tail = '<aside>more</aside><section id="comments"><p>I liked it a lot, thank you for writing.</p></section><form><input value="q">find</form><footer>&copy; all rights</footer>'
    assert H.main_text(PAGE % (noise + ARTICLE + tail)) == TEXT


def test_notice_and_unclosed_advert():
    assert H.main_text(PAGE % ('<div class="cookie-notice">We use cookies on this site, accept all of them.</div><div class="ad">never closed' + ARTICLE)) == TEXT


def test_density_without_semantic_elements():
    short = "".join(f"<div><a href='#'>link {k}</a></div>" for k in range(12))
    body = "".join(f"<p>{'words of the story run on ' * 8}{k}</p>" for k in range(6)) + "<p>End.</p>"
    got = H.main_text(PAGE % f"<div>{short}</div><div>{body}</div><div>{short}</div>")
    assert got.startswith("words of the story") and got.endswith("5\nEnd.") and "link" not in got


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<script>x") == H.main_text("<nav>a</nav>") == ""
    assert H.main_text("just text < 3 & more") == "just text < 3 & more"
    assert H.main_text("<article><p>cut &am") == "cut &am"
    assert H.main_text("<p title='a>b'>kept</p>") == "kept"


def test_time_is_linear():
    for piece in ("<", "<a href='", "<div>", "</p>", "<!--", "<p class=\"", "<b><i>"):
        began = time.perf_counter()
        H.main_text(piece * 40_000)
        assert time.perf_counter() - began < 5, piece
    began = time.perf_counter()
    H.main_text("<article>" + f"<p>{'words of the story run on ' * 3}</p><p>x</p><p>y</p><p>z</p>" * 20_000 + "</article>")  # many regions
    assert time.perf_counter() - began < 5


def test_all_of_a_sectioned_article_and_of_divided_text():
    first, last = [f"<p>{f'part {k} of the story runs on ' * 12}</p>" for k in range(2)], [f"<p>{f'end {k} of the story runs on ' * 10}</p>" for k in range(2)]
    few = "".join(f"<li>item{k}</li>" for k in range(5))
    want = [f"part {k}" for k in range(2)] + [f"item{k}" for k in range(5)] + [f"end {k}" for k in range(2)]
    got = H.main_text(PAGE % f"<article><section>{''.join(first)}</section><section><ul>{few}</ul></section><section>{''.join(last)}</section></article>")
    assert [t[: len(w)] for t, w in zip(got.split("\n"), want, strict=True)] == want
    got = H.main_text(PAGE % f"<div>{''.join(first)}</div><div><ul>{few}</ul></div><div>{''.join(last)}</div>").split("\n")
    assert [t[:6].strip() for t in got] == ["part 0", "part 1", "end 0", "end 1"]
    got = H.main_text(PAGE % f"<main><div>{few}</div><article>{''.join(first)}<ul>{few}</ul>{''.join(last)}</article></main>").split("\n")
    assert len(got) == 9 and got[0].startswith("part 0")


def test_inline_elements_that_are_left_out_keep_the_text_before_them():
    for inner in ("<svg><title>x</title></svg>", "<button>press</button>", "<span hidden>secret</span>", '<span class="ad">buy</span>', '<span class="ad"><div>buy</div></span>'):
        assert H.main_text(f"<article><p>text {inner} after</p></article>") == "text after"


def test_names_do_not_take_the_article():
    story = "".join(f"<p>{f'part {k} of the story runs on ' * 8}</p>" for k in range(4))
    for name in ("has-sidebar", "notice-board"):
        assert H.main_text(PAGE % f'<div class="{name}"><h1>Head</h1>{story}<p>End.</p></div>').endswith("\nEnd.")
        assert H.main_text(PAGE % f'<div class="{name}">{story}<p>End.</p></div>').endswith("\nEnd.")
        assert H.main_text(PAGE % f'<div class="{name}">{ARTICLE}<div class="sidebar">{story}</div></div>') == TEXT
    comments = f'<div id="comments">{story * 3}</div>'
    assert "story" not in H.main_text(PAGE % f"<div><h1>Head</h1><p>{'the article itself is here and it is long enough ' * 3}</p></div>{comments}")
    assert H.main_text(PAGE % (ARTICLE + '<div class="comments"><article class="comment"><h1>No</h1>' + story + "</article></div>")) == TEXT


def test_menu_and_copyright_without_semantic_elements():
    story = [f"part {k} of the story runs on " * 8 for k in range(4)]
    menu = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul>"
    page = f"<div>{menu}<h1>Head</h1>{''.join(f'<p>{t}</p>' for t in story)}<p>End.</p>{menu}<p>Copyright 2024 by the paper</p></div>"
    assert H.main_text(PAGE % page) == "\n".join(["Head", *(t.strip() for t in story), "End."])


def test_references_are_decoded_within_their_text():
    assert H.main_text("<article><p>a&am<b>p;</b> &lt;b&gt; &eacute;&#x41;</p></article>") == "a&amp; <b> éA"


LONG = [f"{w} paragraph of the story, which is long enough to be told apart from what stands around it, as such paragraphs are." for w in ("first", "second")]
STORY = "".join(f"<p>{t}</p>" for t in LONG)


def test_density_outweighs_names_forms_and_open_menus():
    body = "\n".join(LONG)
    assert H.main_text(PAGE % f'<header><h1>Site</h1></header><div class="content has-sidebar">{STORY}</div>') == body
    for name in ("notice-board", "page side-by-side", "page with-nav"):
        assert H.main_text(PAGE % f'<h1>Head</h1><div class="{name}">{STORY}</div>').endswith(body)
    assert H.main_text(PAGE % f'<form id="aspnetForm"><div>{STORY}</div></form>') == body
    assert H.main_text(PAGE % f'<div>{STORY}</div><form><p>Tell us what you think of it, and we will write to you as soon as we possibly can.</p></form>') == body
    for menu in ("nav", "aside", "menu"):
        assert H.main_text(PAGE % f"<{menu}><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul><div>{STORY}</div>") == body
    assert H.main_text(PAGE % f"<div>{STORY}</div><nav><a href='/'>Home</a> open to the end") == body
    side = "".join(f"<p>{'other things that you may want to read about today ' * 2}{k}</p>" for k in range(5))
    assert H.main_text(PAGE % f'<div><h1>Head</h1>{STORY}</div><div class="sidebar">{side}</div>') == "Head\n" + body


def test_two_articles_comment_lists_and_cookies():
    body = "\n".join(LONG)
    more = "<p>" + "a longer one " * 40 + "</p>"
    assert H.main_text(PAGE % f"<article>{STORY}</article><article>{STORY}{more}</article>").startswith(body)
    assert H.main_text(PAGE % f"<article>{STORY * 3}</article><article><p>Teaser</p></article>") == "\n".join([body] * 3)
    for name in ("commentlist", "comment-list", "comments"):
        assert H.main_text(PAGE % f'<article>{STORY}<ol class="{name}"><li>{LONG[0]}</li></ol></article>') == body
    assert H.main_text(PAGE % f'<article class="commentary">{STORY}</article>') == body
    notice = "<div>We use cookies to make this site better; accept all of them or choose some.</div>"
    assert H.main_text(PAGE % f"{notice}<div>{STORY}</div>") == H.main_text(PAGE % f"<div>{STORY}</div>{notice}") == body
    assert "cookies" in H.main_text(PAGE % f"<article>{STORY}<p>We use cookies in this recipe.</p></article>")


def test_every_page_comes_through_the_regions(spark, monkeypatch):
    count = []
    real = H.cores
    monkeypatch.setattr(H, "cores", lambda sizes: count.append(1) or real(sizes))
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    assert all(map(H.main_text, pages)) and len(count) == len(pages)


def test_extract_gives_one_row_per_page(spark):
    pages = [(1, "u", PAGE % ARTICLE, 7), (1, "u", PAGE % ARTICLE, 7), (2, None, None, 7), (3, "v", "", 7), (None, "w", "<p>x " + "long " * 300_000 + "</p>", 7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text long").repartition(3)
    got = sorted(H.extract(df).collect(), key=str)
    long = " ".join(["x"] + ["long"] * 300_000)
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, None, "", 0), (3, "v", "", 0), (None, "w", long, len(long))], key=str)
    assert H.extract(df.limit(0)).count() == 0
