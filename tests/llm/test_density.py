"""Main text of made-up pages of many layouts, and of broken ones."""

import pytest

from pageloom.llm.density import extract_pages, main_text

PARAGRAPHS = [f"Paragraph {i} has a fair number of words, so that its text is dense enough to count as such." for i in range(5)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(9)) + "</ul>"
TEXT = "\n".join(PARAGRAPHS)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<html><head><title>T</title><style>p{{}}</style></head><body><nav>{MENU}</nav><article><h1>Head</h1>{BODY}</article><footer>(c)</footer>", f"Head\n{TEXT}"),
        (f'<body><div id="menu">{MENU}</div><div class="content">{BODY}</div><div class="sidebar">{MENU}</div>', TEXT),
        (f"<body><div>{MENU}</div><div><div>{BODY}</div></div><div>{MENU}</div>", TEXT),
        (f'<main><p>{PARAGRAPHS[0]}</p></main><div class="cookie-notice">We use cookies. {TEXT}</div>', PARAGRAPHS[0]),
        (f'<article>{BODY}<section id="comments"><p>{TEXT}</p></section><form>{TEXT}</form></article>', TEXT),
        (f'<article>{BODY}<aside>{TEXT}</aside><script>var a = "</p><p>x";</script><!-- <p>hidden</p> --></article>', TEXT),
        (f"<article><header><h1>Head &amp; more</h1></header>{BODY}</article>", f"Head & more\n{TEXT}"),
        ("<article><p>a<b> b</b>\n\t c<br>d<p>e &lt;p&gt; &eacute;&#x41;&nbsp;f</article>", "a b c d\ne <p> éA f"),
        ("<article><ul><li>one<li>two <i>three</i></ul><table><tr><td>x<td>y</table></article>", "one\ntwo three\nx\ny"),
        ('<article><p title="a > b">kept</p><p class=ad>gone</p></article>', "kept"),
        ("no markup at all", "no markup at all"),
        ("a < b and 1 <2 <", "a < b and 1 <2 <"),
        ('<p class="never closed>text', "text"),
        ("<!-- never closed <p>x</p>", ""),
        ("<script>never closed", ""),
        ("", ""),
        (None, ""),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ],
)
def test_layouts(page, text):
    assert main_text(page) == text


def test_very_long_page():
    assert main_text("<article>" + BODY * 4000 + "</article>").count("\n") == 5 * 4000 - 1
    assert main_text("<" * 200_000 + "a") == "<" * 199_999  # the last one begins a tag that never ends


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, f"<article>{BODY}</article>", "u"), (1, None, "u"), (None, "", None)], "page_id long, html string, text string")
    out = extract_pages(pages)
    assert out.columns == ["page_id", "html", "text"] and sorted(r.text for r in out.collect()) == ["", "", TEXT]
    assert extract_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["content has-sidebar", "layout no-sidebar", "post comments-open", "search-results", "side"])
def test_a_name_alone_drops_no_page(name):
    part = f'<div class="sidebar"><p>{PARAGRAPHS[0]}</p></div>'
    assert main_text(f'<div class="{name}"><article>{BODY}</article>{part}</div>') == TEXT
    assert main_text(f'<div class="{name}"><div>{BODY}</div>{part}</div><p>(c)</p>') == TEXT
    assert main_text(f'<article><div class="{name}">{BODY}</div></article>') == TEXT


@pytest.mark.parametrize("comment", ['class="comment even"', 'id="comment-12" class="comment-body"'])
def test_comments_in_articles(comment):
    said = f"<article {comment}><p>{PARAGRAPHS[0]}</p></article>"
    assert main_text(f"<article>{BODY}{said * 4}</article>") == TEXT
    assert main_text(f"<main>{BODY}<div>{said * 9}</div></main>") == TEXT
    assert main_text(f"<article>{BODY}</article>{said * 9}") == TEXT
    assert main_text(f"<div>{BODY}</div>{said}{said}") == TEXT
    assert main_text(f'<article>{BODY}</article><div id="comments"><article class="comment-body"><p>{TEXT}</p></article></div>') == TEXT


def test_bare_text_beside_the_best_part():
    inner = f"<div>{BODY}</div>"
    assert main_text(f"<div>Lead<br>text {inner}</div>") == f"Lead text\n{TEXT}"
    assert main_text(f"<body>Top<div>Lead <b>in</b> bold{inner}After</div>End") == f"Top\nLead in bold\n{TEXT}\nAfter\nEnd"
    assert main_text(f"<div><a href=x>Home</a> | <a href=y>About this</a>{inner}</div>") == TEXT


def test_articles_side_by_side():
    teaser = '<article><a href="x">Read more of this</a></article>'
    assert main_text(f"<div><article>{BODY}</article><article>{BODY}{BODY}</article>{teaser}</div>") == f"{TEXT}\n{TEXT}\n{TEXT}"
