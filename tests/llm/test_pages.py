from __future__ import annotations

import pytest

from loanweave.llm import pages
from loanweave.llm.pages import main_text

STORY = "It began late, and slowly. Then, all at once, it was over; nobody knew why."


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<nav><ul><li><a href=/a>Home</a></ul></nav><article><h1>Head</h1><p>{STORY}</p></article><footer>&copy; X</footer>", f"Head\n{STORY}"),
        (f"<div class='side-bar sidebar'><p>{STORY}</p></div><div id=content><p>{STORY}</p><p>More, of it.</p></div>", f"{STORY}\nMore, of it."),
        (f"<article><header><h1>Head</h1><span>by me</span></header><p>{STORY}<br>A&amp;B&nbsp; C</p><aside>See also</aside></article><div class=comments><p>{STORY}</p></div>", f"Head\n{STORY} A&B C"),
        (f"<main><p><b>Bold<p>{STORY}<form><p>{STORY}</p></form><script>var a='<p>no</p>';</script><!-- <p>no</p> --></main>", f"Bold\n{STORY}"),
        (f"<div class=cookie-notice>{STORY}</div><article><ul><li>One thing<li>Other thing</ul><p>{STORY}</p><table><tr><td>a<td>b</table></article>", f"One thing\nOther thing\n{STORY}\na\nb"),
        ("", ""),
        ("<nav>Only a menu</nav>", ""),
        (STORY, STORY),
        (f"<article><p>{STORY}</p><div class='ad'>{STORY}</div><div hidden>{STORY}</div><p>&lt;b&gt; &#233;&#x4e2d;</p></article>", f"{STORY}\n<b> é中"),
    ],
)
def test_articles(body, text):
    assert main_text(f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>") == text


def test_odd_pages_end():
    assert main_text(None) == "" and main_text("<") == "<" and main_text("<p") == "" and main_text("</p></div>") == ""
    deep = "<div>" * 20_000 + STORY + "<a href='x>" * 50
    assert main_text(deep).startswith(STORY)


def test_rows(spark):
    rows = [(1, "u", f"<article>{STORY}</article>"), (1, "u", f"<article>{STORY}</article>"), (None, None, None), (2, "v", ""), (3, "w", f"<article>{STORY * 30_000}</article>")]
    found = pages.extract(spark.createDataFrame([(*r, 7) for r in rows], "page_id long, url string, html string, text int"))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(
        [(1, "u", STORY, len(STORY))] * 2 + [(None, None, "", 0), (2, "v", "", 0), (3, "w", STORY * 30_000, 30_000 * len(STORY))], key=repr
    )
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


LONG = " ".join([STORY] * 20)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        (f"<div id=content><h1>Head</h1><p class=lead>{STORY}</p><div class=body><p>{LONG}</p><p>{LONG}</p></div></div>", f"Head\n{STORY}\n{LONG}\n{LONG}"),
        (f"<article><h2>One</h2><p>{STORY}</p></article><article><h2>Two</h2><p>{STORY}</p></article>", f"One\n{STORY}\nTwo\n{STORY}"),
        (f"<main><p>{STORY} {STORY}</p><article><p>{STORY}</p><p>{STORY} {STORY}</p></article></main>", f"{STORY} {STORY}\n{STORY}\n{STORY} {STORY}"),
        *((f"<div class='{name}'><article><h1>Head</h1><p>{STORY}</p></article><div class=sidebar><p>{STORY[:40]}</p></div></div>", f"Head\n{STORY}") for name in ("layout has-sidebar", "no-comments", "elementor-widget")),
        (f"<div class='no-comments'><p>{LONG}</p></div>", LONG),
        (f"<div class=text><h1>Head</h1><p>{STORY}</p></div><div class=comments><p>{LONG}</p><p>{STORY}</p></div><p>{STORY} {STORY}</p>", f"Head\n{STORY}\n{STORY} {STORY}"),
    ],
)
def test_nothing_of_the_article_is_lost(body, text):
    assert main_text(f"<html><head><title>T</title></head><body>{body}</body></html>") == text
