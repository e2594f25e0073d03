"""Surges and dives of operator 4: a plain version, what they decide on the given pages, and pages whose names mislead."""

from __future__ import annotations

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import html_text

SF = "/root/testdata/sf0.001"
STORY = [f"Paragraph {i} of the story goes on and on, and says what happened on day {i} of the journey to the sea." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in STORY)
MENU = '<nav><a href="/">Home</a> <a href="/x">News</a></nav>'


def plain_stretches(sizes):
    """Lines whose window, from them on, has text, in runs."""
    full = [any(sizes[j] for j in range(i, min(i + html_text.WINDOW, len(sizes)))) for i in range(len(sizes))]
    runs, i = [], 0
    while i < len(full):
        j = i
        while j < len(full) and full[j]:
            j += 1
        if j > i:
            runs.append((i, j, max(sum(sizes[k : k + html_text.WINDOW]) for k in range(i, j))))
        i = max(j, i + 1)
    return runs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([0, 0, 0, 0, 1, 2.5, 40, 900]), max_size=40))
def test_stretches(sizes):
    assert html_text.stretches(sizes) == plain_stretches(sizes)


def test_the_step_decides_on_the_given_pages():
    pages = duckdb.sql(f"select html from '{SF}/pages.parquet'").fetchall()
    changed = [h for (h,) in pages if [x.text for x in html_text.lines(h) if x.text] != html_text.between_surges(html_text.lines(h))]
    assert len(changed) == len(pages)  # without it menus, adverts and footers would be in the text


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<div>{BODY}</div><article><p>A teaser of another story.</p></article></body>",
        f"<body>{MENU}<article>{BODY.replace('<p>Paragraph 2', '<p class=notice>Paragraph 2')}</article></body>",
        f"<body>{MENU}<article>{BODY.replace('<p>Paragraph 5', '<p class=alert>Paragraph 5')}</article></body>",
        f"<body>{MENU}<article>{BODY.replace('<p>Paragraph 0', '<section id=promotion><p>Paragraph 0').replace('<p>Paragraph 1', '</section><p>Paragraph 1')}</article></body>",
        f"<body>{MENU}<article>{BODY.replace('<p>Paragraph 3', '<section id=login><p>Paragraph 3').replace('<p>Paragraph 4', '</section><p>Paragraph 4')}</article></body>",
        f"<body>{MENU}<div class='widget'>{BODY}</div><footer>All rights reserved by us.</footer></body>",
    ],
)
def test_no_part_of_the_story_is_lost(page):
    found = html_text.main_text(page).split("\n")
    assert [x for x in found if x.startswith("Paragraph")] == STORY
    assert not {"Home News", "All rights reserved by us."} & set(found)


def test_what_is_no_article_stays_out():
    out = '<div class="ad">Buy one of these now, they are on sale in all of our shops.</div><div class="cookie-notice">We use cookies.</div><aside>More stories of this week.</aside>'
    comments = f'<div id="comments">{"<p>I have read this and liked it very much, as did all my friends.</p>" * 40}</div>'
    page = f"<body>{MENU}{out}<article><h1>Title</h1>{BODY}{out}<p>The end.</p></article><div>Read on: one line of a box without a name.</div>{comments}<footer>© us</footer></body>"
    assert html_text.main_text(page).split("\n") == ["Title", *STORY, "The end."]
    assert html_text.main_text(f"{MENU}<footer>© 2024</footer>{comments}") == ""


def test_query_gives_each_page_its_text(spark):
    want = {i: html_text.main_text(h) for i, h in duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()}
    got = html_text.op4_html_text(spark, SF).collect()
    assert {r.page_id: (r.text, r.n_chars) for r in got} == {i: (t, len(t)) for i, t in want.items()}
