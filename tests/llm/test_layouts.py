"""Hosts with pages that are empty or look different."""

from __future__ import annotations

from txnsift.llm import htmltext

STORY = "<div class='top'><p>Our site</p></div><div class='body'><h1>Title {0}</h1><p>Word{0} {0} of the story.</p></div><div class='end'><p>All rights</p></div>"
LISTING = "<div class='head'><p>Our shop</p></div><table><tr><td>Item {0} costs {0} and more</td></tr></table><div class='foot'><p>No returns</p></div>"


def test_odd_pages_leave_the_template_alone(spark):
    rows = [(i, "http://h/", STORY.format(i)) for i in range(40)] + [(i, "http://h/", LISTING.format(i)) for i in range(40, 80)]
    rows += [(90, "http://h/", None), (91, "http://h/", ""), (92, "http://h/", "no elements"), (93, "http://h/", "<b>Error</b><p>404</p>")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in htmltext.extract_text(table).collect()}
    assert [found[i] for i in (7, 50)] == ["Title 7 Word7 7 of the story.", "Item 50 costs 50 and more"]
    assert [found[i] for i in (90, 91, 92, 93)] == ["", "", "no elements", "Error 404"]
