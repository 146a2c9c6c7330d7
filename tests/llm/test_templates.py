"""Templates of hosts: what decides on pages without articles, and a plain recomputation of the classes."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest

from txnsift.llm import htmltext

SCHEMA = "page_id bigint, url string, html string"


def extracted(spark, pages: list[str]) -> list[str]:
    table = spark.createDataFrame([(i, "http://h/", page) for i, page in enumerate(pages)], SCHEMA)
    return [r.text for r in htmltext.extract_text(table).orderBy("page_id").collect()]


def story(i: int) -> str:
    return f"Story {i} is here and tells of word{i}"


@pytest.mark.parametrize("name", ["content comments-open", "social-history", "share-price", "text", "related"])
def test_class_words_do_not_close_what_the_template_opens(spark, name):
    pages = [f"<div class='top'>Site</div><div class='{name}'><p>{story(i)}</p></div>" for i in range(30)]
    assert extracted(spark, pages) == [story(i) for i in range(30)]


def test_repeated_line_after_a_varying_number_of_paragraphs(spark):
    frame = "<div class='top'><p>Site</p></div><div class='content'>{}<p>Tell your friends</p></div><div class='end'><p>All rights</p></div>"
    texts = [[f"{story(i)} part {n}" for n in range(i % 4 + 1)] for i in range(40)]
    pages = [frame.format("".join(f"<p>{t}</p>" for t in own)) for own in texts]
    assert extracted(spark, pages) == [" ".join(own) for own in texts]


def test_reader_comments_are_records_with_a_wording(spark):
    talk = "<div class='one'><div class='who'>Reader {0}</div><div class='say'>I say {0}</div><div class='act'>Answer this</div></div>"
    frame = "<div class='top'><p>Site</p></div><div class='content'><h1>Title {0}</h1><p>{1} {1} {1}</p><div class='below'>{2}</div></div>"
    pages = [frame.format(i, story(i), "".join(talk.format(f"{i}-{n}") for n in range(i % 3))) for i in range(60)]
    assert extracted(spark, pages) == [f"Title {i} {story(i)} {story(i)} {story(i)}" for i in range(60)]


def test_title_outside_the_text_element(spark):
    frame = "<div class='top'><p>Site</p></div><div class='w'><h1>Title {0}</h1><div class='t'><p>{1}</p><p>{1}</p></div></div><div class='end'><p>News {0}</p></div>"
    pages = [frame.format(i, story(i)) for i in range(30)]
    assert extracted(spark, pages) == [f"Title {i} {story(i)} {story(i)}" for i in range(30)]


@pytest.mark.parametrize("name", ["responses", "user-comments", "legal", "topbar", "related-posts", "comment-list"])
def test_words_close_elements_of_pages_without_template(name):
    page = f"<article><h1>T</h1><p>Body</p><section class='{name}'><p>nice one!</p></section></article>"
    assert htmltext.main_text(page, None, frozenset(), {}) == "T Body"


def test_classes_equal_a_plain_recomputation(spark):
    talk = "<div class='one'><div class='who'>Reader {0}</div><div class='act'>Answer this</div></div>"
    frame = "<div class='top'><p>Site</p></div><div class='content'><p>{1}</p>{2}<p>Tell your friends</p></div>"
    pages = [frame.format(i, story(i), "".join(talk.format(f"{i}-{n}") for n in range(i % 3))) for i in range(50)]
    groups = defaultdict(list)
    for page in pages:
        elements = {e[1] for e in htmltext.walk(page, {}) if e[0] == "element" and e[2] <= htmltext.LAYOUT_DEPTH}
        groups[tuple(sorted(elements))].append(page)
    expected = set()
    for own in groups.values():
        vectors, parents = defaultdict(lambda: [0] * len(own)), {}
        for at, page in enumerate(own):
            counts = Counter()
            for e in htmltext.walk(page, {}):
                token = (e[1], None) if e[0] == "element" else (e[1][-1], e[2])
                counts[token] += 1
                parents[token] = (e[3] if e[0] == "element" else e[1][-1], None)
            for token, n in counts.items():
                vectors[token][at] = n
        texts = {t for t, v in vectors.items() if t[1] and v == [1] * len(own) and len(own) >= htmltext.TEXT_PAGES}
        records = set()
        classes = defaultdict(set)
        for token, vector in vectors.items():
            if vector != [1] * len(own) and sum(1 for n in vector if n) >= htmltext.TEXT_PAGES:
                classes[tuple(vector)].add(token)
        for tokens in classes.values():
            tops = [t for t in tokens if parents[t] not in tokens]
            wording = {t for t in tokens if t[1]}
            if len(tokens) >= htmltext.CLASS_TOKENS and len(tops) == 1 and wording and not tops[0][1]:
                records.add(tops[0][0])
                texts |= wording
        expected.add((frozenset(htmltext._text_token(*t) for t in texts), frozenset(records)))
    table = spark.createDataFrame([("h", i, page) for i, page in enumerate(pages)], "host string, page_id bigint, html string")
    [found] = htmltext.deduce_templates(table).collect()
    assert {(frozenset(t["texts"]), frozenset(t["records"])) for t in found["templates"] if t["layout"]} == expected
    assert any(records for _, records in expected)
