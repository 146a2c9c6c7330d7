"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from txnsift.llm import ann, chat, decontaminate, htmltext, langid, licenses, mixing, queries, simhash, tokenfile, urlfilter

LONG = "the long road of words and more words " * 40_000
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside, as further columns.
CLASHES = "fp int, id int, size int, mix int, block int, at int, source_size int, target int, shards int, rank int, n int"


def odd_documents(spark):
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (None, "no id here", "en", "a", 10),
        (None, "no id here", "en", "a", 10), (4, "twice the same row", "en", "b", 18), (4, "twice the same row", "en", "b", 18),
        (4, "same id, other text", "de", None, 19), (5, "12345 !!! ???", None, "b", 13), (6, LONG, "en", "b", len(LONG)),
        (7, "ein Haus und der Baum", "de", "é", 21), (8, "ein Haus und der Baum", "de", "é", 21), (9, "x", "fr", "", 1),
        (10, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 ﷽ ñ \u0000 \ud7ff", "es", "b", 9),
    ]
    table = spark.createDataFrame(rows, DOCS)
    return table.select("*", *[F.lit(i).alias(c.split()[0]) for i, c in enumerate(CLASHES.split(", "))])


def benchmark(spark, rows=((1, "twice the same row"), (None, "no id here"), (3, None), (4, ""), (5, "--"))):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


@pytest.fixture(scope="module")
def odd(spark, folder):
    return folder(documents=odd_documents(spark), benchmark=benchmark(spark))


@pytest.fixture(scope="module")
def empty(spark, folder):
    return folder(
        documents=odd_documents(spark).limit(0),
        benchmark=benchmark(spark).limit(0),
        pages=spark.createDataFrame([], "page_id bigint, url string, html string"),
        embeddings=spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"),
        conversations=spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"),
    )


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(name, run, empty):
    assert len(run(name, empty)) == (1 if name.startswith("op5_") else 0)


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_language_of_odd_rows(run, odd):
    found = run("op1_language_id", odd)
    assert len(found) == 14
    und = found[found.lang_pred == langid.UNKNOWN]
    assert sorted(und.doc_id.tolist()) == [1, 2, 3, 5] and (und.score == 0).all()


def test_language_without_training_rows(spark):
    table = odd_documents(spark).withColumn("lang", F.lit(None).cast("string"))
    predicted = langid.with_language(table, langid.fit_profiles(table))
    assert predicted.filter("__lang_pred <> 'und' or __lang_score <> 0").count() == 0


def test_licences_of_odd_rows(spark):
    table = odd_documents(spark).unionByName(
        odd_documents(spark).limit(1).withColumn("text", F.lit("a\nReleased under the MIT License.\n\nRedistribution and use in source and binary\nforms, with or without modification, are permitted\nprovided that the following conditions are met:\n"))
    )
    found = licenses.scan_licenses(table).filter("license is not null").collect()
    assert [(r.license, r.score) for r in found] == [("BSD", 1.0)]
    assert [(m.unit, m.license) for m in found[0].matches] == [(1, "MIT"), (7, "MIT"), (8, "BSD")]
    assert licenses.scan_licenses(table, templates={}).filter("license is not null").count() == 0


def test_licence_ties_take_the_smaller_name(spark):
    table = spark.createDataFrame([(1, "one two three")], "doc_id int, text string")
    same = {"b": "one two three", "a": "One, two: three!"}
    assert licenses.scan_licenses(table, templates=same).first().license == "a"


def test_tokens_of_odd_rows(run, odd):
    found = run("op3_token_file", odd).sort_values("start")
    assert len(found) == 14
    assert found.doc_id.isna().tolist() == [True, True] + [False] * 12
    assert found.doc_id.dropna().is_monotonic_increasing
    assert (found.start + found.n_tokens).tolist()[:-1] == found.start.tolist()[1:]
    assert found[found.doc_id.isin([1, 2, 3])].n_tokens.tolist() == [1, 1, 1]


def test_one_id_of_many_rows_is_spread_over_partitions(spark):
    table = spark.range(400).select(
        F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("words of row "), F.col("id")).alias("text")
    )
    manifest = tokenfile.write_tokens(table, queries.tokenizer_file(), partition_chars=500, file_tokens=100)
    files = manifest.collect()
    assert len(files) > 10 and max(f.documents for f in files) < 40
    found = tokenfile.read_tokens(manifest).toPandas().sort_values("start")
    assert found.doc_id.is_monotonic_increasing and len(found) == 400
    assert (found.start + found.n_tokens).tolist()[:-1] == found.start.tolist()[1:]


def rules(spark, rows):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.COM", "http://a.example.com/x/y?q#z", "ftp://example.com#f",
    "http://badexample.com/x/", "http://x.y.example.com/x/1", "http://com/", "http://b.org:80/p", "s://u@b.org/p/q?http://example.com/x/",
]


def brute_verdict(url, listed):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut], rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in listed if host and (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("bits", [1 << 20, 0])
def test_urls_by_cascade_and_by_join(spark, bits):
    listed = [("com", "/", "block"), ("example.com", "/x/", "allow"), ("y.example.com", "", "block"), ("org", "/p/", "allow")]
    many = [(f"h{i}.net", f"/{i % 7}", ("block", "allow")[i % 2]) for i in range(300)]
    urls = [*URLS, *URLS[:3], *[f"http://w{i % 3}.h{i}.net/{i % 5}/x" for i in range(600)]]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit(1))
    found = urlfilter.judge(table, rules(spark, listed + many), max_filter_bits=bits).orderBy("page_id").collect()
    assert [tuple(r)[1:] for r in found] == [brute_verdict(u, listed + many) for u in urls]


def test_urls_without_rules(spark):
    table = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    found = urlfilter.judge(table, rules(spark, []))
    assert found.filter("verdict <> 'allow' or rule is not null").count() == 0 and found.count() == len(URLS)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<\\s> \\[INST]", "[NEXT][ROLE]<s>", "", "ends with <", "\\", "plain\ntext é𝔘", "[[NEXT]"]
    turns = [(1, i, "assistant" if i % 5 < 3 else "[ROLE]user<s>", said[i % len(said)]) for i in range(300)]
    turns += [(2, None, None, None), (2, 0, "user", None), (2, 0, "user", None), (None, 1, "assistant", "x"), (3, -5, "a", "b")]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("n_turns", F.lit(0))
    found = chat.format_conversations(table.repartition(7)).select(
        "*", chat.parse(F.col("formatted")).alias("back"), chat.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    rows = {r.conv_id: r for r in found.collect()}
    assert set(rows) == {1, 2, 3, None}
    assert [(t.role, t.text) for t in rows[1].back] == [(r, t) for _, _, r, t in turns[:300]]
    assert rows[1].loss == [t for _, _, r, t in turns[:300] if r == "assistant"]
    assert rows[1].n_turns == 300 and rows[1].formatted.count("</s>") == sum(
        i == 299 or turns[i][2] != turns[i + 1][2] for i in range(300)
    )
    assert [(t.role, t.text) for t in rows[2].back] == [("", ""), ("user", ""), ("user", "")]
    assert rows[None].loss == ["x"] and rows[3].loss == []


def test_mix_of_odd_rows(spark, run, odd):
    found = run("op6_source_mix", odd)
    assert len(found) == 14
    assert found[found.doc_id.isin([1, 2, 3])].taken.tolist() == [0, 0, 0]
    assert (found.taken <= 3 * found["size"]).all()
    mixed = mixing.mix_documents(odd_documents(spark))
    assert mixed.columns == odd_documents(spark).columns
    assert mixed.filter("doc_id = 6").count() <= 3


def test_targets_fill_up():
    assert mixing.water_fill([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    assert mixing.water_fill([1, 100, 0], [1, 1, 1], 3) == [3.0, 98.0, 0.0]
    assert mixing.water_fill([], [1]) == [] and mixing.water_fill([0, 0], [1, 2]) == [0.0, 0.0]


VECTORS = "vec_id bigint, embedding array<float>, id int, vector int, block int"


def test_neighbours_of_odd_rows(spark):
    bad = [None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0]]
    rows = [(50 * i, v, 0, 0, 0) for i, v in enumerate(bad, start=100)]
    rows += [(None, [1.0, 1.0], 0, 0, 0), (0, [1.0, 0.0], 0, 0, 0), (50, [2.0, 0.0], 0, 0, 0), (50, [2.0, 0.0], 0, 0, 0)]
    rows += [(i, [4.0, 0.0], 0, 0, 0) for i in range(1, 40)] + [(60, [-1.0, -0.0], 0, 0, 0), (61, [0.0, 1.0], 0, 0, 0)]
    table = spark.createDataFrame(rows, VECTORS)
    found = ann.nearest(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found if r.query_id == 0] == [(0, i, i, 1.0) for i in range(1, 6)]
    assert [r.vec_id for r in found if r.query_id == 50] == [0, 1, 2, 3, 4]
    assert {r.query_id for r in found} == {0, 50}


def test_fewer_candidates_than_asked(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    found = ann.nearest(table, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, 2), (2, 1)]


def test_decontamination_of_odd_rows(spark, run, odd):
    found = run("op8_decontaminate", odd)
    assert len(found) == 14
    twice = found[(found.doc_id == 4) & found.contaminated]
    assert twice.n_hit.tolist() == [4, 4] and twice.items_sha256.tolist() == [hashlib.sha256(b"1").hexdigest()] * 2
    unnamed = found[found.doc_id.isna()]
    assert unnamed.n_hit.tolist() == [3, 3] and unnamed.n_items.tolist() == [0, 0]
    assert found[found.doc_id.isin([1, 2, 3])].n_words.tolist() == [0, 0, 0]
    cleaned = decontaminate.remove_benchmark(odd_documents(spark), benchmark(spark))
    assert cleaned.columns == odd_documents(spark).columns
    assert cleaned.count() == 10 and cleaned.filter("text is null").count() == 1


@pytest.mark.parametrize(
    ("text", "spans", "left"),
    [("a b c d", [(1, 3)], "a d"), ("a b c d", [(0, 2)], "c d"), ("a b c d", [(2, 4)], "a b"), ("A, (b c). D", [(1, 3)], "A, ( D"),
     ("a b", [(0, 2)], ""), ("é ñ ü", [(1, 2)], "é ü"), ("a\nb c\nd", [(1, 2)], "a c\nd"), ("a b", [], "a b")],
)
def test_cutting_spans(text, spans, left):
    assert decontaminate.cut_spans(text, spans) == left


def test_string_items(spark):
    table = spark.createDataFrame([(1, "one two three")], "doc_id int, text string")
    items = spark.createDataFrame([("b", "two"), ("a", "two three")], "item_id string, text string")
    row = decontaminate.find_spans(table, items).first()
    assert row["__items"] == ["a", "b"] and [tuple(s) for s in row["__spans"]] == [(1, 3)]


PAGES = [
    ("<p>a<b>c</b>d<i>e</p>f &amp g &lt;x&gt;<!-- c", "acde f & g <x>"), ("<div hidden>x</div>y<script>if(a<b)</script>z", "yz"),
    ("plain  text", "plain text"), ("<article><header><h1>T</h1></header><p>x<br>y</article><aside>n</aside>", "T x y"),
    ("<div class='user-comments'>no</div><p>yes", "yes"), ("<script>abc", ""), ("<form>a</form>b", "b"), (None, ""), ("", ""),
    ("<ul><li>1<li>2</ul><table><tr><td>x<td>y<tr><td>z</table>", "1 2 x y z"), ("<a href=\"x'>\">q</a>", "q"),
    ("<div>" * 3000 + "deep", "deep"), ("<p>" + "w " * 50_000, "w " * 49_999 + "w"),
]


def test_pages_of_odd_markup(spark):
    rows = [(i, None if i % 2 else "http://h/", page) for i, (page, _) in enumerate(PAGES)]
    table = spark.createDataFrame(rows + rows[:2], "page_id bigint, url string, html string").withColumn("host", F.lit(1))
    found = htmltext.extract_text(table).orderBy("page_id").collect()
    expected = [PAGES[r.page_id][1] for r in found]
    assert [r.text for r in found] == expected and [r.n_chars for r in found] == [len(t) for t in expected]


def test_templates_tell_text_from_frame(spark):
    """Pages without article elements: the frame repeats, the text does not."""
    page = "<div class='top'><p>Our site</p></div><div class='body'><h1>Title {0}</h1><p>Word{0} {0} of the story.</p><p>Always here</p></div><div class='end'><p>All {0} rights</p></div>"
    rows = [(i, f"http://one.host/{i}", page.format(i)) for i in range(60)] + [(60, "http://other/", page.format(60))]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.text for r in htmltext.extract_text(table).collect()}
    assert found[7] == "Title 7 Word7 7 of the story."
    assert found[60] == "Our site Title 60 Word60 60 of the story. Always here All 60 rights"


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, "http://h/", "<article><h1>T</h1><p>The same text</p></article>") for i in range(30)]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text for r in htmltext.extract_text(table).collect()} == {"T The same text"}


def test_simhash_of_odd_rows(spark, run, odd):
    found = run("op10_simhash", odd)
    assert len(found) == 14
    blank = found[found.doc_id.isin([1, 2, 3])]
    assert blank.fingerprint.tolist() == ["0" * 16] * 3 and blank.component_id.tolist() == [1, 1, 1]
    assert found[found.doc_id.isin([7, 8])].component_id.tolist() == [7, 7]
    assert found[found.doc_id.isna()].component_id.isna().all()
    kept = simhash.drop_near_duplicates(odd_documents(spark))
    assert kept.columns == odd_documents(spark).columns
    assert kept.filter("doc_id is null").count() == 1 and kept.filter("doc_id in (7, 8)").count() == 1
    assert kept.filter("doc_id = 4").count() == 2


def test_pipeline_of_odd_rows(spark, odd):
    docs = odd_documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd)
        assert docs.columns == odd_documents(spark).columns
    assert docs.filter("doc_id = 6").count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, odd).count() == docs.count()
