"""Input columns that are called like findings, and letters of the last planes."""

from pyspark.sql import functions as F

from txnsift.llm import decontaminate, langid


def test_letters_of_the_last_planes_count():
    codes, counts = langid.ngram_counts(chr(0x30000) + chr(0x3134F))
    assert len(codes) > 0 and counts.sum() >= 2


def test_columns_called_like_findings_stay(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, f"before {passage} after", 7, "a"), (2, "nothing to see", 8, "b"), (3, None, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __spans bigint, __items string")
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    found = decontaminate.remove_benchmark(docs, bench).orderBy("doc_id")
    assert found.columns == docs.columns
    assert [tuple(r) for r in found.collect()] == [(1, "before after", 7, "a"), (2, "nothing to see", 8, "b"), (3, None, 9, None)]
    language = docs.withColumn("__lang_pred", F.lit("x")).withColumn("lang", F.lit("en"))
    kept = langid.keep_identified(language, langid.fit_profiles(language))
    assert kept.columns == language.columns
