"""The near-copy stage of the pipeline against all pairs."""

from __future__ import annotations

import itertools
import random

import corpus_pipeline
from txnsift.llm import nearcopies, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def word_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def expected_ids(texts):
    """The smallest id of each component, by all pairs."""
    root, sets = {i: i for i in texts}, {i: word_sets(t) for i, t in texts.items()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted({find(i) for i in texts})


def planted(seed=4):
    """Texts of 100 to 200 words, copies with a few changed words, and chains of them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for group in range(40):
        words = rng.choices(vocabulary, k=rng.randint(100, 200))
        for copy in range(6):
            changed = list(words) if copy < 4 else changed
            for at in rng.sample(range(len(words)), 2 if copy else 0):
                changed[at] = rng.choice(vocabulary)
            texts[group * 10 + copy] = " ".join(changed)
    return texts


def test_stage_drops_copies_with_changed_words(spark):
    texts = planted()
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOCS)
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, table, "").collect())
    assert kept == expected_ids(texts)
    assert len(kept) < 0.5 * simhash.drop_near_duplicates(table).count()


def test_stage_on_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = sorted(r.doc_id for r in nearcopies.drop_near_copies(table).collect())
    assert kept == expected_ids({r.doc_id: r.text for r in table.collect()})


def test_one_large_group_and_odd_rows(spark):
    rng = random.Random(1)
    words = [f"v{i}" for i in range(150)]
    rows = [(i, " ".join(words[:at] + [f"x{i}"] + words[at + 1 :])) for i in range(300) for at in [rng.randrange(150)]]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, "no id here"), (None, "no id here"), (1003, "No  ID here"), (1004, "x"), (1004, "x")]
    table = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    found = nearcopies.drop_near_copies(table)
    assert found.columns == table.columns
    assert sorted(r.doc_id for r in found.collect()) == [0, 1000, 1003, 1004]


def test_dense_band_values_lose_no_link(spark, monkeypatch):
    """Copies of one text with few to many changed words: most are below the limit, and the links between the others stay."""
    rng = random.Random(6)
    words = [f"v{i}" for i in range(120)]
    texts = {}
    for i in range(160):
        changed = list(words)
        for at in rng.sample(range(120), rng.choice([1, 3, 5, 8, 12])):
            changed[at] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(changed)
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts.items()], DOCS)
    for dense in (2, 48, 10_000):
        monkeypatch.setattr(nearcopies, "DENSE", dense)
        assert sorted(r.doc_id for r in nearcopies.drop_near_copies(table).collect()) == expected_ids(texts)


def test_stage_links_what_simhash_links(spark):
    """A text that says the same over and over has the fingerprint of its longer form, though shingles at the seams are new."""
    words = "a b c d e f g".split()
    rows = [(1, " ".join(words * 30)), (2, " ".join(words * 30 + ["x", "y", "z", "u"])), (3, "nothing like the others, at all")]
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], DOCS)
    assert expected_ids(dict(rows)) == [1, 2, 3]
    assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") <= 2
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(table).collect()) == [1, 3]
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, table, "").collect()) == [1, 3]
