"""Ranked search against scoring every pair."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from txnsift.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    weight = lambda t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
    out = []
    for item, text in items:
        scored = []
        for i, c, n in counts:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(weight(t) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


def made_up(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)] + ["Été", "ß9", "A", "\U00030000"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(0, 40))) for i in range(700)]
    docs += [(i, "t1 t2 t3 copied text t40") for i in range(900, 1200)]  # many equal scores
    docs += [(None, "t1 t2 t3 copied text t40"), (None, None), (5000, None), (5001, "..."), (5002, "t5 " * 30_000), (5003, "t9"), (5003, "t9")]
    items = [(f"i{i}", text(rng.randint(1, 12))) for i in range(23)]
    items += [("copy", "copied text"), ("copy", "copied text"), (None, "t59 t58"), ("none", None), ("empty", "?!"), ("unknown", "zzz qqq")]
    return docs, items


def frames(spark, docs, items):
    rows = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id bigint, text string, terms string, id int")
    return rows, spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, rank int")


@pytest.mark.parametrize("part_words", [1_000_000, 40])
def test_ranks_against_all_pairs(spark, part_words):
    docs, items = made_up()
    rows, questions = frames(spark, docs, items)
    found = lexical.rank_documents(rows.repartition(3), questions, part_words=part_words)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = made_up()
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], [("a", "b")])):
        assert lexical.rank_documents(*frames(spark, d, i)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_trees_prune_nothing_that_counts(seed, monkeypatch):
    """Trees of many levels, blocks of few terms, several blocks of documents: the same best rows as all scores."""
    monkeypatch.setattr(lexical, "LEAF_DOCS", 4)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 30)
    rng = np.random.default_rng(seed)
    n_terms, n_items, k = 80, 37, 5
    weights = rng.integers(1, 9, n_terms)
    items = [np.unique(rng.integers(0, n_terms, 6)).tolist() for _ in range(n_items)]
    blocks = lexical._blocks(items, weights, n_terms)
    assert len(blocks) > 3
    best, scores, ids = lexical.Best(np.zeros(n_items, np.int64), k), [], []
    for block_no in range(3):
        dense = rng.integers(0, 4, (200, n_terms)) * (rng.random((200, n_terms)) < 0.1)
        own = rng.permutation(200) + 200 * block_no
        owner, column = np.nonzero(dense)
        for block in blocks:
            local = block.column[column]
            some = local >= 0
            tree = lexical.DocTree(own, owner[some], local[some], dense[owner, column][some], block)
            tree.search(best)
        scores.append(np.array([[sum(weights[t] * d[t] for t in item) for d in dense] for item in items]))
        ids.append(own)
    scores, ids = np.hstack(scores), np.concatenate(ids)
    for i in range(n_items):
        order = np.lexsort((ids, -scores[i]))[:k]
        order = order[scores[i][order] > 0]
        kept = best.scores[i] > 0
        assert best.scores[i][kept].tolist() == scores[i][order].tolist()
        assert best.ids[i][kept].tolist() == ids[order].tolist()
