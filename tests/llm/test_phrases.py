"""Phrase collocations against counting every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from txnsift.llm import phrases

DOCS = "doc_id bigint, text string, lang string, shard string, n string, phrase string"


def brute(rows, min_count, top, max_words=5):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if a >= min_count and len(p) > 1}
        inner = defaultdict(int)
        for p, a in good.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inner[p[i : i + size]] = max(inner[p[i : i + size]], a)
        scored = []
        for p, a in good.items():
            if inner[p] >= a:
                continue
            cuts = [(1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def rows_of(found):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in found.collect())


def made_up(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "ü x", "\x1cq", "A"]
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, weights=[1 / (j + 1) for j in range(len(vocabulary))], k=rng.randint(0, 60))
        joints = [rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "\x0b"]) for _ in words]
        text = "".join(w + j for w, j in zip(words, joints, strict=True))
        rows.append((text + " once upon a time there" * (i % 3), [None, "und", "en", "xx"][i % 4]))
    rows += [(None, "en"), ("", None), (" .,; ", "en"), ("Once upon a time there " * 3000, "en"), ("same same same", "xx"), ("same same same", "xx")]
    return rows


@pytest.mark.parametrize(("parts", "min_count", "top"), [(1, 3, 2000), (7, 2, 5), (3, 40, 2000)])
def test_phrases_against_counting_all(spark, parts, min_count, top):
    rows = made_up()
    table = spark.createDataFrame([(i, t, lang, "a", "b", "c") for i, (t, lang) in enumerate(rows)], DOCS).repartition(parts, "doc_id")
    assert rows_of(phrases.collocations(table, min_count=min_count, top=top)) == brute(rows, min_count, top)


def test_empty_tables(spark):
    assert rows_of(phrases.collocations(spark.createDataFrame([], DOCS))) == []
    assert rows_of(phrases.collocations(spark.createDataFrame([(1, None, None, "", "", "")], DOCS), min_count=1)) == []


def test_suffix_order_ends_at_separators():
    rng = np.random.default_rng(1)
    for n_symbols in (1, 3, 40_000):
        text = rng.integers(0, min(n_symbols, 4) + 1, 300) * (n_symbols // min(n_symbols, 4))
        text = np.append(np.tile(text, 3), 0)
        marks = [(0, i) if s == 0 else (1, int(s)) for i, s in enumerate(text)]
        expected = sorted(range(len(text)), key=lambda i: marks[i : i + 320])
        assert phrases.suffix_order(text, n_symbols).tolist() == expected


def test_both_directions_find_the_same_phrases():
    rng = np.random.default_rng(5)
    text = np.append(rng.integers(0, 5, 4000), 0)
    text[0] = 0
    text = phrases.runs(text)
    first, lf = phrases.lf_steps(text, 4)
    _, reverse = phrases.lf_steps(text[::-1], 4)
    counts = Counter()
    for i in range(len(text) - 2):
        if 0 not in text[i : i + 3]:
            counts[tuple(text[i : i + 3].tolist())] += 1
    low, n = first[1:-1], np.diff(first[1:])
    for left_first in (True, False):
        for left_then in (True, False):
            words, one, two, size = [(s,) for s in range(1, 5)], low, low, n
            for left in (left_first, left_then):
                lows, others, lfs = (one, two, lf) if left else (two, one, reverse)
                own, symbol, a, b, size = phrases.grow(first, lfs, lows, others, size)
                one, two = (a, b) if left else (b, a)
                words = [(s, *words[o]) if left else (*words[o], s) for o, s in zip(own.tolist(), symbol.tolist(), strict=True)]
            assert dict(zip(words, size.tolist(), strict=True)) == counts


def test_memory_of_a_shard_is_a_few_words_a_word():
    """Suffix order and extensions of a long shard: once 71 and 53 bytes a word, which took an executor over its limit."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = np.minimum(rng.zipf(1.3, 600_000), 3000).astype(np.int32)
    words[::17] = 0
    text = phrases.runs(words)
    tracemalloc.start()
    try:
        first, lf = phrases.lf_steps(text, 3000)
        assert tracemalloc.get_traced_memory()[1] < 45 * len(text)
        low, n = first[1:-1], np.diff(first[1:])
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        found = [phrases.grow(first, lf, low, low, n, a, b) for a, b in phrases.slices(n)]
        assert tracemalloc.get_traced_memory()[1] - held < 45 * len(text)
    finally:
        tracemalloc.stop()
    whole = phrases.grow(first, lf, low, low, n)
    assert len(found) > 1
    for part, all_at_once in zip(zip(*found, strict=True), whole, strict=True):
        assert np.array_equal(np.concatenate(part), all_at_once)


def test_phrases_summed_in_many_groups(spark, monkeypatch):
    """Groups of few words: every phrase is summed in one of some hundred groups, and finds its intervals in each shard again."""
    monkeypatch.setattr(phrases, "GROUP_WORDS", 100)
    rows = made_up(9)
    table = spark.createDataFrame([(i, t, lang, "a", "b", "c") for i, (t, lang) in enumerate(rows)], DOCS).repartition(3, "doc_id")
    assert rows_of(phrases.collocations(table, min_count=3)) == brute(rows, 3, 2000)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    columns = [rng.integers(-(2**62), 2**62, 50), np.arange(50), np.zeros(50, np.int32)]
    assert np.array_equal(phrases.unpack(phrases.pack(columns), 50, 3), np.stack(columns))
    symbols = rng.integers(0, 2**31, 50).astype(np.int32)
    assert phrases.unpack(phrases.pack([symbols], np.int32), 50, 1, np.int32)[0].tolist() == symbols.tolist()
    assert not len(phrases.unpack(phrases.pack([symbols[:0]], np.int32), 0, 1, np.int32)[0])


def test_a_pair_travels_in_few_bytes():
    """Pairs of frequent words and shards were rows of 22 bytes, rows of an index took 8 bytes a word: most of the disk."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    text = np.minimum(rng.zipf(1.3, 400_000), 5000).astype(np.int32)
    text[::17] = 0
    text = phrases.runs(text)
    bwts = [phrases.symbols_before(t, 5000) for t in (text, text[::-1])]
    packed = [phrases.pack([b], np.int32) for b in bwts]
    assert sum(map(len, packed)) < 4 * len(text)
    for b, p in zip(bwts, packed, strict=True):
        assert np.array_equal(phrases.unpack(p, len(b), 1, np.int32)[0], b)
    index = {
        "shard": pa.array([7]), "ids": pa.array([np.arange(5000) << 28]), "first": pa.array([phrases.starts_of(text, 5000)]),
        "reverse_bwt": pa.array([packed[1]], pa.binary()),
    }
    (sent,) = phrases._grower(2, 8)([pa.RecordBatch.from_arrays([*index.values()], [*index])])
    pairs = sum(sent.column("phrases").to_pylist())
    both = (text[:-1] > 0) & (text[1:] > 0)
    assert pairs == len(np.unique(text[:-1][both].astype(np.int64) << 32 | text[1:][both]))
    assert sum(map(len, sent.column("packed").to_pylist())) < 8 * pairs
    # each group answers with one row, however many pairs are frequent
    for i in range(len(sent)):
        answer = phrases._summer(2, 8, 3)(pa.Table.from_batches([sent.slice(i, 1)]))
        assert len(answer) == 1
