"""Each query that SQL cannot express, against a plain version of the same contract."""

from __future__ import annotations

import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from txnsift.llm import ann, decontaminate, langid, mixing, queries, simhash, tokenfile

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark, smallest):
    return spark.read.parquet(f"{smallest}/documents.parquet").toPandas()


def test_language_on_held_out_rows(run, docs, spark, folder):
    found = run("op1_language_id", "/root/testdata/sf0.01").merge(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas(), on="doc_id"
    )
    expected = [zlib.crc32(str(d).encode()) % 5 == 0 for d in found.doc_id]
    assert found.held_out.tolist() == expected
    own = found[found.held_out]
    assert (own.lang_pred == own.lang).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_counts_of_pieces_add_up(monkeypatch):
    text = "one two, three four five " * 40
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    for a, b in zip(whole, langid.ngram_counts(text), strict=True):
        assert a.tolist() == b.tolist()
    brute: dict = {}
    for word in re.findall(r"[a-z]+", text):
        for n in (1, 2, 3):
            for i in range(len(word) + 3 - n):
                gram = f" {word} "[i : i + n]
                if gram.strip() and (n == 1 or len(gram) == n):
                    brute[gram] = brute.get(gram, 0) + 1
    assert sorted(whole[1].tolist()) == sorted(brute.values())


def test_tokens_equal_the_library(run, docs, smallest):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_file())
    start, expected = 0, []
    for row in docs.sort_values("doc_id").itertuples():
        ids = [*tokenizer.encode(row.text or "", add_special_tokens=False).ids, 2]
        expected.append((row.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    found = run("op3_token_file", smallest).sort_values("doc_id")
    assert list(found[["doc_id", "start", "n_tokens", "ids_crc32"]].itertuples(index=False, name=None)) == expected


@pytest.mark.parametrize(
    "text",
    ["Don't we'll I'd 'sfoo", "x<|endoftext|>y <|startoftext|>", "ΑΣ ΣΑΣ", "J̌ x́ é", "a b\u0085c\x1cd",
     "½ ³4 12ab34 ª µm ÀÈ ß ẞ İi", "…“quoted”—dash", "日本語 テスト", "soft­hyphen a​b", "", " ", "$$$.&&& ’s 's"],
)
def test_tokenizer_words(text):
    own = tokenfile.WordTokenizer(queries.tokenizer_file())
    plain = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(own.encode(text), np.uint16).tolist() == plain


@pytest.mark.parametrize("n_ids", [1, 300, 70_000])
def test_file_round_trip(n_ids):
    ids = np.random.default_rng(1).integers(0, n_ids, 5 * n_ids + 3)
    lengths = np.array([len(ids) - 1, 0, 1])
    ids_back = tokenfile.decode_file(tokenfile.encode_file([3, None, 7], lengths, ids))
    assert ids_back[0] == [3, None, 7]
    assert ids_back[1].tolist() == lengths.tolist()
    assert ids_back[2].tolist() == ids.tolist()


def test_mix_meets_its_contract(run, docs, smallest):
    found = run("op6_source_mix", smallest)
    again = run("op6_source_mix", smallest)
    assert sorted(found.itertuples(index=False)) == sorted(again.itertuples(index=False))
    rows = docs.merge(found, on="doc_id")
    assert rows["size"].tolist() == [len(WORDS.findall(t or "")) for t in rows.text]
    sources = rows.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (sources["size"] == sources.own).all()
    weights = [(1, 2, 3)[i % 3] for i in range(len(sources))]
    targets, free, left = {}, dict(zip(sources.index, weights, strict=True)), float(sources["size"].sum())
    while True:
        share = {s: left * w / sum(free.values()) for s, w in free.items()}
        over = [s for s in share if share[s] > 3 * sources.own[s]]
        if not over:
            break
        for s in over:
            targets[s] = 3.0 * sources.own[s]
            left -= targets[s]
            del free[s]
    targets.update(share)
    assert np.allclose([targets[s] for s in sources.index], sources.target)
    assert (rows.taken <= 3 * rows["size"]).all()
    smallest_doc = rows[rows["size"] > 0].groupby("source")["size"].min()
    assert ((sources.target - sources.taken).abs() <= np.maximum(0.1 * sources.target, smallest_doc)).all()


def test_splitting_tree_deals_every_draw_once(spark):
    dealt = mixing.deal(spark, [7, 0, 13, 1], 5, 3).toPandas()
    assert sorted(zip(dealt["at"], dealt.draw, strict=True)) == [(s, d) for s, n in enumerate([7, 0, 13, 1]) for d in range(n)]
    assert dealt.groupby("shard").size().tolist() == [4, 4, 4, 4, 5]


def test_mix_repeats_whole_rows(spark, smallest):
    table = spark.read.parquet(f"{smallest}/documents.parquet")
    plan = mixing.plan_mix(mixing.sized_rows(table, "doc_id", "text", "source", 17))
    placed = mixing.place(mixing.sized_rows(table, "doc_id", "text", "source", 17), plan).toPandas()
    mixed = mixing.mix_documents(table).toPandas()
    copies = {r.id: len(r.shards) for r in placed.itertuples() if len(r.shards)}
    assert mixed.groupby("doc_id").size().to_dict() == copies


def exact_neighbours(table, k=5):
    rows = [(i, np.array(v, dtype=float)) for i, v in zip(table.vec_id, table.embedding, strict=True)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in rows])
    ids = np.array([i for i, _ in rows])
    for at in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[at]
        others = np.flatnonzero(ids != ids[at])
        order = others[np.lexsort((ids[others], -np.round(scores[others], 13)))][:k]
        yield ids[at], ids[order].tolist(), scores[order]


def test_neighbours_against_all_rows(run, spark, smallest):
    found = run("op7_nearest", smallest)
    hits = total = 0
    for query, ids, scores in exact_neighbours(spark.read.parquet(f"{smallest}/embeddings.parquet").toPandas()):
        own = found[found.query_id == query].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(ids) + 1))
        hits, total = hits + len(set(ids) & set(own.vec_id)), total + len(ids)
        if ids == own.vec_id.tolist():
            assert np.allclose(own.score, scores, atol=1e-14)
    assert hits >= 0.99 * total


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(5)
    vectors, asked = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    turn = ann.rotation(64, 256)
    guess, error = ann.estimate(*ann.encode(vectors, turn), asked, turn, ann.EPSILON)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    assert (np.abs(guess - unit(vectors) @ unit(asked).T) <= error[:, None]).mean() > 0.995


def brute_spans(text, items):
    windows: dict = {}
    for item, words in items.items():
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(item)
    words = ITEM_WORDS.findall(lowered(text))
    hit, found = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            owners = windows.get(tuple(words[i : i + size]))
            if owners:
                hit.update(range(i, i + size))
                found |= owners
    return len(words), hit, found


def test_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 4))
        text, phrases = rng.integers(0, 4, n), rng.integers(0, 5, (15, k))
        index = decontaminate.FMIndex(text)
        for phrase, low, high in zip(phrases, *index.search(phrases), strict=True):
            places = [i for i in range(n - k + 1) if text[i : i + k].tolist() == phrase.tolist()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == places


def test_decontamination_against_brute_force(run, spark, docs, smallest):
    bench = spark.read.parquet(f"{smallest}/benchmark.parquet").toPandas()
    items = {r.item_id: ITEM_WORDS.findall(lowered(r.text)) for r in bench.itertuples()}
    found = run("op8_decontaminate", smallest).set_index("doc_id")
    assert found.contaminated.sum() > 0
    for row in docs.itertuples():
        n, hit, owners = brute_spans(row.text, items)
        own = found.loc[row.doc_id]
        assert (own.n_words, own.n_hit, own.n_items, own.contaminated) == (n, len(hit), len(owners), bool(hit))


def test_benchmark_in_parts_gives_the_same(spark, smallest):
    table = spark.read.parquet(f"{smallest}/documents.parquet")
    bench = spark.read.parquet(f"{smallest}/benchmark.parquet")
    rows = [sorted(map(str, decontaminate.find_spans(table, bench, part_words=n).select("doc_id", "__n_words", "__spans", "__items").collect())) for n in (10**6, 300)]
    assert rows[0] == rows[1]


def test_cut_texts_hold_no_benchmark(spark, smallest):
    table = spark.read.parquet(f"{smallest}/documents.parquet")
    bench = spark.read.parquet(f"{smallest}/benchmark.parquet")
    cleaned = decontaminate.remove_benchmark(table, bench)
    after = decontaminate.find_spans(cleaned, bench)
    assert after.filter("size(__spans) > 0").count() == 0
    before = {r.doc_id: r.text for r in table.collect()}
    dirty = {r.doc_id for r in decontaminate.find_spans(table, bench).filter("size(__spans) > 0").collect()}
    for row in cleaned.collect():
        assert (row.text == before[row.doc_id]) == (row.doc_id not in dirty)
        assert row.n_chars == len(row.text) or row.doc_id not in dirty


def brute_fingerprint(text):
    words = WORDS.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in prints}


def test_simhash_against_brute_force(run, docs, smallest):
    found = run("op10_simhash", smallest).set_index("doc_id")
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.itertuples()}
    assert {d: int(f, 16) for d, f in found.fingerprint.items()} == prints
    assert found.component_id.to_dict() == brute_components(prints)


@pytest.mark.parametrize("dense", [1, 3, 1000])
def test_dense_blocks_keep_every_connection(spark, dense):
    rng = np.random.default_rng(3)
    values = {0}
    for _ in range(3):
        center = int(rng.integers(0, 1 << 62))
        for _ in range(25):
            values.add(center ^ sum(1 << int(b) for b in rng.integers(0, 64, int(rng.integers(0, 4)))))
    prints = {v - (1 << 64) if v >> 63 else v: v for v in values}
    table = spark.createDataFrame([(v,) for v in prints], "fp bigint")
    pairs = simhash.near_pairs(table, dense=dense)
    for a, b in pairs.collect():
        assert (prints[a] ^ prints[b]).bit_count() <= 2
    found = {r.node: r.root for r in simhash.components(pairs).collect()}
    expected = brute_components(prints)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({v: found.get(v, v) for v in prints}) == groups(expected)


def near_copies_by_all_pairs(texts):
    """The smallest id of each group linked by five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {" ".join(words[at : at + 5]) for at in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return sorted({find(i) for i in sets})


def test_pipeline_stage_by_stage(spark, smallest, docs):
    bench = spark.read.parquet(f"{smallest}/benchmark.parquet")
    table = spark.read.parquet(f"{smallest}/documents.parquet")
    columns = table.columns
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, table, smallest)
    assert known.columns == columns
    assert known.count() == sum(any(c.isalpha() for c in t) for t in docs.text)
    single = stages["simhash_near_dedup"](spark, known, smallest)
    assert sorted(r.doc_id for r in single.collect()) == near_copies_by_all_pairs({r.doc_id: r.text for r in known.collect()})
    clean = stages["benchmark_decontamination"](spark, single, smallest)
    assert clean.columns == columns
    assert decontaminate.find_spans(clean, bench).filter("size(__spans) > 0").count() == 0
    mixed = stages["source_mix"](spark, clean, smallest)
    assert mixed.columns == columns
    written = stages["token_files"](spark, mixed, smallest).toPandas()
    assert len(written) == mixed.count()
    ends = written.sort_values("start")
    assert (ends.start + ends.n_tokens).tolist()[:-1] == ends.start.tolist()[1:]
    assert ends.doc_id.is_monotonic_increasing
