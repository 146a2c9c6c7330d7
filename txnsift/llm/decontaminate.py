"""Benchmark decontamination by an FM-index of each training shard.

Words: A-Z lowered, runs of ASCII letters and digits and of non-ASCII characters. A window is `WINDOW` consecutive
words of a benchmark item; a shorter item, if it has a word, is one window. Every document word inside an occurrence of
a window is hit.

A shard is a run of documents of about `SHARD_BYTES`. Only words that can lie in an occurrence are indexed: for each
window length, runs of at least that many words that all occur in windows of that length. (An occurrence consists of
such words, so nothing is lost, and most text never reaches the index.) The runs of a shard, in benchmark word numbers and separated
by zeros, get a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix (one bit vector per
bit of a word number, with counts), and a sample of suffix positions. All windows are searched backwards at once; the
rows of the matches walk back to the next sampled position, which gives their places; places become spans of words,
merged where they meet.

The benchmark goes to the workers in parts of at most `part_words` words; a larger one is searched part by part over
the same rows, each adding its spans, so its size is not limited. Null and empty texts have no words; items without
words have no windows; items of null id count as hits but are not listed. Repeated rows and items are judged each; ties do not arise. An empty benchmark hits
nothing. Other columns pass through and may have any name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.llm.common import arrow_map, extended
from txnsift.session import materialize

#: Words of a window; text bytes of a shard; words of a benchmark part; suffix positions between samples.
WINDOW, SHARD_BYTES, PART_WORDS, SAMPLE = 10, 16 << 20, 4_000_000, 8

#: Every byte that is not part of a word becomes a space, A-Z become lower case.
_WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class Phrases:
    """The windows of benchmark items as rows of word numbers, by window length."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        rows: dict[tuple, set] = {}
        for item_id, text in items:
            words = words_of(text)
            numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            size = min(window, len(numbers))
            for at in range(len(numbers) - size + 1 if numbers else 0):
                owners = rows.setdefault(tuple(numbers[at : at + size]), set())
                if item_id is not None:
                    owners.add(item_id)
        self.groups = []  # (length, windows, items of each window, which words occur in them)
        for size in sorted({len(r) for r in rows}):
            own = [r for r in rows if len(r) == size]
            table = np.array(own, dtype=np.int64).reshape(len(own), size)
            known = np.zeros(len(self.vocabulary) + 1, bool)
            known[table] = True
            self.groups.append((size, table, [sorted(rows[r]) for r in own], known))

    def candidates(self, numbers: np.ndarray) -> np.ndarray:
        """Which words of a text lie in a run that could hold a window."""
        keep = np.zeros(len(numbers), bool)
        for size, _, _, known in self.groups:
            inside = np.concatenate(([False], known[numbers], [False]))
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            starts, stops = edges[::2], edges[1::2]
            long = stops - starts >= size
            for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
                keep[a:b] = True
        return keep


class FMIndex:
    """A text of small numbers: its transform as a wavelet matrix, and sampled suffix positions."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.append(text.astype(np.int64) + 1, 0)  # 0 ends the text and is its smallest number
        n = self.n = len(text)
        order = suffix_order(text)
        transform = text[order - 1]
        self.bits = max(1, int(text.max()).bit_length())
        counts = np.bincount(text, minlength=(1 << self.bits) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))  # rows of suffixes that start with a smaller number
        self.ones, self.zeros, level = [], [], transform
        for shift in range(self.bits - 1, -1, -1):
            bit = level >> shift & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(n - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.transform = transform
        self.sampled = order % sample == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled, dtype=np.int32)))
        self.samples = order[self.sampled]

    def rank(self, number: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often `number` occurs in the transform before `row`, for arrays of both."""
        low, high = np.zeros(len(row), np.int64), row.astype(np.int64)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (number >> (self.bits - 1 - i) & 1).astype(bool)
            low_one, high_one = ones[low].astype(np.int64), ones[high].astype(np.int64)
            low = np.where(bit, zeros + low_one, low - low_one)
            high = np.where(bit, zeros + high_one, high - high_one)
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end row of the suffixes that start with each phrase (rows of equal length)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for at in range(phrases.shape[1] - 1, -1, -1):
            number = phrases[alive, at] + 1
            fits = number < 1 << self.bits
            alive, number = alive[fits], number[fits]
            new_low = self.first[number] + self.rank(number, low[alive])
            new_high = self.first[number] + self.rank(number, high[alive])
            some = new_low < new_high
            alive = alive[some]
            low[alive], high[alive] = new_low[some], new_high[some]
        found = np.zeros(len(phrases), bool)
        found[alive] = True
        return np.where(found, low, 0), np.where(found, high, 0)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps back to the next sampled position."""
        rows, steps, places = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            known = self.sampled[rows[todo]]
            done = todo[known]
            places[done] = self.samples[self.sample_rank[rows[done]]] + steps[done]
            todo = todo[~known]
            number = self.transform[rows[todo]]
            rows[todo] = self.first[number] + self.rank(number, rows[todo])
            steps[todo] += 1
        return places


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffixes of a text in order, by prefix doubling of those that are still tied."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # rank: first row of its group
    rank = np.empty(n, np.int64)
    rank[order] = group
    width = 1
    while True:
        ends = np.append(np.flatnonzero(head)[1:], n)
        size = np.repeat(np.diff(np.append(np.flatnonzero(head), n)), np.diff(np.append(np.flatnonzero(head), n)))
        tied = np.flatnonzero(size > 1)
        if not len(tied) or not len(ends):
            return order
        suffixes = order[tied]
        follow = np.where(suffixes + width < n, rank[np.minimum(suffixes + width, n - 1)] + 1, 0)
        key = rank[suffixes] * (n + 1) + follow
        place = np.argsort(key, kind="stable")
        order[tied] = suffixes[place]
        key = key[place]
        new_head = np.concatenate(([True], key[1:] != key[:-1]))
        head[tied] = new_head
        starts = np.maximum.accumulate(np.where(new_head, tied, 0))
        rank[order[tied]] = starts
        width *= 2


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list]]:
    """For each text: its number of words, merged spans of hit words (start, stop), ids of items that occur."""
    get = phrases.vocabulary.get
    sizes, pieces, homes, places = [], [], [], []
    for i, text in enumerate(texts):
        words = words_of(text)
        sizes.append(len(words))
        numbers = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        at = np.flatnonzero(phrases.candidates(numbers)) if len(words) else numbers
        if not len(at):
            continue
        # a zero before each run of neighbouring words
        breaks = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
        pieces.append(np.insert(numbers[at], breaks, 0))
        places.append(np.insert(at, breaks, -1))
        homes.append(np.full(len(at) + len(breaks), i))
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if pieces:
        index, home, place = FMIndex(np.concatenate(pieces)), np.concatenate(homes), np.concatenate(places)
        for size, table, owners, _ in phrases.groups:
            low, high = index.search(table)
            counts = high - low
            which = np.repeat(np.arange(len(table)), counts)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
            found = index.locate(rows)
            docs = home[found]
            order = np.lexsort((place[found], docs))
            for d, a in zip(docs[order].tolist(), place[found][order].tolist(), strict=True):
                spans[d].append((a, a + size))
            pairs = np.unique(docs * len(table) + which)
            for d, w in zip((pairs // len(table)).tolist(), (pairs % len(table)).tolist(), strict=True):
                items[d].update(owners[w])
    return [(n, merged(s), sorted(x)) for n, s, x in zip(sizes, spans, items, strict=True)]


def merged(spans: list) -> list[tuple[int, int]]:
    """Spans in order, joined where they overlap or meet."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


def _parts(benchmark: DataFrame, item_id: str, text: str, part_words: int) -> list[DataFrame]:
    """The benchmark in parts that are small enough for every worker, by the size of its texts."""
    slim = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter("text is not null")
    # a word has at least one character and a separator
    total = slim.agg(F.sum(F.ceil((F.length("text") + 1) / 2))).first()[0] or 0
    n = max(1, -(-int(total) // part_words))
    return [slim] if n == 1 else [slim.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def find_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """`docs` with __n_words, __spans (start, stop, in words; merged) and __items (ids of items that occur)."""
    named = isinstance(benchmark.schema[item_id].dataType, T.StringType)
    item_type = T.StringType() if named else T.LongType()
    benchmark = benchmark.withColumn(item_id, F.col(item_id).cast(item_type))
    span_type = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    added = (
        T.StructField("__n_words", T.LongType()),
        T.StructField("__spans", T.ArrayType(span_type)),
        T.StructField("__items", T.ArrayType(item_type)),
    )
    found = None
    for part in _parts(benchmark, item_id, item_text, part_words):
        rows = [(r["item"], r["text"]) for r in part.collect()]  # bounded by part_words
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(rows, window))
        source = docs if found is None else found
        found = arrow_map(source, _searcher(phrases, text, pa.string() if named else pa.int64(), found is not None), extended(docs, *added))
    return found


def _searcher(phrases, text: str, item_type: pa.DataType, again: bool):
    def search(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(text)).nbytes
            if size >= SHARD_BYTES:
                yield from shard(held)
                held, size = [], 0
        if held:
            yield from shard(held)

    def shard(held):
        texts = [t for b in held for t in b.column(b.schema.get_field_index(text)).to_pylist()]
        found, at = search_shard(texts, phrases.value), 0
        for batch in held:
            yield _extend(batch, found[at : at + len(batch)], item_type, again)
            at += len(batch)

    return search


def _extend(part, found: list, item_type: pa.DataType, again: bool):
    """The rows of a shard with its findings, joined to those of earlier benchmark parts."""
    names = ["__n_words", "__spans", "__items"]
    if again:
        old = [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
        found = [
            (n, merged([*s, *((o["start"], o["stop"]) for o in so)]), sorted({*x, *xo}))
            for (n, s, x), so, xo in zip(found, old[1], old[2], strict=True)
        ]
        part = part.select([n for n in part.schema.names if n not in names])
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    columns = [
        pa.array([f[0] for f in found], pa.int64()),
        pa.array([[{"start": a, "stop": b} for a, b in f[1]] for f in found], pa.list_(span)),
        pa.array([f[2] for f in found], pa.list_(item_type)),
    ]
    for name, column in zip(names, columns, strict=True):
        part = part.append_column(name, column)
    return part


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of the spans, and without what stands between them; white space around a cut is one."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [(m.start(), m.end()) for m in _WORD.finditer(raw)]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]].rstrip())
        last = at[b - 1][1]
        while last < len(raw) and raw[last : last + 1] not in (b" ", b"\n", b"\t", b"\r") and (b == len(at) or last < at[b][0]):
            last += 1  # punctuation that closed the cut passage
    out.append(raw[last:].lstrip() if spans and not out[0] else raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass").strip() if spans else text


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """`docs` with every removal span cut out of the text; a text of which no word is left goes.

    Rows without a hit are unchanged. `n_chars`, where present, follows the new text. Cutting joins what stood
    around a passage, so what was cut is searched again until nothing is hit.
    """
    own, names = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # so that no column clashes with a finding
    docs, text, n_chars = docs.toDF(*names), names[own.index(text)], names[own.index(n_chars)] if n_chars in own else None

    def cut(batches):
        for batch in batches:
            spans = batch.column(batch.schema.get_field_index("__spans")).to_pylist()
            i = batch.schema.get_field_index(text)
            old = batch.column(i).to_pylist()
            new = [cut_spans(t, [(s["start"], s["stop"]) for s in p]) if p else t for t, p in zip(old, spans, strict=True)]
            kept = pa.array([not p or bool(words_of(t)) for t, p in zip(new, spans, strict=True)])
            batch = batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type))
            yield batch.select(names).filter(kept)

    marked = materialize(find_spans(docs, benchmark, text), "spans")
    clean = marked.filter(F.size("__spans") == 0).select(names)
    dirty = marked.filter(F.size("__spans") > 0)
    while not dirty.isEmpty():
        shorter = materialize(arrow_map(dirty, cut, docs.schema), "cut")
        again = materialize(find_spans(shorter, benchmark, text), "spans")
        done = again.filter(F.size("__spans") == 0).select(names)
        if n_chars in names:
            done = done.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
        clean, dirty = clean.unionByName(done), again.filter(F.size("__spans") > 0)
    return clean.toDF(*own)
