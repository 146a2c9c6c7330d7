"""Phrase collocations by an FM-index of each shard over word ids.

Texts: A-Z lowered, null is empty, cut into pieces at `.,;:!?` and line ends, pieces into words at spaces and tabs. All is per
language (null: `und`). f(phrase) counts the contiguous occurrences within pieces, overlaps included.

1. A shard is a run of documents of one language in a partition, about `SHARD_BYTES` of text; it is stored as its vocabulary and
   its word numbers. Counts of words are summed over shards, and words below `min_count` leave (no candidate holds them).
2. The runs of frequent words that remain get a suffix array and one of the reversed text (packed words, then prefix
   doubling; separators differ, so that no comparison passes one). Stored is the symbol before each row of both, packed; a stable
   sort turns it into LF steps. A phrase is a pair of row intervals, one in each index, of equal length.
3. Phrases grow by one word at a time: to the left by LF steps of the index, to the right by those of the reversed
   one. The interval of the other index narrows by the number of smaller neighbours. A longer phrase is counted in a shard only if both
   its first and its last words (all but one) are frequent over all shards; counts are summed over shards by one shuffle, in
   blocks: phrases are dealt to groups by a hash, and what a shard sends to a group is one row of packed numbers, sorted by phrase.
   Only frequent phrases return to their shards, packed as well. Pairs return as numbers and find their intervals by growing again (most pairs
   are rare, and intervals do not pack), longer phrases take their intervals along. Indexes are bucketed by shard and never shuffled.
4. Each frequent phrase then knows the counts of all its beginnings and ends, and the largest count of its extensions by
   one word to the left and right. A longer candidate around a phrase has at most the count of such an extension, which is itself
   a candidate; so extensions by one word decide which phrases a longer one subsumes.

score = floor(1000 a n / (l r)) with a = f(phrase), n all words of the language, l and r the counts of the two parts; the cut with
the lowest score counts, then the earliest. Products are decimals of 38 digits. Ranks: score, then a (both descending), then the
phrase in byte order. Repeated rows count as often as they occur; ids are not read; an empty table gives no rows. A shard holds a
phrase once, so the sums over shards shuffle at most one entry per phrase and shard, however often it occurs.
"""

from __future__ import annotations

import itertools
import uuid
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnsift.llm.common import arrow_map
from txnsift.session import materialize, scratch_path

#: Bytes of text of a shard; words for each group in which phrases are summed.
SHARD_BYTES, GROUP_WORDS = 16 << 20, 1 << 19
#: Occurrences of phrases that are extended at once.
SLICE = 1 << 18
#: Bits of a phrase's number within a shard, of a shard's number within its partition.
NUMBER_BITS, SEQUENCE_BITS = 28, 13
#: Piece ends become a byte that no text holds, A-Z become lower case.
_LOWER = bytes(0xFF if b in b".,;:!?\x0a\x0b\x0c\x0d" else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SHARD = "shard bigint, lang string, words array<string>, counts array<bigint>, n_words int, length int, text binary"
_INDEX = "shard bigint, lang string, ids array<bigint>, first array<int>, bwt binary, reverse_bwt binary"
_GROWN = "group bigint, shard bigint, start bigint, phrases int, packed binary"
_KNOWN = (
    "`group` bigint, ids array<bigint>, prefixes array<bigint>, suffixes array<bigint>, sums array<bigint>, "
    "replies array<struct<shard: bigint, phrases: int, packed: binary>>"
)


def collocations(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    min_count: int = 100,
    max_words: int = 5,
    top: int = 2000,
    subsumed_percent: int = 100,
) -> DataFrame:
    """Per language its `top` phrases: lang, rank, phrase, a, l, r, n, score, n_words, max_left, max_right.

    A phrase is dropped if an extension by one word has at least `subsumed_percent` of its count.
    """
    slim = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    spark, folders = docs.sparkSession, [scratch_path(docs.sparkSession, name) for name in ("shards", "indexes")]
    shards, shards_name = _bucketed(arrow_map(slim, _tokenise, _SHARD), folders[0])
    words = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("no", "one"))
    words = words.select("shard", "lang", F.col("no").cast("bigint").alias("no"), "one.words", "one.counts")
    totals = materialize(words.groupBy("lang").agg(F.sum("counts").alias("n")), "totals")
    code = F.shiftleft("shard", NUMBER_BITS).bitwiseOR(F.col("no"))
    known = materialize(
        _frequent(words.withColumn("code", code), ["lang", "words"], "counts", min_count).select("shard", "lang", "no", "id", "words", "f"), "words"
    )
    whole = known.groupBy("id").agg(F.first("lang").alias("lang"), F.first("words").alias("phrase"), F.first("f").alias("f"))
    levels = [materialize(whole.select("*", F.array("f").alias("heads"), F.array("f").alias("tails"), F.col("phrase").alias("last")), "level")]

    listed = known.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("no", "id"))).alias("listed"))  # a shard's vocabulary
    both = shards.select("shard", "lang", "text", "length", "n_words").join(listed.hint("shuffle_hash"), "shard")
    indexes, indexes_name = _bucketed(arrow_map(both.select("shard", "lang", "text", "length", "n_words", "listed"), _build, _INDEX), folders[1])
    _drop(spark, shards_name, folders[0])
    groups = (totals.agg(F.sum("n")).first()[0] or 0) // GROUP_WORDS + 1
    for size in range(2, max_words + 1):
        # ids and intervals of words come from the index itself, intervals of pairs from the reversed one
        table = indexes.select("shard", "ids", "first", *_read(size))
        if size > 2:
            replies = known.select("group", F.explode("replies").alias("one")).select("group", "one.*")
            listed = replies.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("group", "phrases", "packed"))).alias("listed"))
            table = table.join(listed.hint("shuffle_hash"), "shard")
        grown = arrow_map(table, _grower(size, groups), _GROWN)
        known = materialize(grown.groupBy("group").applyInArrow(_summer(size, groups, min_count), _KNOWN), "phrases")
        level = known.select(F.explode(F.arrays_zip("ids", "prefixes", "suffixes", "sums")).alias("one"))
        level = level.select(*[F.col(f"one.{old}").alias(new) for old, new in zip(("ids", "prefixes", "suffixes", "sums"), ("id", "prefix", "suffix", "f"), strict=True)])
        levels.append(materialize(_spelled(level, levels[-1]), "level"))
    _drop(spark, indexes_name, folders[1])  # the result reads the levels only
    return _scored(levels, totals, top, subsumed_percent)


def _bucketed(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    """`df` as a table at `path`, bucketed by shard, and its name: joins on it move only the other side."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"txnsift_{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").bucketBy(buckets, "shard").option("path", path).saveAsTable(table)
    return spark.table(table), table


def _drop(spark: SparkSession, table: str, path: str) -> None:
    """Deletes a table of `_bucketed` that no later step reads."""
    spark.sql(f"DROP TABLE {table}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _frequent(rows: DataFrame, key: list[str], count: str, min_count: int) -> DataFrame:
    """`rows` whose counts over all shards reach `min_count`: f, and an id, which is the smallest code of the key."""
    group = Window.partitionBy(*key)
    summed = rows.withColumn("f", F.sum(count).over(group)).withColumn("id", F.min("code").over(group))
    return summed.filter(F.col("f") >= min_count)


def _tokenise(batches):
    """Shards of rows (lang, text): vocabulary, counts, and word numbers from 1, with 0 between pieces."""
    partition, shards, sequence = TaskContext.get().partitionId(), {}, itertools.count()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shard = shards.get(lang) or shards.setdefault(lang, Shard(lang))
            shard.add(text.as_py())
            if shard.size >= SHARD_BYTES:
                yield shards.pop(lang).row(partition, next(sequence))
        while sum(s.size for s in shards.values()) >= 2 * SHARD_BYTES:  # many languages in one partition
            largest = max(shards, key=lambda one: shards[one].size)
            yield shards.pop(largest).row(partition, next(sequence))
    for shard in shards.values():
        yield shard.row(partition, next(sequence))


class Shard:
    def __init__(self, lang: str):
        self.lang, self.size, self.numbers = lang, 0, array("i")
        self.vocabulary: dict[bytes, int] = defaultdict(itertools.count(1).__next__)
        self.vocabulary[b"\xff"] = 0

    def add(self, text: str | None) -> None:
        if not text:
            return
        raw = text.encode("utf-8", "surrogatepass").translate(_LOWER)
        words = raw.replace(b"\xff", b" \xff ").split()
        self.numbers.extend(map(self.vocabulary.__getitem__, words))
        self.numbers.append(0)
        self.size += len(raw)

    def row(self, partition: int, sequence: int) -> pa.RecordBatch:
        if sequence >> SEQUENCE_BITS or partition >> 63 - NUMBER_BITS - SEQUENCE_BITS or len(self.vocabulary) >> NUMBER_BITS:
            raise ValueError("too many shards of a partition, partitions or words: choose larger shards")
        numbers = np.frombuffer(self.numbers, np.int32)
        del self.vocabulary[b"\xff"]
        counts = np.bincount(numbers, minlength=len(self.vocabulary) + 1)[1:]
        words = pa.array([list(self.vocabulary)], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
        columns = [
            pa.array([partition << SEQUENCE_BITS | sequence], pa.int64()),
            pa.array([self.lang]),
            words,
            pa.array([counts], pa.list_(pa.int64())),
            pa.array([len(counts)], pa.int32()),
            pa.array([len(numbers)], pa.int32()),
            pa.array([pack([numbers], np.int32)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "words", "counts", "n_words", "length", "text"])


def _build(batches):
    """The indexes of shards, from their texts and frequent words. Symbols count the frequent words from 1."""
    for batch in batches:
        for i in range(len(batch)):
            listed = batch.column("listed")[i].values.field("no").to_numpy()
            symbols = np.zeros(batch.column("n_words")[i].as_py() + 1, np.int32)
            symbols[listed + 1] = np.arange(1, len(listed) + 1)  # numbers count from 0 here, 0 is a separator in texts
            numbers = unpack(batch.column("text")[i].as_buffer(), batch.column("length")[i].as_py(), 1, np.int32)[0]
            text = runs(symbols[numbers])
            del numbers
            columns = [
                batch.column("shard")[i : i + 1],
                batch.column("lang")[i : i + 1],
                pa.array([batch.column("listed")[i].values.field("id").to_numpy()], pa.list_(pa.int64())),
                pa.array([starts_of(text, len(listed))], pa.list_(pa.int32())),
                pa.array([pack([symbols_before(text, len(listed))], np.int32)], pa.binary()),
                pa.array([pack([symbols_before(text[::-1], len(listed))], np.int32)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "lang", "ids", "first", "bwt", "reverse_bwt"])


def runs(text: np.ndarray) -> np.ndarray:
    """The runs of two or more symbols that are not 0, with a 0 before and after each."""
    inside = np.concatenate(([False], text > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    lengths = edges[1::2] - edges[::2]
    keep = np.repeat(lengths > 1, lengths)
    words = np.flatnonzero(text > 0)[keep]
    ends = np.cumsum(lengths[lengths > 1])
    return np.insert(text[words], np.concatenate(([0], ends)), 0) if len(words) else np.zeros(1, text.dtype)


def starts_of(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """Row of the first suffix of each symbol, and the end."""
    return np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols + 1)))).astype(np.int32)


def symbols_before(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """For each row the symbol before its suffix (Burrows-Wheeler transform)."""
    return text[suffix_order(text, n_symbols) - 1]


def steps_of(bwt: np.ndarray) -> np.ndarray:
    """For each row the row of the suffix one symbol longer; those that start with a separator are in any order."""
    steps = np.empty(len(bwt), np.int32)
    steps[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=np.int32)
    return steps


def lf_steps(text: np.ndarray, n_symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Row of the first suffix of each symbol (and the end), and for each row the row of the suffix one symbol longer."""
    return starts_of(text, n_symbols), steps_of(symbols_before(text, n_symbols))


def suffix_order(text: np.ndarray, n_symbols: int) -> np.ndarray:
    """The suffixes of a text that ends with 0, in order. Each 0 is smaller than all symbols and than the zeros after it."""
    n, bits = len(text), max(1, int(n_symbols).bit_length())
    width = max(1, min(63 // bits, n))
    key, ended, symbol = np.zeros(n, np.int64), np.zeros(n, bool), np.empty(n, np.int32)
    for ahead in range(width):
        symbol[: n - ahead], symbol[n - ahead :] = text[ahead:], 0
        symbol[ended] = 0
        ended |= symbol == 0
        key <<= bits
        key |= symbol
    del symbol
    # numbers of rows have 32 bits, and what is done with goes: the workers' memory is the tightest figure
    order = np.argsort(key, kind="stable").astype(np.int32)
    key = key[order]
    # a window with a separator is told apart from equal ones by its place, which a stable sort keeps
    head = np.concatenate(([True], key[1:] != key[:-1])) | ended[order]
    del key, ended
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), np.int32(0)))
    while True:
        size = np.diff(np.append(np.flatnonzero(head), n))
        tied = np.flatnonzero(np.repeat(size > 1, size)).astype(np.int32)
        if not len(tied):
            return order
        suffixes = order[tied]
        # tied suffixes hold no separator in their first words
        key = rank[suffixes].astype(np.int64) * n + rank[suffixes + width]
        by = np.argsort(key, kind="stable")
        order[tied], key = suffixes[by], key[by]
        del suffixes, by
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        del key
        head[tied] = fresh
        rank[order[tied]] = np.maximum.accumulate(np.where(fresh, tied, np.int32(0)))
        width *= 2


def slices(n: np.ndarray) -> list[tuple[int, int]]:
    """Runs of phrases (first, end) with some `SLICE` occurrences each, from the occurrences n of all."""
    starts = np.flatnonzero(np.diff(np.cumsum(n, dtype=np.int64) // SLICE, prepend=-1)).tolist() or [0]
    return [*zip(starts, [*starts[1:], len(n)], strict=True)]


def grow(first: np.ndarray, lf: np.ndarray, low: np.ndarray, other_low: np.ndarray, n: np.ndarray, begin: int = 0, end: int | None = None):
    """All extensions of phrases by one symbol: (phrase, symbol, low, other low, n) as arrays, by phrase and symbol.

    `low` are the rows of the phrases in the index of `lf`, `other_low` those in the index of the reversed text. Only the phrases
    from `begin` to before `end` are extended.
    """
    if begin or end is not None:
        own, *rest = grow(first, lf, low[begin:end], other_low[begin:end], n[begin:end])
        return own + begin, *rest
    phrase = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(phrase)) + np.repeat(low - (np.cumsum(n) - n), n)
    after = lf[rows]
    symbol = np.maximum(np.searchsorted(first, after, side="right") - 1, 0)  # rows of separators come first
    by = np.argsort(phrase * len(first) + symbol, kind="stable")
    phrase, symbol, after = phrase[by], symbol[by], after[by]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(by)), bool), (phrase[1:] != phrase[:-1]) | (symbol[1:] != symbol[:-1]))))
    count = np.diff(np.append(start, len(by)))
    own = phrase[start]
    smaller = start - (np.cumsum(n) - n)[own]  # neighbours of the phrase that come before this symbol
    some = symbol[start] > 0
    return own[some], symbol[start][some], after[start][some], (other_low[own] + smaller)[some], count[some]


def extended(first: np.ndarray, lf: np.ndarray, left: bool, ids: np.ndarray, low: np.ndarray, other: np.ndarray, n: np.ndarray, groups: int):
    """Extensions of frequent phrases whose part without the old end is frequent too: group, prefix, suffix, place and n, in this order.

    `low` are the rows of the phrases in the index, `other` those in the index of the reversed text; a place holds both.
    """
    starts, found = (low if left else other), []
    by = np.argsort(starts, kind="stable")
    ordered = starts[by]
    for a, b in slices(n):
        source, _, new, new_other, count = grow(first, lf, *((low, other) if left else (other, low)), n, a, b)
        # that part is a frequent phrase if the new interval lies within one of its intervals
        at = by[np.maximum(np.searchsorted(ordered, new, side="right") - 1, 0)] if len(by) else source
        inside = (new >= starts[at]) & (new < starts[at] + n[at])
        found.append([x[inside] for x in (source, at, new, new_other, count)])
    source, at, new, new_other, count = (np.concatenate(x) for x in zip(*found, strict=True))
    del found
    prefix, suffix = (ids[at], ids[source]) if left else (ids[source], ids[at])
    del source, at
    new, new_other = (new, new_other) if left else (new_other, new)
    place = new.astype(np.int64) << 32 | new_other.astype(np.int64)
    group = group_of(prefix, suffix, groups)
    by = np.lexsort((suffix, prefix, group))
    return group[by], prefix[by], suffix[by], place[by], count[by]


def group_of(prefix: np.ndarray, suffix: np.ndarray, groups: int) -> np.ndarray:
    """The group in which a phrase is summed: a hash of both its parts, so that the phrases of a frequent word are spread."""
    mixed = prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + suffix.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)


def pack(columns: list[np.ndarray], kind: type = np.int64) -> bytes:
    """Columns of whole numbers, of equal length: the first bytes of all numbers, then the second ones and so on, compressed."""
    width = np.dtype(kind).itemsize
    planes = [np.ascontiguousarray(np.ascontiguousarray(c, kind).view(np.uint8).reshape(len(c), width).T) for c in columns]
    return pa.compress(np.concatenate(planes).tobytes(), "zstd", asbytes=True)


def unpack(packed: bytes | pa.Buffer, rows: int, n_columns: int, kind: type = np.int64) -> np.ndarray:
    """The columns that `pack` took, one a row."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, width * rows * n_columns, "zstd"), np.uint8).reshape(n_columns, width, rows)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind)[:, :, 0]


def _read(size: int) -> list[str]:
    """Columns of the indexes that phrases of `size` words are grown from: pairs to the right, then to the left and so on."""
    return [*(["bwt"] if size % 2 else []), *(["reverse_bwt"] if size % 2 == 0 or size == 3 else [])]


def _grower(size: int, groups: int):
    """Phrases of `size` words in a shard, one row for each group in which they are summed. They count from 0 in the order of `extended`."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield one({c: batch.column(c)[i] for c in batch.schema.names})

    def one(row):
        ids, first = (row[c].values.to_numpy() for c in ("ids", "first"))
        lf, reverse_lf = (steps_of(unpack(row[c].as_buffer(), int(first[-1]), 1, np.int32)[0]) if c in row else None for c in ("bwt", "reverse_bwt"))
        low = other = first[1:-1]
        n, left = np.diff(first[1:]), size % 2 == 1
        if size > 2:
            listed = row["listed"].values
            blocks = zip(listed.field("packed"), listed.field("phrases").to_pylist(), strict=True)
            own, *rest = np.concatenate([_reply(packed.as_buffer(), rows, size - 1) for packed, rows in blocks], axis=1)
            if size == 3:
                rest = [x[rest[0]] for x in extended(first, reverse_lf, False, ids, low, other, n, groups)[3:]]
            place, n = rest
            ids, low, other = own, place >> 32, place & 0xFFFFFFFF
        group, prefix, suffix, place, n = extended(first, lf if left else reverse_lf, left, ids, low, other, n, groups)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        columns = [prefix, suffix, n] if size == 2 else [prefix, suffix, n, place >> 32, place & 0xFFFFFFFF]
        lengths = np.diff(np.append(starts, len(group)))
        packed = []
        for a, k in zip(starts.tolist(), lengths.tolist(), strict=True):
            block = [c[a : a + k] for c in columns]
            packed.append(pack([*(np.diff(c, prepend=0) for c in block[:2]), *block[2:]]))
        out = [
            pa.array(group[starts]),
            pa.array(np.full(len(starts), row["shard"].as_py(), np.int64)),
            pa.array(starts.astype(np.int64)),
            pa.array(lengths.astype(np.int32)),
            pa.array(packed, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(out, ["group", "shard", "start", "phrases", "packed"])

    return run


def _summer(size: int, groups: int, min_count: int):
    """The phrases of a group whose counts over all shards reach `min_count`, with a number and that sum, and the replies to the shards."""

    def run(table: pa.Table) -> pa.Table:
        length, group = table.column("phrases").to_numpy(), table.column("group")[0].as_py()
        blocks = zip(table.column("packed").to_pylist(), length.tolist(), strict=True)
        columns = [unpack(packed, rows, 3 if size == 2 else 5) for packed, rows in blocks]
        for block in columns:
            np.cumsum(block[:2], axis=1, out=block[:2])
        prefix, suffix, n, *place = np.concatenate(columns, axis=1)
        del columns
        by = np.lexsort((suffix, prefix))
        starts = np.flatnonzero(np.append(True, (np.diff(prefix[by]) != 0) | (np.diff(suffix[by]) != 0)))
        f = np.add.reduceat(n[by], starts)
        frequent = f >= min_count
        numbers = (np.cumsum(frequent) - 1) * groups + group
        at = np.empty(len(n), np.int64)  # the phrase of each entry
        at[by] = np.repeat(np.arange(len(f)), np.diff(np.append(starts, len(n))))
        replies, end = [], np.cumsum(length).tolist()
        for shard, start, k, e in zip(*(table.column(c).to_pylist() for c in ("shard", "start", "phrases")), end, strict=True):
            kept = e - k + np.flatnonzero(frequent[at[e - k : e]])
            if len(kept):
                rest = [place[0][kept], place[1][kept], n[kept]] if place else [np.diff(kept - (e - k) + start, prepend=0)]
                replies.append({"shard": shard, "phrases": len(kept), "packed": pack([numbers[at[kept]], *rest])})
        first = by[starts[frequent]]
        found = [numbers[frequent], prefix[first], suffix[first], f[frequent]]
        reply = pa.list_(pa.struct({"shard": pa.int64(), "phrases": pa.int32(), "packed": pa.binary()}))
        out = [pa.array([group], pa.int64()), *[pa.array([c], pa.list_(pa.int64())) for c in found], pa.array([replies], reply)]
        return pa.table(out, names=["group", "ids", "prefixes", "suffixes", "sums", "replies"])

    return run


def _reply(packed: pa.Buffer, rows: int, size: int) -> np.ndarray:
    """What a group of `_summer` sent back on phrases of `size` words: ids and numbers of pairs; ids, places and counts of longer ones."""
    own, *rest = unpack(packed, rows, 2 if size == 2 else 4)
    return np.stack([own, np.cumsum(rest[0])]) if size == 2 else np.stack([own, rest[0] << 32 | rest[1], rest[2]])


def _spelled(level: DataFrame, shorter: DataFrame) -> DataFrame:
    """The phrases of a level with their words and the counts of their beginnings and ends."""
    head = shorter.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"), "heads")
    tail = shorter.select(F.col("id").alias("suffix"), "last", "tails")
    joined = level.join(head, "prefix").join(tail, "suffix")
    return joined.select(
        "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "f", F.array_append("heads", F.col("f")).alias("heads"),
        F.array_append("tails", F.col("f")).alias("tails"), "last", "prefix", "suffix",
    )


def _scored(levels: list[DataFrame], totals: DataFrame, top: int, subsumed_percent: int) -> DataFrame:
    out = None
    for size, level in enumerate(levels[1:], 2):
        longer = levels[size] if size < len(levels) else None
        if longer is None:
            found = level.withColumn("max_left", F.lit(None).cast("bigint")).withColumn("max_right", F.lit(None).cast("bigint"))
        else:
            left = longer.groupBy(F.col("suffix").alias("id")).agg(F.max("f").alias("max_left"))
            right = longer.groupBy(F.col("prefix").alias("id")).agg(F.max("f").alias("max_right"))
            found = level.join(left, "id", "left").join(right, "id", "left")
        found = found.select("lang", "phrase", F.col("f").alias("a"), "heads", "tails", F.lit(size).alias("n_words"), "max_left", "max_right")
        out = found if out is None else out.unionByName(found)
    reach = F.coalesce(F.greatest("max_left", "max_right"), F.lit(0))
    out = out.filter(reach * 100 < F.col("a") * subsumed_percent).join(totals, "lang")
    score = (
        "(cast(1000 as decimal(4, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))) div "
        "(cast(heads[k - 1] as decimal(19, 0)) * cast(tails[n_words - k - 1] as decimal(19, 0)))"
    )
    cut = F.expr(f"array_min(transform(sequence(1, n_words - 1), k -> struct({score} as score, k as k)))")
    out = out.withColumn("cut", cut).select(
        "lang", "phrase", "a", F.expr("heads[cut.k - 1]").alias("l"), F.expr("tails[n_words - cut.k - 1]").alias("r"),
        "n", "cut.score", "n_words", "max_left", "max_right",
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "n_words", "max_left", "max_right")
