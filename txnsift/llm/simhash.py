"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance.

Fingerprints: A-Z lowered, words are runs without ASCII white space, shingles of three words with repeats (a
shorter text is one shingle); a bit is set when it is set in over half of the XXH64 values. Texts without words and
nulls have fingerprint zero.

Links (pigeonhole): 64 bits are cut into `BLOCKS` blocks. Two fingerprints that differ in at most d bits agree in at
least BLOCKS - d blocks, so distinct fingerprints are joined on each choice of BLOCKS - d blocks and verified by
their Hamming distance. A block that many distinct fingerprints share is not joined to itself: its fingerprints
meet, still within the block, on the values that they reach by flipping d / 2 of the remaining bits. Two within d bits always have
such a value in common and all that share one are within d bits, so a star over each value keeps every connection
without forming all pairs. Copies are one fingerprint from the start.

Components come from alternating large-star and small-star steps, each one a written table, until nothing moves.
The component of a document is the smallest doc_id that it reaches; null ids count only where a group has no other.
Repeated rows stay rows. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.llm.common import arrow_map, extended
from txnsift.session import materialize

#: Words of a shingle, seed of its hash.
SHINGLE, SEED = 3, 42
#: Pieces of a fingerprint; keys join on BLOCKS - distance of them.
BLOCKS = 4
#: Distinct fingerprints of one block value above which they are linked through shared neighbours.
DENSE = 48


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    values = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
    return _majority(np.array(values, dtype="<u8"))


def _majority(values: np.ndarray) -> int:
    """Bits that are set in over half of the values. Long lists are counted in steps of bounded memory."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "__fp") -> DataFrame:
    """`docs` with the fingerprint as a signed 64-bit number in column `name`."""

    def add(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield batch.append_column(name, pa.array(found))

    return arrow_map(docs, add, extended(docs, T.StructField(name, T.LongType())))


def _masks(blocks: int, distance: int) -> list[int]:
    """For each choice of blocks - distance blocks, the bits that they cover."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [sum(choice) for choice in itertools.combinations(pieces, blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_pairs(prints: DataFrame, distance: int = 2, blocks: int = BLOCKS, dense: int = DENSE) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints of the column `fp`.

    Each link is within `distance` bits; every two fingerprints within it are connected by links. `distance` is
    even, so that two of them meet halfway.
    """
    if distance % 2 or not 0 < distance < blocks:
        raise ValueError("distance: an even number below the number of blocks")
    masks = _masks(blocks, distance)
    keys = [F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)]
    keyed = materialize(prints.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.k", "key.v"), "blocks")
    shared = keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = materialize(keyed.join(shared, ["k", "v"]), "shared")

    few = shared.filter(F.col("n") <= dense)
    left, right = few.select("k", "v", F.col("fp").alias("a")), few.select("k", "v", F.col("fp").alias("b"))
    pairs = (
        left.join(right, ["k", "v"])
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )

    many = shared.filter(F.col("n") > dense)
    flips = None
    for i, mask in enumerate(masks):
        free = [b for b in range(64) if not mask >> b & 1]
        own = [
            _signed(sum(1 << b for b in choice))
            for size in range(distance // 2 + 1)
            for choice in itertools.combinations(free, size)
        ]
        column = F.array(*[F.lit(x).cast("bigint") for x in own])
        flips = F.when(F.col("k") == i, column) if flips is None else flips.when(F.col("k") == i, column)
    reached = many.select("k", "v", "fp", F.explode(flips).alias("flip"))
    stars = (
        reached.groupBy("k", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
        .agg(F.collect_list("fp").alias("members"))  # at most as many as there are flips
        .filter(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .filter("a < b")
    )
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large.filter("u != v"), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = materialize(small.distinct(), "small-star")
        moved = after.join(edges, ["u", "v"], "left_anti").limit(1).count() or edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not moved:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _labelled(docs: DataFrame, doc_id: str, text: str, distance: int, blocks: int, dense: int) -> DataFrame:
    """Per row: id, text_hash, fp, root (a fingerprint of the component) and component_id."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    marked = materialize(with_fingerprints(slim, "text", "fp").select("id", "text_hash", "fp"), "fingerprints")
    prints = materialize(marked.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    parts = components(near_pairs(prints.select("fp"), distance, blocks, dense))
    linked = prints.join(parts, prints["fp"] == parts["node"]).select("fp", "root", "least")
    roots = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    named = linked.join(roots, "root").select("fp", "root", "smallest")
    labels = prints.join(named, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id")
    )
    return marked.join(labels, "fp")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, blocks: int = BLOCKS, dense: int = DENSE
) -> DataFrame:
    """Per document: `doc_id`, fingerprint (16 hexadecimal digits), component_id."""
    return _labelled(docs, doc_id, text, distance, blocks, dense).select(
        F.col("id").alias(doc_id),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def first_rows(rows: DataFrame, group: str) -> DataFrame:
    """Of each group of rows (id, text_hash, n): the smallest id (no id comes last), then the smaller hash, as `first`."""
    return rows.groupBy(group).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "n")).alias("first"))


def keep_rows(docs: DataFrame, firsts: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of `docs` that `firsts` names; rows that repeat both id and text are one."""
    kept = firsts.select(F.col("first.id").alias("__id"), F.col("first.text_hash").alias("__hash"), F.col("first.n").alias("__n"))
    kept = materialize(kept, "kept")
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__hash"))
    found = docs.join(kept, same)
    single = found.filter("__n = 1").select(docs.columns)
    return single.unionByName(found.filter("__n > 1").dropDuplicates([doc_id, "__hash"]).select(docs.columns))


def drop_near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", distance: int = 2, blocks: int = BLOCKS, dense: int = DENSE
) -> DataFrame:
    """The rows of `docs`, one of each component: its smallest id (no id comes last), then the smaller text hash.

    Rows that repeat both id and text are one. Only ids and hashes are grouped; whole rows are joined once.
    """
    rows = _labelled(docs, doc_id, text, distance, blocks, dense).groupBy("root", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return keep_rows(docs, first_rows(rows, "root"), doc_id, text)
