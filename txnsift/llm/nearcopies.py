"""Near copies by SimHash fingerprints and, beyond their reach, by the Jaccard similarity of word shingles.

With a `distance`, texts whose 64-bit SimHash fingerprints (see `simhash`: three-word shingles) differ in so many bits or fewer are
linked. That finds copies with hardly a change. Copies with more changes are found by MinHash bands and verified exactly:

Shingles: A-Z lowered, words are runs without ASCII white space, the set of all runs of five words (a shorter text is one
shingle), by XXH64. Two texts are linked when their sets have a Jaccard similarity of `SIMILARITY` or more.

Blocks of one 64-bit SimHash cannot find all of these pairs: they differ in up to 11 bits (three-word fingerprints, sf0.01), and
blocks that survive 12 changed bits are 4 to 5 bits wide, which most texts share. Here each text has `BANDS` fingerprints of `ROWS` MinHash
values each; a pair of similarity s shares one of them with probability 1 - (1 - s^ROWS)^BANDS: above 0.999996 at 0.8.

Texts of one band value meet in two steps, so that a large group forms no pairs among itself. First each is verified
against a leader of the band value, and components are formed. Then texts of one band value that are still in
different components (those of the fingerprints included) are verified against each other (of large band values, those that share one of their rarest shingles). What remains apart has been compared and found below the limit. Equal
word sequences are one text from the start; texts without words, and nulls, are one text.

The document of the smallest id stays of each component (no id comes last). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnsift.llm.common import arrow_map
from txnsift.llm.simhash import components, fingerprint, first_rows, keep_rows, near_pairs
from txnsift.session import materialize

#: Words of a shingle, seed of its hash, similarity of near copies.
SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
#: Fingerprints of a text, MinHash values of each, leaders of a band value's texts.
BANDS, ROWS, LEADERS = 32, 5, 4
#: Texts of one band value above which pairs are sought by their rarest shingles.
DENSE = 48
#: Shingles whose MinHash values are computed at once.
PIECE = 2048


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes]) -> np.ndarray:
    """The hashes of the shingles, with repeats."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(joined, SEED)] if words else [], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - SHINGLE] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)], "<u8")


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return (rng.integers(0, 1 << 31, (n, 1)) * 2 + 1).astype(np.uint32), rng.integers(0, 1 << 32, (n, 1)).astype(np.uint32)


_FACTORS, _MASKS = _functions()


def bands(values: np.ndarray) -> list[int]:
    """The band values (signed) of a set of shingle hashes; none of an empty set."""
    if not len(values):
        return []
    low = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), PIECE):
        mixed = low[None, at : at + PIECE] ^ _MASKS
        mixed *= _FACTORS
        np.minimum(least, mixed.min(axis=1), out=least)
    rows = least.astype("<u4").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _marked(slim: DataFrame) -> DataFrame:
    """id, text_hash, words (128-bit hash of the word sequence), fp (SimHash) and bands of rows (id, text_hash, text)."""

    def mark(batches):
        for batch in batches:
            hashes, prints, found = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                prints.append(fingerprint(text.as_py()))
                hashes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else b"")
                found.append(bands(shingles(words)))
            columns = [batch.column(0), batch.column(1), pa.array(hashes, pa.binary())]
            columns += [pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "words", "fp", "bands"])

    id_type = slim.schema["id"].dataType.simpleString()
    return arrow_map(slim, mark, f"id {id_type}, text_hash bigint, words binary, fp bigint, bands array<bigint>")


def _sets(texts: DataFrame) -> DataFrame:
    """key and the sorted shingle hashes of rows (key, text)."""

    def pack(batches):
        for batch in batches:
            packed = [np.unique(shingles(words_of(t.as_py()))).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["key", "hashes"])

    return arrow_map(texts, pack, "key bigint, hashes binary")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats, not both empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""

    def verify(batches):
        for batch in batches:
            good = [
                jaccard(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) >= similarity
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("left")), "a").join(
        sets.select(F.col("key").alias("b"), F.col("hashes").alias("right")), "b"
    )
    return arrow_map(both.select("a", "b", "left", "right"), verify, "a bigint, b bigint")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _leader_pairs(shared: DataFrame) -> DataFrame:
    """Each key of a band value and the leader of that value. Bands differ in their choice of leaders."""
    order = F.xxhash64("key", F.col("band") % LEADERS)
    leaders = shared.groupBy("band", "value").agg(F.min(F.struct(order.alias("by"), "key"))["key"].alias("a"))
    return _ordered(shared.join(leaders, ["band", "value"]).filter("key <> a").select("a", F.col("key").alias("b")))


def _open_pairs(shared: DataFrame, parts: DataFrame, named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of one band value that are in different components.

    In values of at most `DENSE` texts the largest component meets the rest, the rest meets itself; a component never
    meets itself. A pair comes out once, at the first band that it shares. Texts of larger values meet by `_prefix_pairs`.
    """
    rooted = shared.join(parts, F.col("key") == F.col("node"), "left").select(
        "band", "value", "key", F.coalesce("root", "key").alias("root")
    )
    sizes = rooted.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band", "value").agg(
        F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("n_roots"), F.sum("n").alias("n_texts")
    )
    mixed = rooted.join(main.filter("n_roots > 1").drop("n_roots"), ["band", "value"])
    mixed = materialize(mixed.withColumn("rest", F.col("root") != F.col("main")).drop("main"), "mixed")
    few = mixed.filter(F.col("n_texts") <= DENSE).join(named.select("key", F.col("bands").alias("all")), "key")
    rest = few.filter("rest").select("band", "value", F.col("key").alias("a"), F.col("root").alias("root_a"), F.col("all").alias("all_a"))
    other = few.select("band", "value", F.col("key").alias("b"), F.col("root").alias("root_b"), "rest", F.col("all").alias("all_b"))
    meets = (F.col("root_a") != F.col("root_b")) & (~F.col("rest") | (F.col("a") < F.col("b")))
    earlier = F.arrays_overlap(F.slice("all_a", 1, F.col("band")), F.slice("all_b", 1, F.col("band")))  # bands count from 0
    pairs = rest.join(other, ["band", "value"]).filter(meets & ~earlier).select("a", "b")
    dense = mixed.filter(F.col("n_texts") > DENSE).select("key", "root").distinct()
    return _ordered(pairs.unionByName(_prefix_pairs(dense, sets, similarity)))


def _prefix_pairs(texts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of `texts` (key, root) with different roots that can reach the similarity.

    Each set is ordered by how many of the texts hold a shingle, rarest first. Two sets of similarity s share one of
    their first n - ceil(s n) + 1 shingles, neither is smaller than s times the other, and after the first shingle that they share
    enough must be left in both for s / (1 + s) of their sizes to be common. So nothing is lost, and texts that differ from
    another in a ninth of their shingles, rare ones as a rule, do not meet it.
    """

    def unpack(batches):
        for batch in batches:
            held = [np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(held, pa.list_(pa.int64()))], ["key", "root", "held"])

    lists = arrow_map(texts.join(sets, "key").select("key", "root", "hashes"), unpack, "key bigint, root bigint, held array<bigint>")
    single = materialize(lists.select("key", "root", F.size("held").alias("n"), F.explode("held").alias("shingle")), "dense-shingles")
    counts = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("n_texts"))
    ordered = F.sort_array(F.collect_list(F.struct("n_texts", "shingle")))
    reach = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9).cast("int") + 1
    front = single.join(counts, "shingle").groupBy("key", "root", "n").agg(ordered.alias("held"))  # one text's shingles
    front = front.select("key", "root", "n", F.posexplode(F.slice("held", F.lit(1), reach)).alias("at", "one"))
    front = front.filter("one.n_texts > 1").select("key", "root", "n", (F.col("n") - F.col("at")).alias("left"), "one.shingle")
    front = materialize(front, "dense-fronts")
    left, right = (front.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("key", "root", "n", "left")]) for x in "ab")
    close = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-9
    enough = F.least("left_a", "left_b") >= similarity / (1 + similarity) * (F.col("n_a") + F.col("n_b")) - 1e-9
    meets = (F.col("key_a") < F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & close & enough
    return left.join(right, "shingle").filter(meets).select(F.col("key_a").alias("a"), F.col("key_b").alias("b")).distinct()


def _print_links(named: DataFrame, distance: int) -> DataFrame:
    """The texts (a, b) whose SimHash fingerprints are linked: a star around the smallest key of each component."""
    prints = materialize(named.groupBy("fp").agg(F.min("key").alias("least")), "prints")
    parts = components(near_pairs(prints.select("fp"), distance))
    rooted = prints.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    centres = rooted.groupBy("root").agg(F.min("least").alias("a"))
    stars = rooted.join(centres, "root").select("fp", "a")
    return named.select("fp", F.col("key").alias("b")).join(stars, "fp").filter("a <> b").select("a", "b")


def _links(docs: DataFrame, doc_id: str, text: str, named: DataFrame, similarity: float, distance: int) -> DataFrame:
    """(node, root) of the keys of `named` (key, id, text_hash, fp, bands) that have near copies."""
    prints = materialize(_print_links(named, distance), "print-links") if distance else None
    banded = named.select("key", F.posexplode("bands").alias("band", "value"))  # 32 narrow rows a text
    several = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = materialize(banded.join(several, ["band", "value"]), "shared")

    near = named.join(shared.select("key").distinct(), "key").select("key", "id", F.col("text_hash").alias("hash"))
    texts = docs.select(F.col(doc_id).alias("__own"), F.col(text).alias("__text"))
    same = F.col("__own").eqNullSafe(F.col("id")) & (F.xxhash64("__text") == F.col("hash"))
    texts = texts.join(near, same).groupBy("key").agg(F.min("__text").alias("text"))
    sets = materialize(_sets(texts), "sets")

    first = materialize(_verified(_leader_pairs(shared), sets, similarity), "leader-links")
    first = first.unionByName(prints) if distance else first
    parts = materialize(components(first), "parts")
    second = materialize(_verified(_open_pairs(shared, parts, named, sets, similarity), sets, similarity), "open-links")
    if not second.limit(1).count():
        return parts
    return components(first.unionByName(second))


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, distance: int = 0) -> DataFrame:
    """The rows of `docs`, one of each component: its smallest id (no id comes last), then the smaller text hash.

    SimHash fingerprints within `distance` bits link texts as well; with 0 the similarity alone counts. Rows that repeat both id and text are one. Only ids and hashes are grouped; whole rows are joined once.
    """
    slim = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    marked = materialize(_marked(slim), "marked")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")).alias("one")  # no id comes last
    counted = marked.groupBy("words", "id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    # equal word sequences have equal fingerprints and bands
    named = counted.groupBy("words").agg(one, F.min_by("n", F.struct(F.col("id").isNull(), "id", "text_hash")).alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    named = named.select("one.id", "one.text_hash", "n", "fp", "bands", F.monotonically_increasing_id().alias("key"))
    named = materialize(named, "named")  # keys are used only as written
    parts = _links(docs, doc_id, text, named, similarity, distance)
    rooted = named.join(parts, F.col("key") == F.col("node"), "left").select(F.coalesce("root", "key").alias("root"), "id", "text_hash", "n")
    return keep_rows(docs, first_rows(rooted, "root"), doc_id, text)
