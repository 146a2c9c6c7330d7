"""Language identification by rank-order n-gram profiles.

A text is lowered and cut into words of letters, each with a blank at both ends. Its n-grams of one to `MAX_N`
characters are counted over the whole text, none crossing from word to word, and ranked by count; equal counts go
to the smaller n-gram code. A language profile is the same ranking over its training texts. The out-of-place distance
sums, over the `TOP` first n-grams of a text, how far each one's rank is from its rank in the profile; an n-gram that
the profile lacks counts `TOP`. The nearest profile is the prediction; ties go to the smaller language name.
score = 1 - distance / largest possible distance, 0 to 1.

Training uses a bounded sample of labelled rows (`train_rows` per language, chosen by a hash of the id); counts
of an n-gram are summed on the executors and only the profiles (`TOP` rows per language) reach the driver.
Prediction reads the text alone. Null texts and texts without letters are `und` with score 0, as are all texts when
there is nothing to learn from. Repeated rows, and documents with null ids, are predicted alike; rows of null
language are not learned from. Other columns pass through `with_language` and are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.llm.common import arrow_map, extended
from txnsift.session import small_rows

#: Longest n-gram, n-grams of a profile, training rows per language, languages.
MAX_N, TOP, TRAIN_ROWS, MAX_LANGUAGES = 3, 400, 4000, 1000
#: Text that is counted at once; longer texts are counted in pieces cut between words.
PIECE = 1 << 20
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(len(table)):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams of a whole text. A code packs n characters of 21 bits."""
    points = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if len(points) <= PIECE:
        return _counted(points)
    cuts, at = [0], 0
    while at + PIECE < len(points):
        gaps = np.flatnonzero(points[at + 1 : at + PIECE] == 0)
        at = at + 1 + int(gaps[-1]) if len(gaps) else at + PIECE
        cuts.append(at)
    parts = [_counted(points[a:b]) for a, b in zip(cuts, [*cuts[1:], len(points)], strict=True)]
    codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = points != 0
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the one blank after each word
    chars = np.concatenate(([0], points[keep], [0])).astype(np.uint64)
    letter = chars != 0
    grams, code, whole = [chars[letter]], chars, letter
    for n in range(2, MAX_N + 1):
        # between the first and the last character there are only letters
        whole = np.ones(len(chars) - 1, bool) if n == 2 else whole[:-1] & letter[n - 2 : len(chars) - 1]
        code = (code[:-1] << np.uint64(21)) | chars[n - 1 :]
        grams.append(code[whole & (letter[: len(code)] | letter[n - 1 :])] | np.uint64(n - 1) << np.uint64(62))
    ordered = np.sort(np.concatenate(grams))
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _top(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The `TOP` most frequent codes, most frequent first."""
    if len(codes) > TOP:
        least = np.partition(counts, len(counts) - TOP)[len(counts) - TOP]
        near = counts >= least
        codes, counts = codes[near], counts[near]
    return codes[np.lexsort((codes, -counts))[:TOP]]


class Profiles:
    """Ranks of all profile n-grams in each language."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(ranked)
        self.codes = np.unique(np.array([c for p in ranked.values() for c in p], dtype=np.int64).view(np.uint64))
        self.ranks = np.full((len(self.names), len(self.codes) + 1), TOP * 2, np.int32)  # the last column: unknown
        for i, name in enumerate(self.names):
            own = np.array(ranked[name], dtype=np.int64).view(np.uint64)
            self.ranks[i, np.searchsorted(self.codes, own)] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text) if text else ((), ())
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        top = _top(codes, counts)
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        at[self.codes[at] != top] = len(self.codes)
        away = np.minimum(np.abs(self.ranks[:, at] - np.arange(len(top), dtype=np.int32)), TOP).sum(axis=1)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best] / (TOP * len(top)))


def fit_profiles(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS
) -> Profiles:
    """Profiles from up to about `train_rows` texts per language, chosen by the hash of their id."""
    slim = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.col(lang).alias("__lang"))
    slim = slim.filter(F.col("__lang").isNotNull() & F.col("__text").isNotNull())
    sizes = {r["__lang"]: r["n"] for r in small_rows(slim.groupBy("__lang").agg(F.count(F.lit(1)).alias("n")), "languages", MAX_LANGUAGES)}
    if not sizes:
        return Profiles({})
    share = F.pmod(F.xxhash64(F.lit("train"), "__id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for name, n in sizes.items():
        chosen = chosen | ((F.col("__lang") == name) & (share < min(1.0, train_rows / n)))

    def count(batches):
        totals: dict[str, list] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, counts = ngram_counts(value.as_py())
                parts = totals.setdefault(name, [])
                parts.append((codes, counts))
                if len(parts) >= 256:
                    parts[:] = [_summed(parts)]
        for name, parts in totals.items():
            codes, counts = _summed(parts)
            for at in range(0, len(codes), 1 << 16):
                some = codes[at : at + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some)), pa.array(some), pa.array(counts[at : at + (1 << 16)])], ["lang", "code", "n"]
                )

    counted = arrow_map(slim.filter(chosen).select("__lang", "__text"), count, "lang string, code bigint, n bigint")
    total = counted.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.expr("code < 0"), "code")  # as unsigned numbers
    ranked = total.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= TOP)
    profiles: dict[str, list] = {}
    for row in sorted(small_rows(ranked, "profiles", MAX_LANGUAGES * TOP), key=lambda r: r["at"]):
        profiles.setdefault(row["lang"], []).append(row["code"])
    return Profiles(profiles)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def with_language(
    docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "__lang_pred", score: str = "__lang_score"
) -> DataFrame:
    """`docs` with the predicted language and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def add(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = [model.predict(t.as_py()) for t in texts]
            names = pa.array([f[0] for f in found], pa.string())
            yield batch.append_column(lang, names).append_column(score, pa.array([f[1] for f in found], pa.float64()))

    fields = (T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType()))
    return arrow_map(docs, add, extended(docs, *fields))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0 (null: 0 as well)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def keep_identified(docs: DataFrame, profiles: Profiles, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The rows of `docs` whose text is in a learned language; `und` and texts far from all profiles go."""

    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def keep(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = (model.predict(t.as_py()) for t in texts)
            yield batch.filter(pa.array([name != UNKNOWN and score >= min_score for name, score in found], pa.bool_()))

    return arrow_map(docs, keep, docs.schema)
