"""URL rules judged by cascades of Bloom filters, in Spark expressions only.

A rule is a host and a path. It fits its host and all subdomains when the path of the url starts with its own
path; the longest rule that fits wins. For each length of host and path that occurs among the rules, a url has at
most one key (the end of its host and the start of its path), so the keys of a corpus are a finite universe.

For each verdict a cascade is built over that universe: level 0 encodes the listed keys, level 1 the other keys that
level 0 lets through, level 2 the listed keys that level 1 lets through, and so on until a level lets nothing wrong
through. Membership of every key that occurs is then exact, and judging rows needs no join and no shuffle. Only keys
that pass level 0 are ever shuffled. Where level 0 of a verdict would exceed `MAX_FILTER_BITS`, rules are joined instead, once for
each length, with the same results.

Nulls and urls without `://` have an empty host and path and no rule. An empty rule table leaves every url to
the default verdict. A rule listed under both verdicts allows. Rows that repeat are judged alike; other columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnsift.llm.common import ascii_lower
from txnsift.session import materialize, small_rows

_HOST = r"(?s)^.*?://([^/?#]*)"
_PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"

#: Largest filter that is put into the plan (8 MB). Longer lists are judged by equi-joins on the keys.
MAX_FILTER_BITS = 1 << 26


def url_host(url: Column) -> Column:
    """From the first `://` to the next `/`, `?`, `#` or the end, A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host to the next `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, _PATH, 1), F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bits as 64-bit words in decimal, separated by commas."""

    words: str
    bits: int
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        table = F.split(F.lit(self.words), ",").cast("array<bigint>")
        hit = F.lit(True)
        for at in _positions(key, self.bits, self.hashes, self.seed):
            hit = hit & (F.getbit(F.get(table, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return hit


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    first = F.pmod(F.xxhash64(F.lit(2 * seed), key), F.lit(bits))
    step = F.pmod(F.xxhash64(F.lit(2 * seed + 1), key), F.lit(bits))
    return [F.pmod(first + F.lit(i) * step, F.lit(bits)) for i in range(hashes)]


def filter_shape(n_keys: int, rate: float) -> tuple[int, int]:
    """Bits (a multiple of 64) and hash functions for `n_keys` at a rate of false positives."""
    bits = max(1, math.ceil(1.4427 * max(1, n_keys) * math.log2(1 / rate) / 64)) * 64
    return bits, max(1, round(math.log2(1 / rate)))


def build_level(keys: DataFrame, n_keys: int, rate: float, seed: int) -> Level:
    """The filter over the column `key`. Its bits are set by a grouped bit_or on the executors."""
    bits, hashes = filter_shape(n_keys, rate)
    words = (
        keys.select(F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at"))
        .groupBy(F.floor(F.col("at") / 64).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    )
    table = [0] * (bits // 64)
    for row in small_rows(words, "filter words", bits // 64):
        table[row["word"]] = row["bits"]
    return Level(",".join(map(str, table)), bits, hashes, seed)


def build_cascade(listed: DataFrame, others: DataFrame, first_rate: float, next_rate: float, level0: Level) -> list[Level]:
    """Levels after which every key of `listed` and of `others` is told apart exactly.

    Both have one column `key`; `others` may lack keys that level 0 rejects. Level seeds differ, so a key that one
    level confuses is a new draw on the next one, and the loop ends.
    """
    levels, inside, outside = [level0], listed, others
    while True:
        wrong = materialize(outside.filter(levels[-1].has(F.col("key"))), "cascade")
        n = wrong.count()
        if n == 0:
            return levels
        levels.append(build_level(wrong, n, next_rate, level0.seed + 2 * len(levels)))
        inside, outside = wrong, inside


def in_cascade(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the first level that rejects it tells."""
    listed = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        listed = F.when(levels[i].has(key), listed).otherwise(F.lit(i % 2 == 1))
    return listed


def _key(shape, host: Column, path: Column) -> Column:
    """The key of a url for one length of host and path; null where it has none."""
    h, p = shape["host_length"], shape["path_length"]
    whole = F.length(host) == h
    below = (F.length(host) > h) & (F.substring(host, -(h + 1), 1) == ".") if h else F.length(host) > 0
    end = F.substring(host, -h, h) if h else F.lit("")
    return F.when((F.length(host) > 0) & (whole | below) & (F.length(path) >= p), F.concat(end, F.substring(path, 1, p)))


def judge(
    urls: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
    first_rate: float = 1 / 64,
    next_rate: float = 1 / 2,
    max_filter_bits: int = MAX_FILTER_BITS,
) -> DataFrame:
    """`keep` columns of `urls` with host, path, rule (null if none fits) and verdict.

    `rules` has host, path and verdict (allow or block). A url that no rule fits is not a member of either list and
    gets `default`. The rule table may be long; its filters have a checked size, beyond which keys are joined.
    """
    listed = (
        rules.select(
            ascii_lower(F.coalesce("host", F.lit(""))).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            "verdict",
        )
        .filter(F.col("host") != "")
        .groupBy("host", "path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("key", F.concat("host", "path"))
    )
    listed = materialize(listed, "rules")
    shapes = small_rows(
        listed.groupBy(F.length("host").alias("host_length"), F.length("path").alias("path_length")).count(), "rule lengths"
    )
    shapes.sort(key=lambda s: (s["host_length"] + s["path_length"], s["host_length"]), reverse=True)
    source = urls.select(
        *[F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)],
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
    )
    sizes = {r["verdict"]: r["count"] for r in listed.groupBy("verdict").count().collect()}
    if all(filter_shape(n, first_rate)[0] <= max_filter_bits for n in sizes.values()):
        judged = _by_cascade(source, listed, sizes, shapes, first_rate, next_rate)
    else:
        judged = _by_join(source, listed, shapes)
    return judged.select(
        *[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)],
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
    )


def _by_cascade(source: DataFrame, listed: DataFrame, sizes: dict, shapes: list, first_rate: float, next_rate: float):
    host, path = F.col("host"), F.col("path")
    first = {}
    for i, verdict in enumerate(sorted(sizes)):
        own = listed.filter(F.col("verdict") == verdict).select("key")
        first[verdict] = build_level(own, sizes[verdict], first_rate, i)
    cascades = {}
    if first:
        passing = F.lit(False)
        for level in first.values():
            passing = passing | level.has(F.col("key"))
        universe = (
            source.select(F.explode(F.array(*[_key(s, host, path) for s in shapes])).alias("key"))
            .filter(F.col("key").isNotNull() & passing)
            .distinct()
        )
        universe = materialize(universe.unionByName(listed.select("key")).distinct(), "universe")
        for verdict, level in first.items():
            own = listed.filter(F.col("verdict") == verdict).select("key")
            others = universe.join(own, "key", "left_anti")
            cascades[verdict] = build_cascade(own, others, first_rate, next_rate, level)
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for shape in reversed(shapes):
        key = _key(shape, host, path)
        for verdict, levels in cascades.items():
            found = F.when(
                F.coalesce(in_cascade(levels, key), F.lit(False)) & key.isNotNull(),
                F.struct(key.alias("rule"), F.lit(verdict).alias("verdict")),
            ).otherwise(found)
    return source.withColumn("found", found)


def _by_join(source: DataFrame, listed: DataFrame, shapes: list) -> DataFrame:
    """The same answer for lists beyond the size of a filter: one equi-join for each length of rule."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for i, shape in enumerate(shapes):
        own = listed.filter(
            (F.length("host") == shape["host_length"]) & (F.length("path") == shape["path_length"])
        ).select(F.col("key").alias(f"__key_{i}"), F.col("verdict").alias(f"__verdict_{i}"))
        source = source.join(own, _key(shape, F.col("host"), F.col("path")) == F.col(f"__key_{i}"), "left")
    for i in reversed(range(len(shapes))):
        found = F.when(
            F.col(f"__key_{i}").isNotNull(),
            F.struct(F.col(f"__key_{i}").alias("rule"), F.col(f"__verdict_{i}").alias("verdict")),
        ).otherwise(found)
    return source.withColumn("found", found)
