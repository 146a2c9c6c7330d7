"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Each source has a target (`water_fill`): its weight's share of all words, at most `max_epochs` times its own size,
the excess reshared by weight. A source gives every document floor(target / size) times and, of one more pass, as
many documents as come near the rest.

Documents of a source are permuted by a hash of id and text and cut, in that order of hash ranges, into blocks of about
`block_words` words. The blocks of the last pass are taken in order while they fit into the rest; the
block at the edge gives the documents that still fit, tried in order of their hash, with exchanges that bring the sum nearer. So each source has an exact
quota of block draws. The draws of all sources are then dealt to the output shards: a node of the tree, a range of
shards, splits its vector of quotas by one draw from the multivariate hypergeometric distribution, which is the law
of a uniform shuffle of all draws. A shard recomputes the path from the root to itself from seeded nodes, so shards
are independent tasks and reruns agree. A shard draws its disjoint runs of the source's draws and is shuffled by
itself, on a hash of the row, its copy and the seed.

Null sources are a source of their own, the last one. Null and empty texts have size 0 and are never taken, like all
sources without words. Repeated rows are rows. Ties of the hash are equal rows. An empty table gives an
empty result. `mix` returns whole rows with every column of the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.llm.common import WORD, arrow_map
from txnsift.session import materialize, null_safe_join, small_rows, small_side

#: Words of a block and of an output shard, most passes over a source, most sources.
BLOCK_WORDS, SHARD_WORDS, MAX_EPOCHS, MAX_SOURCES = 1 << 18, 1 << 22, 3, 100_000
#: Most partitions of the written mix; a partition holds several shards beyond it.
MAX_PARTITIONS = 100_000


def text_words(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sizes: list[int], weights: list[float], max_epochs: float = MAX_EPOCHS) -> list[float]:
    """Targets that share sum(sizes) by weight, none above `max_epochs` times its size."""
    total = float(sum(sizes))
    targets = [0.0] * len(sizes)
    caps = [max_epochs * n for n in sizes]
    free = [i for i in range(len(sizes)) if weights[i] > 0]
    left = total
    while free:
        share = left / sum(weights[i] for i in free)
        full = [i for i in free if weights[i] * share >= caps[i]]
        if not full:
            for i in free:
                targets[i] = weights[i] * share
            break
        for i in full:
            targets[i] = float(caps[i])
            left -= caps[i]
        free = [i for i in free if i not in set(full)]
    return targets


def source_plan(slim: DataFrame, weights: tuple[float, ...], max_epochs: int, block_words: int) -> list[dict]:
    """Per source, by code point with null last: size, target, whole passes, rest, number of blocks."""
    totals = slim.groupBy("source").agg(F.sum("size").alias("n"))
    rows = small_rows(totals, "sources", MAX_SOURCES)
    rows.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = [int(r["n"]) for r in rows]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(rows))], max_epochs)
    plan = []
    for at, (row, size, target) in enumerate(zip(rows, sizes, targets, strict=True)):
        passes = min(max_epochs, int(target // size)) if size else 0
        rest = max(0.0, target - passes * size) if passes < max_epochs else 0.0
        blocks = max(1, round(size / block_words))
        plan.append({"at": at, "source": row["source"], "source_size": size, "target": target, "passes": passes, "rest": rest, "blocks": blocks})
    return plan


_PLAN = "at int, source string, source_size bigint, target double, passes int, rest double, blocks int"


def deal(spark: SparkSession, quotas: list[int], n_shards: int, seed: int) -> DataFrame:
    """(at, draw, shard): each draw of each source dealt to one shard, by the splitting tree."""
    total = sum(quotas)

    def before(shard: int) -> int:
        return total * shard // n_shards

    def leaves(wanted: np.ndarray):
        stack = [(0, n_shards, np.array(quotas, np.int64), np.zeros(len(quotas), np.int64))]
        while stack:
            low, high, counts, starts = stack.pop()
            first = np.searchsorted(wanted, low)
            if first == len(wanted) or wanted[first] >= high:
                continue
            if high - low == 1:
                yield low, counts, starts
                continue
            middle = (low + high) // 2
            rng = np.random.default_rng([seed, low, high])
            left = rng.multivariate_hypergeometric(counts, before(middle) - before(low), method="marginals")
            stack.append((middle, high, counts - left, starts + left))
            stack.append((low, middle, left, starts))

    def draws(batches):
        for batch in batches:
            for shard, counts, starts in leaves(np.sort(batch.column(0).to_numpy())):
                at = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                ends = np.cumsum(counts)
                draw = np.arange(len(at)) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
                shards = np.full(len(at), shard, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(draw), pa.array(shards)], ["at", "draw", "shard"])

    return arrow_map(spark.range(n_shards), draws, "at int, draw bigint, shard bigint")


@dataclass
class MixPlan:
    """Sources (a bounded list), the table of blocks (at, block, edge, left, shards), and the number of shards."""

    sources: list[dict]
    blocks: DataFrame
    n_shards: int
    seed: int

    def source_table(self) -> DataFrame:
        spark = self.blocks.sparkSession
        return spark.createDataFrame([tuple(s[c.split()[0]] for c in _PLAN.split(", ")) for s in self.sources], _PLAN)


def row_hash(doc_id: Column, text: Column, seed: int) -> Column:
    """The place of a row in its source's permutation."""
    return F.xxhash64(F.lit(seed), doc_id.cast("string"), text)


def _in_blocks(rows: DataFrame, table: DataFrame) -> DataFrame:
    """`rows` (source, mix and more) with the columns of their source and their block."""
    share = F.col("mix") / float(1 << 64) + 0.5
    block = F.least(F.floor(share * F.col("blocks")).cast("bigint"), F.col("blocks").cast("bigint") - 1)
    return null_safe_join(rows, F.broadcast(table), ["source"]).withColumn("block", block)


def plan_mix(
    rows: DataFrame,
    weights: tuple[float, ...] = (1, 2, 3),
    max_epochs: int = MAX_EPOCHS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 17,
) -> MixPlan:
    """The quotas of blocks and their shards. `rows` has source, size and mix (see `row_hash`)."""
    spark = rows.sparkSession
    sources = source_plan(rows, weights, max_epochs, block_words)
    plan = MixPlan(sources, rows, 1, seed)
    table = plan.source_table()
    sized = _in_blocks(rows.select("source", "size", "mix"), table).groupBy("at", "rest", "passes", "blocks", "block")
    sized = materialize(sized.agg(F.sum("size").alias("words")).withColumn("high", F.floor(F.col("block") / 1024)), "blocks")

    # words before each block, in two levels, so that no source's blocks are one group
    tops = sized.groupBy("at", "high").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("at").orderBy("high").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("at", "high", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("at", "high").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("within", F.coalesce(F.sum("words").over(within), F.lit(0))).join(tops, ["at", "high"])
    begin = F.col("base") + F.col("within")
    last = begin < F.col("rest")  # the last pass reaches it
    sized = sized.select(
        "at", "blocks", "block",
        (F.col("passes") + last.cast("int")).alias("copies"),
        (last & (begin + F.col("words") > F.col("rest"))).alias("edge"),
        (F.col("rest") - begin).alias("left"),
    )
    sized = materialize(sized, "quotas")
    # a block of a later pass follows all blocks of the pass before; blocks without rows have no draw
    order = F.expr("transform(sequence(0, copies), p -> struct(p as copy, p * cast(blocks as bigint) + block as place))")
    drawn = sized.filter("copies > 0").select("at", "block", F.explode(F.slice(order, 1, F.col("copies"))).alias("one"))
    drawn = drawn.select("at", "block", "one.copy", "one.place").withColumn("high", F.floor(F.col("place") / 1024))
    tops = drawn.groupBy("at", "high").agg(F.count(F.lit(1)).alias("n"))
    tops = tops.select("at", "high", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("at", "high").orderBy("place")) - 1
    drawn = drawn.withColumn("nth", nth).join(tops, ["at", "high"]).withColumn("draw", F.col("base") + F.col("nth"))
    drawn = materialize(drawn.select("at", "block", "copy", "draw"), "draws")

    counted = {r["at"]: r["n"] for r in small_rows(drawn.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "quotas", MAX_SOURCES)}
    n_shards = max(1, math.ceil(sum(s["target"] for s in sources) / shard_words))
    quotas = [counted.get(s["at"], 0) for s in sources]
    shards = (
        drawn.join(deal(spark, quotas, n_shards, seed), ["at", "draw"])
        .groupBy("at", "block")
        .agg(F.sort_array(F.collect_list(F.struct("copy", "shard"))).alias("dealt"))  # at most max_epochs
        .select("at", "block", F.transform("dealt", lambda d: d["shard"]).alias("shards"))
    )
    blocks = sized.join(shards, ["at", "block"]).select("at", "block", "edge", "left", "shards")
    plan.blocks, plan.n_shards = materialize(blocks, "dealt"), n_shards
    return plan


def _fill(sizes: np.ndarray, room: float) -> np.ndarray:
    """Which of `sizes`, in their order, to take so that their sum comes near `room`.

    First those that still fit; then, while it brings the sum nearer, one more is taken, or one that is taken gives way
    to another.
    """
    taken = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes.tolist()):
        if 0 < size <= room:
            taken[i] = True
            room -= size
    while True:
        outside = np.flatnonzero(~taken & (sizes > 0))
        if not len(outside):
            return taken
        outside = outside[np.argsort(sizes[outside], kind="stable")]
        inside = np.append(np.flatnonzero(taken), -1)  # -1: nothing gives way
        freed = np.where(inside >= 0, sizes[inside], 0)
        above = np.minimum(np.searchsorted(sizes[outside], freed + room), len(outside) - 1)
        tries = np.concatenate([above, np.maximum(above - 1, 0)])
        left = room + np.tile(freed, 2) - sizes[outside[tries]]
        best = int(np.argmin(np.abs(left)))
        if abs(left[best]) >= abs(room):
            return taken
        gone = inside[best % len(inside)]
        if gone >= 0:
            taken[gone] = False
        taken[outside[tries[best]]] = True
        room = left[best]


def _first_fit(rows: pa.Table) -> pa.Table:
    """Of one source's edge block: the last copy goes to rows that, in order of their hash, still fit."""
    rows = rows.sort_by([("mix", "ascending"), ("size", "ascending")])
    room = rows.column("left")[0].as_py() if rows.num_rows else 0.0
    taken = _fill(rows.column("size").to_numpy(), room)
    lists = [s if t else s[:-1] for s, t in zip(rows.column("shards").to_pylist(), taken, strict=True)]
    return rows.set_column(rows.schema.get_field_index("shards"), "shards", pa.array(lists, pa.list_(pa.int64())))


def place(rows: DataFrame, plan: MixPlan) -> DataFrame:
    """`rows` (source, size, mix and more) with source_size, target and shards, one for each copy that the mix takes."""
    keep = [*rows.columns, "source_size", "target", "shards"]
    blocks = small_side(plan.blocks, 200_000)
    none = F.expr("cast(array() as array<bigint>)")
    found = _in_blocks(rows, plan.source_table()).join(blocks, ["at", "block"], "left")
    inner = found.filter(~F.coalesce("edge", F.lit(False)))
    inner = inner.withColumn("shards", F.when(F.col("size") > 0, F.coalesce("shards", none)).otherwise(none)).select(keep)
    edge = found.filter("edge").select(*keep, "at", "left")
    fields = [edge.schema[c] for c in edge.columns]
    fitted = edge.groupBy("at").applyInArrow(_first_fit, T.StructType(fields))
    return inner.unionByName(fitted.select(keep))


def sized_rows(docs: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """Id, source, size and hash of every row: all that the plan needs, stored once."""
    return materialize(
        docs.select(
            F.col(doc_id).alias("id"),
            F.col(source).cast("string").alias("source"),
            text_words(F.col(text)).alias("size"),
            row_hash(F.col(doc_id), F.col(text), seed).alias("mix"),
        ),
        "sizes",
    )


def mix_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **options
) -> DataFrame:
    """The mix: the rows of `docs`, all columns, once for each copy taken, by shard and shuffled within each."""
    plan = plan_mix(sized_rows(docs, doc_id, text, source, seed), seed=seed, **options)
    rows = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col(source).cast("string").alias("source"),
        text_words(F.col(text)).alias("size"),
        row_hash(F.col(doc_id), F.col(text), seed).alias("mix"),
    )
    placed = place(rows, plan).select("row", "mix", F.posexplode("shards").alias("copy", "shard"))
    shuffled = placed.withColumn("order", F.xxhash64(F.lit(seed), "mix", "copy", "shard"))
    n = min(plan.n_shards, MAX_PARTITIONS)
    return shuffled.repartition(n, "shard").sortWithinPartitions("shard", "order").select("row.*")
