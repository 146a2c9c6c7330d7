"""Digest trees over key ranges: two versions of a table are compared from the top, and only ranges that differ are opened.

Leaves are ranges of `width` integer keys, with the count, xor and sum of row hashes; a parent is the digest of its at most `FANOUT`
children. Trees of one width have the same shape, whatever the tables hold, so any two can be compared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnsift.functions import row_hash60
from txnsift.operators.quality import schema_text
from txnsift.session import materialize, small_side

#: Children of a node.
FANOUT = 4096
#: Keys of a leaf; at least 4, so that no key reaches the node of rows without key.
WIDTH = 1000
#: The leaf of rows without key.
NO_KEY = -(1 << 61)


def leaf_of(key: Column, width: int = WIDTH) -> Column:
    """Number of the range of a key, rounded down for negative keys as well."""
    number = key.cast("bigint")
    rest = F.pmod(number, F.lit(width).cast("bigint"))
    # the quotient first, as a key near the least number has no room for the rest
    down = F.when((number < 0) & (rest != 0), F.lit(1)).otherwise(F.lit(0))
    return F.coalesce(F.call_function("div", number, F.lit(width).cast("bigint")) - down, F.lit(NO_KEY).cast("bigint"))


def _levels(width: int) -> int:
    levels, span = 0, (1 << 63) // width
    while span > 0:
        levels, span = levels + 1, span // FANOUT
    return levels


def digest_tree(df: DataFrame, key: str, columns: Sequence[str | Column], width: int = WIDTH) -> DataFrame:
    """(level, node, n_rows, digest), level 0 holding the key ranges; stored once, in a folder per level.

    Digests cover names and types of `columns`, every value, and repeated rows. Rows may come in any order. Rows of null
    key have a leaf of their own; an empty table has no rows.
    """
    if width < 4:
        raise ValueError("width: at least 4")
    chosen = df.select(*columns)
    plain = df.select(leaf_of(F.col(key), width).alias("node"), *[c if isinstance(c, Column) else F.col(c) for c in columns])
    plain = plain.toDF("node", *[f"c{i}" for i in range(len(chosen.columns))])
    hashed = plain.select("node", row_hash60(plain.columns[1:]).alias("h"))
    sums = hashed.groupBy("node").agg(
        F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("xor60"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum60")
    )
    text = F.concat_ws(":", "n_rows", "xor60", "sum60", F.lit(schema_text(chosen.dtypes)))
    level = materialize(sums.select("node", "n_rows", F.sha2(text, 256).alias("digest")), "leaves")
    tree = level.select(F.lit(0).alias("level"), "node", "n_rows", "digest")
    for depth in range(1, _levels(width) + 1):
        # an arithmetic shift rounds down, so the node of rows without key ends at the lowest parent
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        parts = F.transform(children, lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["digest"]))
        parent = F.shiftright("node", FANOUT.bit_length() - 1).alias("node")
        level = level.groupBy(parent).agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.concat_ws(",", parts), 256).alias("digest"))
        level = materialize(level, "digests")
        tree = tree.unionByName(level.select(F.lit(depth).alias("level"), "node", "n_rows", "digest"))
    return materialize(tree, "digest-tree", ["level"]).select("level", "node", "n_rows", "digest")


def changed_ranges(now: DataFrame, old: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, first_key, last_key, rows_now, rows_old) of the key ranges in which two trees of one width differ.

    Levels are read from the top, and below a node only where it differs. The range of rows without key has null bounds; a range
    that one side lacks has 0 rows there. Equal tables give no rows.
    """
    differing = None
    for level in range(_levels(width), -1, -1):
        sides = []
        for tree, name in ((now, "now"), (old, "old")):
            part = tree.where(F.col("level") == level).select("node", F.col("n_rows").alias(f"rows_{name}"), F.col("digest").alias(name))
            if differing is not None:
                above = F.shiftright("node", FANOUT.bit_length() - 1)
                part = part.withColumn("parent", above).join(small_side(differing), "parent", "left_semi").drop("parent")
            sides.append(part)
        both = sides[0].join(sides[1], "node", "full").where(~F.col("now").eqNullSafe(F.col("old")))
        both = materialize(both, "differing")
        differing = both.select(F.col("node").alias("parent"))
    no_key = F.col("node") == NO_KEY
    first = F.when(~no_key, F.col("node") * F.lit(width).cast("bigint"))
    return both.select(
        "node", first.alias("first_key"), (first + F.lit(width - 1)).alias("last_key"),
        F.coalesce("rows_now", F.lit(0).cast("bigint")).alias("rows_now"), F.coalesce("rows_old", F.lit(0).cast("bigint")).alias("rows_old"),
    )


def rows_of_ranges(df: DataFrame, key: str, ranges: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of `df` in the ranges of `changed_ranges`: what has to be validated again."""
    name = "__leaf"
    while name in df.columns:
        name = f"_{name}"
    own = small_side(ranges.select(F.col("node").alias(name)))
    return df.withColumn(name, leaf_of(F.col(key), width)).join(own, name, "left_semi").select(*df.columns)
