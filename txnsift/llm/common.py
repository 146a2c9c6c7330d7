"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of sizes and shingles: runs of everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a record batch that goes to Python, and rows that a scan decodes at once. Rows of long texts make the
#: defaults (64 MB, 4,096 rows) costly in memory.
BATCH_BYTES, SCAN_ROWS = "4m", "1024"


def prepare(spark: SparkSession) -> None:
    """Ships the package to the workers and bounds the batches of the session."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def arrow_map(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: T.StructType | str) -> DataFrame:
    """`fn` over the record batches of each partition. Batches are bounded in bytes (see `prepare`).

    A worker that has ended its partition gives the memory of its batches back before it waits for the next.
    """

    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of `df` and further columns."""
    return T.StructType([*df.schema.fields, *fields])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added until no column of `df` is called so (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
