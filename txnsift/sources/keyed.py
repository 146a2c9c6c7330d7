"""Tables stored in buckets of a key, so that joins and groupings on it move no rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnsift.session import scratch_path

#: Buckets of a stored table; tables that are to be joined need the same number.
BUCKETS = 64


def store_keyed(df: DataFrame, key: str, name: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """`df` written in `buckets` parts by the hash of `key`, each one file sorted by it, and read back as a table.

    Two tables of one key type and bucket number are joined bucket by bucket. `path` defaults to the scratch folder. Keys should be
    nearly unique: rows of one key share a bucket. Null keys are kept (and, as always, match nothing).
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, F.col(key)).write.format("parquet").bucketBy(buckets, key).sortBy(key)
    writer.option("path", path or scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)
