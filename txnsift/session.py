"""Session helpers: building a session, the shared scratch folder, bounded collects."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a helper may bring to the driver as a lookup or model table.
SMALL_ROWS = 10_000

_LOCAL_SCRATCH: str | None = None
_SHIPPED: dict[str, str] = {}


def get_session(app_name: str = "txnsift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; `conf` overrides any setting."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="txnsift-pkg-"), "txnsift.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.join("txnsift", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED[app] = archive


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder named by spark.checkpoint.dir.

    Local sessions without that setting use a temporary folder; a cluster must name a shared one.
    """
    global _LOCAL_SCRATCH
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if _LOCAL_SCRATCH is None:
            _LOCAL_SCRATCH = tempfile.mkdtemp(prefix="txnsift-")
        base = _LOCAL_SCRATCH
    return f"{base.rstrip('/')}/txnsift-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; for its owner, once all results are written."""
    folder = scratch_path(spark, "x").rsplit("/", 1)[0]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back, cutting its lineage.

    The written table survives the loss of executors, which a cached one does not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """`df` with a broadcast hint when it is proven to hold at most `max_rows` rows.

    Runs `df` once. A larger table is returned without hint, so the join shuffles it.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def small_rows(df: DataFrame, what: str, max_rows: int = SMALL_ROWS) -> list:
    """Rows of a table that has to be small (model parameters, per-class counts)."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` in which null keys match each other; keeps the left keys once."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__r_{k}"])
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])
