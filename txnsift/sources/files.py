"""Reading and writing tables; schemas are declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnsift.session import materialize


def transaction_schema(n_components: int = 28) -> T.StructType:
    """Time, V1 to Vn, Amount and the 0/1 Class, in file order."""
    names = ["Time", *[f"V{i}" for i in range(1, n_components + 1)], "Amount"]
    fields = [T.StructField(n, T.DoubleType()) for n in names]
    return T.StructType([*fields, T.StructField("Class", T.IntegerType())])


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    """CSV with a header row; the header has to match the declared names, bad values are errors."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    return reader.csv(list(path) if not isinstance(path, str) else path)


def read_csv_set(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All CSV files matching the pattern as one table; no match is an error."""
    return read_csv(spark, pattern, schema)


def read_csv_quarantine(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV files with a header row: bad lines are set aside as (file, record), not errors.

    A line is rejected when a value does not fit its type or the number of values is not that of the header. The files are parsed
    once and stored. A header that does not match the declared names is still an error.
    """
    record, source = "__record", "__file"
    if {record, source} & set(schema.names):
        raise ValueError(f"column names {record} and {source} are taken")
    whole = T.StructType([*schema.fields, T.StructField(record, T.StringType())])
    reader = spark.read.schema(whole).option("header", True).option("enforceSchema", False)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", record)
    parsed = reader.csv(list(path) if not isinstance(path, str) else path).select("*", F.col("_metadata.file_path").alias(source))
    parsed = materialize(parsed, "parsed")
    bad = F.col(record).isNotNull()
    return parsed.where(~bad).select(*schema.names), parsed.where(bad).select(F.col(source).alias("file"), F.col(record).alias("record"))


def reject_counts(rejects: DataFrame) -> DataFrame:
    """(file, n_rejected) of the lines that a read set aside; files without any are not listed."""
    return rejects.groupBy("file").agg(F.count(F.lit(1)).alias("n_rejected"))


def append_tables(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of all tables, columns matched by name."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Write as CSV, JSON or (by default) parquet, chosen by the suffix of the path."""
    writer = df.write.mode(mode)
    if path.endswith(".csv"):
        writer.option("header", True).csv(path)
    elif path.endswith(".json"):
        writer.json(path)
    else:
        writer.parquet(path)
    return path


def read_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """JSON records; keys missing from a record read as null."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def describe_schema(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column_name string, data_type string")


def stored_size(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes, megabytes and newest modification below a path; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("length", "modificationTime").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("length").alias("n_bytes"),
        F.round(F.sum("length") / F.lit(1e6), 1).alias("megabytes"),
        F.max("modificationTime").alias("modified"),
    )


def index_rows(df: DataFrame, name: str = "txn_id") -> DataFrame:
    """Give a table without key a contiguous row number from 0, in scan order.

    Rows are numbered inside their partition and written once; the partition sizes then give each
    partition its offset, so no row leaves its partition for a global sort.
    """
    low = F.lit((1 << 33) - 1)
    place = F.monotonically_increasing_id()
    numbered = materialize(
        df.withColumn("__at", place).withColumn("__part", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(low)),
        "indexed",
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # one row per input partition
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    return numbered.join(offsets, "__part").select(
        (F.col("__at") + F.col("__from")).alias(name), *df.columns
    )
