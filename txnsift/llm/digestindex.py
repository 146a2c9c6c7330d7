"""Exact duplicates against a stored index of text digests.

Two texts are equal when they are identical after A-Z are lowered; a null text counts as empty. The index is a Parquet table of
(digest, keep_id, batch), bucketed and sorted by the SHA-256 digest. A batch of documents is grouped by digest, the groups
that are not in the index yet are found by a sort-merge anti-join and appended. Spark reads both sides by bucket, so the
index is never shuffled.

In a batch the row of the largest id stays of each new text (a null id counts as smallest; of rows that repeat both id and
text, one stays). A text that an earlier batch brought stays with that batch, and all its rows in later ones are duplicates.
A batch that is added again, after a failure for example, gets the decisions of the first time, because the index keeps
which batch brought a text; so a batch name has to stand for one content. One writer at a time.

Groups with a thousandth of a batch or more (at most a thousand, so they are broadcast) and the others are joined apart, so
that no task receives a large group. Empty tables give no decisions; other columns may have any name.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnsift.llm.common import ascii_lower, free_name
from txnsift.session import materialize

#: A group with a share of 1 / HOT of a batch is joined by broadcast; there are at most HOT of them.
HOT = 1000


def text_digest(text: Column) -> Column:
    """SHA-256 of a text with A-Z lowered, as 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """The index stored below `path`. It is created with `buckets` buckets (by default as many as shuffle partitions)."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        settings = f"{self.path}/settings"
        try:
            stored = spark.read.parquet(settings).first()
            self.buckets, self.id_type = stored["buckets"], stored["id_type"]
        except AnalysisException as missing:  # not created yet
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(self.buckets, id_type)], "buckets int, id_type string").write.parquet(settings)
        self._register()

    @property
    def table(self) -> str:
        return "digest_index_" + "".join(c if c.isalnum() else "_" for c in self.path).lower()

    def _register(self) -> None:
        """Names the stored rows in the session's catalog, which is where Spark looks up buckets."""
        location = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {self.id_type}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{location}/rows'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Appends the new texts of `docs`; per row: id, keep_id, group_size (rows of the batch), kept, digest."""
        slim = docs.select(F.col(doc_id).cast(self.id_type).alias("id"), text_digest(F.col(text)).alias("digest"))
        slim = materialize(slim.withColumn("row", F.monotonically_increasing_id()), "digests")
        groups = slim.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "row")).alias("top"))
        groups = materialize(groups, "groups")
        fresh = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        fresh = fresh.select("digest", F.col("top.id").alias("keep_id"), F.lit(batch).alias("batch"))
        fresh.repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        known = groups.join(self.rows().hint("merge"), "digest").select(
            "digest", "n", "keep_id", F.when(F.col("batch") == batch, F.col("top.row")).alias("keep_row")
        )
        return self._decisions(slim, materialize(known, "known"))

    def _decisions(self, slim: DataFrame, known: DataFrame) -> DataFrame:
        total = known.agg(F.sum("n")).first()[0] or 0
        hot = F.broadcast(known.filter(F.col("n") * HOT >= total))  # at most HOT rows, since the n add up to the total
        rest = slim.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        joined = slim.join(hot, "digest").unionByName(rest.join(known.filter(F.col("n") * HOT < total), "digest"))
        kept = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
        return joined.select("id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "digest")

    def add_new(self, docs: DataFrame, batch: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """As `add`, and returns the rows of `docs` that stay, with all their columns."""
        own, id_, digest = free_name(docs, "own_digest"), free_name(docs, "kept_id"), free_name(docs, "kept_digest")
        kept = self.add(docs, batch, doc_id, text).filter("kept").select(F.col("id").alias(id_), F.col("digest").alias(digest))
        same = (F.col(own) == F.col(digest)) & F.col(doc_id).cast(self.id_type).eqNullSafe(F.col(id_))
        found = docs.withColumn(own, text_digest(F.col(text))).join(materialize(kept, "kept"), same)
        return found.dropDuplicates([digest]).select(docs.columns)  # rows that repeat id and text are one

    def compact(self) -> None:
        """Rewrites the index with one sorted file per bucket, so that reading needs no sort after many appends."""
        rows = materialize(self.rows(), "compacted")
        rows.repartition(self.buckets, "digest").write.insertInto(self.table, overwrite=True)
        self.spark.catalog.refreshTable(self.table)
