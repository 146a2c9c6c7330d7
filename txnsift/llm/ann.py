"""Nearest neighbours by cosine with randomly rotated one-bit codes.

A unit vector is padded with zeros to `bits` dimensions and rotated at random; its code is the packed signs, with one
correction scalar, the inner product s of the rotated vector with its own sign vector (of length 1). For a query the inner
product of its rotated vector with the sign vector, divided by s, estimates the cosine without bias, and the error
stays below sqrt((1 - s^2) / s^2) * EPSILON / sqrt(bits - 1) but for a vanishing share of vectors. In each block the
vectors with the highest estimates are computed first; their k-th exact cosine is a bound, and every vector
whose estimate plus error reaches it is reranked exactly on the original vectors.

Plan: rows that equal each other in their vector tie for every query, so only those of the k + 1 smallest distinct ids can
be in an answer (one id may be the query's own), up to k rows of each; the rest leave before the index. Rows that repeat
id and vector are counted first and ids ranked after, both with partial steps ahead of the shuffle, so one very common
vector is no hot group. The index is a stored table of blocks of about `BLOCK` rows. Queries come in blocks
as well, each of which meets each block of the index in one task step of bounded memory; a step returns k
rows per query, and the best k of all steps are the answer.

Vectors that are null, empty, zero, or hold a null or non-finite number take no part, nor do rows of null id or of
another length than most vectors. Rows with the query's id are its own. Repeated candidate rows count as rows, repeated
query rows as one query. Ties go to the smaller id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnsift.llm.common import arrow_map
from txnsift.session import materialize

#: Bits per code (at least twice the dimension is sensible), confidence of the error bound, rows of a block, queries of a block.
BITS, EPSILON, BLOCK, QUERY_BLOCK = 256, 3.0, 8192, 1024


def rotation(dim: int, bits: int, seed: int = 11) -> np.ndarray:
    """Orthonormal rows: a random rotation of vectors padded from `dim` to `bits` dimensions."""
    noise = np.random.default_rng(seed).standard_normal((bits, bits))
    turned, triangle = np.linalg.qr(noise)
    return (turned * np.sign(np.diag(triangle)))[:dim].astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1. Dividing by the largest value first keeps the squares of very large and small ones in range."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign codes and correction scalars of vectors (rows)."""
    turned = unit(vectors) @ turn
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


def estimate(codes: np.ndarray, scalars: np.ndarray, queries: np.ndarray, turn: np.ndarray, epsilon: float):
    """Estimated cosines (vectors x queries) and the error bound of each vector."""
    bits = turn.shape[1]
    turned = (unit(queries) @ turn).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32)
    products = (2 * (signs @ turned.T) - turned.sum(axis=1)) / np.sqrt(bits, dtype=np.float32)
    s = np.maximum(scalars, 1e-6)
    error = np.sqrt(np.maximum(0, 1 - s * s)) / s * epsilon / np.sqrt(bits - 1)
    return products / s[:, None].astype(np.float32), error


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, rounded from extended precision, so that the order of adding up makes no ties or breaks them."""
    a, b = a.astype(np.longdouble), b.astype(np.longdouble)
    return ((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))).astype(np.float64)


def search_block(ids, codes, scalars, vectors, query_ids, queries, turn, k: int, epsilon: float):
    """The k nearest rows of a block for each query: query positions, row positions, cosines; and the number reranked."""
    guess, error = estimate(codes, scalars, queries, turn, epsilon)
    guess[ids[:, None] == query_ids[None, :]] = -np.inf
    few = min(len(ids), 4 * k)
    near = np.argpartition(-guess, few - 1, axis=0)[:few]
    columns = np.broadcast_to(np.arange(len(queries)), near.shape)
    exact = cosines(vectors[near.ravel()], queries[columns.ravel()]).reshape(near.shape)
    exact[~np.isfinite(np.take_along_axis(guess, near, axis=0))] = -np.inf
    bound = np.sort(exact, axis=0)[-min(k, few)]
    rows, places = np.nonzero((guess + error[:, None] >= bound - 1e-6) & np.isfinite(guess))
    scores = np.concatenate(
        [cosines(vectors[rows[i : i + 65536]], queries[places[i : i + 65536]]) for i in range(0, len(rows), 65536)] or [np.zeros(0)]
    )
    order = np.lexsort((ids[rows], -scores, places))
    places, rows, scores = places[order], rows[order], scores[order]
    first = np.searchsorted(places, places, "left")
    best = np.arange(len(places)) - first < k
    return places[best], rows[best], scores[best], len(order)


def _valid(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _stack(column: pa.Array) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def build_index(vectors: DataFrame, dim: int, bits: int = BITS, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Blocks (block, ids, codes, scalars, vectors) of the rows (id, vector), stored, and their number."""
    n = vectors.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n // block), min(cores, n // 1024))

    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        own = _stack(rows.column("vector").combine_chunks())
        codes, scalars = encode(own.astype(np.float64), rotation(dim, bits))
        return pa.table(
            {
                "block": rows.column("block").slice(0, 1),
                "ids": [rows.column("id").to_numpy().astype("<i8").tobytes()],
                "codes": [codes.tobytes()],
                "scalars": [scalars.astype("<f8").tobytes()],
                "vectors": [own.astype("<f8").tobytes()],
            }
        )

    keyed = vectors.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(n_blocks)).cast("int"))
    packed = keyed.groupBy("block").applyInArrow(pack, "block int, ids binary, codes binary, scalars binary, vectors binary")
    return materialize(packed, "codes"), n_blocks


def nearest(
    table: DataFrame,
    is_query: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    k: int = 5,
    bits: int = BITS,
    epsilon: float = EPSILON,
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for each row of `table` that `is_query` holds for."""
    rows = table.select(
        F.col(vec_id).cast("bigint").alias("id"),
        F.col(vector).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & _valid(F.col("vector")))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + 0.0))  # one zero
    lengths = rows.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    top = lengths.orderBy(F.desc("n"), "dim").first()
    dim = top["dim"] if top else 1
    bits = max(bits, -(-dim // 64) * 64)
    rows = rows.filter(F.size("vector") == dim)
    asked = rows.filter("asks").select("id", "vector").distinct()
    same = Window.partitionBy("vector").orderBy("id")
    copies = rows.groupBy("id", "vector").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    kept = copies.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    kept = kept.select("id", "vector", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("id", "vector")
    index, n_blocks = build_index(materialize(kept, "vectors"), dim, bits, block)
    asked = materialize(asked, "queries")
    n_groups = max(1, -(-asked.count() // query_block))

    def gather(table: pa.Table) -> pa.Table:
        own = _stack(table.column("vector").combine_chunks())
        ids = table.column("id").to_numpy().astype("<i8").tobytes()
        return pa.table({"query_ids": [ids], "queries": [own.astype("<f8").tobytes()]})

    grouped = asked.withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(n_groups)))
    queries = grouped.groupBy("part").applyInArrow(gather, "query_ids binary, queries binary")
    # every block of queries is repeated for each block of the index, which estimates of size do not see: never broadcast
    pairs = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).hint("merge").join(index, "block")

    def search(batches):
        turn = rotation(dim, bits)
        for batch in batches:
            for pair in batch.to_pylist():
                ids, scalars = np.frombuffer(pair["ids"], "<i8"), np.frombuffer(pair["scalars"], "<f8")
                codes = np.frombuffer(pair["codes"], np.uint8).reshape(len(ids), -1)
                own = np.frombuffer(pair["vectors"], "<f8").reshape(len(ids), -1)
                query_ids = np.frombuffer(pair["query_ids"], "<i8")
                asked_vectors = np.frombuffer(pair["queries"], "<f8").reshape(len(query_ids), -1)
                places, at, scores, _ = search_block(ids, codes, scalars, own, query_ids, asked_vectors, turn, k, epsilon)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query_ids[places]), pa.array(ids[at]), pa.array(scores)], ["query_id", "vec_id", "score"]
                )

    steps = pairs.select("ids", "codes", "scalars", "vectors", "query_ids", "queries")
    found = arrow_map(steps, search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
