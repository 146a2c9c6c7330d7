"""Ranked lexical search by two trees: items and documents, each node holding the maxima of its coordinates.

Terms: A-Z lowered, runs of ASCII letters and digits and of non-ASCII characters. The weight of a term is floor(1000 ln((2N + 2) / (2 df + 1))) over the
N documents that have a term. A document of n terms has m = 10 + ((90 n N) div L), with L terms in all documents, and the
impact (10^9 tf) div (1000 tf + 8 m) for a term that it holds tf times. Its score for an item is the sum of weight times
impact over the terms of the item, each once. All sums are whole numbers, and exact.

One scan turns texts into counts of the items' terms, stored; document frequencies come from them. Then every partition reads its
vectors in blocks, sorts a block by each document's heaviest term and builds a tree over it: a node holds, per term,
the largest impact below it. The items have such a tree of weights. Pairs of nodes are visited from both roots down.
The product of the two maxima bounds all scores below a pair; where it is under the weakest k-th score of the pair's items, the whole
pair goes. Only leaves are scored. A first search over one in `SEED_PART` documents gives each item a k-th score that
is a lower bound for the full table, so that later partitions prune from their first block; it never decides a result.

Each partition returns at most k rows an item, ranked by one window over items. Items go to the workers in parts of at
most `PART_WORDS` words, and within a worker in blocks of at most `BLOCK_TERMS` distinct terms, so neither their number nor that of the
documents is limited. Ids of documents are whole numbers; null ids rank last among equal scores. Repeated documents are
ranked each, repeated items are answered each; texts that are null or without terms take no part. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnsift.llm.common import arrow_map
from txnsift.llm.decontaminate import words_of
from txnsift.session import materialize

#: Words of the items that are searched at once; distinct terms of a block of items.
PART_WORDS, BLOCK_TERMS = 1_000_000, 4096
#: Documents of a block and of a leaf; children of a node of documents and of items.
BLOCK_DOCS, LEAF_DOCS, DOC_FAN, ITEM_FAN = 4096, 32, 8, 4
#: One in so many documents gives the first bounds.
SEED_PART = 64
#: Ids of no document and of a document without id.
_NONE, _NULL = np.iinfo(np.int64).max, np.iinfo(np.int64).max - 1
_VECTOR = "id bigint, n bigint, terms array<int>, counts array<int>"


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_words: int = PART_WORDS,
) -> DataFrame:
    """Per item (`item_id`) its k highest-scoring documents with score above 0: rank, `doc_id`, score."""
    spark = docs.sparkSession
    slim = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    words = slim.agg(F.sum(F.ceil((F.length("text") + 1) / 2))).first()[0] or 0  # a word has a character and a separator
    n_parts = max(1, -(-int(words) // part_words))
    found = []
    for part in range(n_parts):
        chosen = slim if n_parts == 1 else slim.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_parts)) == part)
        rows = [(r["item"], sorted(set(words_of(r["text"])))) for r in chosen.collect()]  # bounded by part_words
        rows = [r for r in rows if r[1]]
        ranked = _search(docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")), [r[1] for r in rows], k)
        names = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"no int, item {slim.schema['item'].dataType.simpleString()}")
        found.append(ranked.join(F.broadcast(names), "no"))  # at most part_words rows
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")


def _search(docs: DataFrame, items: list[list[bytes]], k: int) -> DataFrame:
    """(no, rank, id, score) for items given as lists of terms."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for item in items for t in item}))}
    vectors = materialize(arrow_map(docs, _counter(spark.sparkContext.broadcast(vocabulary)), _VECTOR), "vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the part
        frequency[r["term"]] = r["count"]
    weights = [math.floor(1000 * math.log((2 * size["docs"] + 2) / (2 * int(df) + 1))) for df in frequency]
    blocks = _blocks([[vocabulary[t] for t in item] for item in items], np.array(weights, np.int64), len(vocabulary))
    seeds = vectors.filter(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_PART)) == 0)
    total, n_terms = size["docs"], size["terms"] or 1
    floor = np.zeros(len(items), np.int64)
    for r in _ranked(seeds, spark.sparkContext.broadcast((blocks, floor)), total, n_terms, k).filter(F.col("rank") == k).collect():
        floor[r["no"]] = r["score"]  # one row an item of the part
    return _ranked(vectors, spark.sparkContext.broadcast((blocks, floor)), total, n_terms, k)


def _counter(vocabulary):
    def count(batches):
        get = vocabulary.value.get
        for batch in batches:
            sizes, terms, counts = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                numbers = [i for i in map(get, words) if i is not None]
                own, often = np.unique(np.array(numbers, np.int32), return_counts=True)
                sizes.append(len(words))
                terms.append(own)
                counts.append(often.astype(np.int32))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            out = pa.RecordBatch.from_arrays(columns, ["id", "n", "terms", "counts"])
            yield out.filter(pa.array([n > 0 for n in sizes], pa.bool_()))

    return count


def _ranked(vectors: DataFrame, shared, n_docs: int, n_terms: int, k: int) -> DataFrame:
    def search(batches):
        blocks, floor = shared.value
        best, held, n_held = Best(floor, k), [], 0
        for batch in batches:
            held.append(batch)
            n_held += len(batch)
            if n_held >= BLOCK_DOCS:
                _search_block(held, blocks, best, n_docs, n_terms)
                held, n_held = [], 0
        if held:
            _search_block(held, blocks, best, n_docs, n_terms)
        no, at = np.nonzero(best.scores > 0)
        ids = best.ids[no, at]
        columns = [pa.array(no.astype(np.int32)), pa.array(ids, mask=ids == _NULL), pa.array(best.scores[no, at])]
        yield pa.RecordBatch.from_arrays(columns, ["no", "id", "score"])

    found = arrow_map(vectors, search, "no int, id bigint, score bigint")
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Best:
    """The k best documents of each item so far."""

    def __init__(self, floor: np.ndarray, k: int):
        self.floor, self.k = floor, k
        self.scores, self.ids = np.zeros((len(floor), k), np.int64), np.full((len(floor), k), _NONE)
        self.weakest = floor.copy()

    def add(self, items: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores of documents (columns) for items (rows)."""
        good = (scores > 0) & (scores >= self.weakest[items, None])
        rows = np.flatnonzero(good.any(axis=1))
        if not len(rows):
            return
        items, columns = items[rows], np.flatnonzero(good[rows].any(axis=0))
        found = np.where(good[np.ix_(rows, columns)], scores[np.ix_(rows, columns)], 0)
        names = np.where(found > 0, ids[columns], _NONE)
        scores, ids = np.hstack((self.scores[items], found)), np.hstack((self.ids[items], names))
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.scores[items] = np.take_along_axis(scores, order, 1)
        self.ids[items] = np.take_along_axis(ids, order, 1)
        self.weakest[items] = np.maximum(self.floor[items], self.scores[items, -1])


class ItemBlock:
    """A tree over some items: per level, the largest weight of each term below a node; level 0 are the items."""

    def __init__(self, numbers: list[int], items: list[list[int]], weights: np.ndarray, n_terms: int):
        self.numbers = np.array(numbers)
        used = np.unique(np.concatenate([np.array(i) for i in items]))
        self.column = np.full(n_terms, -1, np.int32)  # of a term in this block
        self.column[used] = np.arange(len(used))
        table = np.zeros((len(items), len(used)), np.int64)
        for row, item in enumerate(items):
            table[row, self.column[item]] = weights[item]
        exact = int(table.sum(axis=1).max()) * 10**6 < 1 << 53  # then sums of doubles are whole numbers
        self.levels = [table.astype(np.float64 if exact else np.int64)]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), ITEM_FAN)))

    def weakest(self, best: Best, level: int) -> np.ndarray:
        low = best.weakest[self.numbers]
        for _ in range(level):
            low = np.minimum.reduceat(low, np.arange(0, len(low), ITEM_FAN))
        return low


def _blocks(items: list[list[int]], weights: np.ndarray, n_terms: int) -> list[ItemBlock]:
    """Items ordered by their heaviest terms, so that neighbours share some, in blocks of bounded width."""
    heaviest = [sorted(item, key=lambda t: (-weights[t], t)) for item in items]
    order = sorted(range(len(items)), key=lambda i: heaviest[i][:2])
    blocks, numbers, used = [], [], set()
    for i in order:
        if numbers and len(used.union(items[i])) > BLOCK_TERMS:
            blocks.append(ItemBlock(numbers, [items[j] for j in numbers], weights, n_terms))
            numbers, used = [], set()
        numbers.append(i)
        used.update(items[i])
    if numbers:
        blocks.append(ItemBlock(numbers, [items[j] for j in numbers], weights, n_terms))
    return blocks


def _search_block(held: list, blocks: list[ItemBlock], best: Best, n_docs: int, n_terms: int) -> None:
    batch = pa.Table.from_batches(held).combine_chunks()
    ids = batch.column("id").to_numpy() if not batch.column("id").null_count else np.array([_NULL if i is None else i for i in batch.column("id").to_pylist()])
    lists = batch.column("terms").combine_chunks()
    starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
    terms, counts = lists.flatten().to_numpy(), batch.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
    # whole numbers of Python: 90 n N may pass 64 bits
    spread = np.array([8 * (10 + 90 * n * n_docs // n_terms) for n in batch.column("n").to_pylist()], np.int64)
    owner = np.repeat(np.arange(len(ids)), np.diff(starts))
    impact = 10**9 * counts // (1000 * counts + spread[owner])
    for block in blocks:
        column = block.column[terms]
        some = column >= 0
        DocTree(ids, owner[some], column[some], impact[some], block).search(best)


class DocTree:
    """A tree over a block of documents: per level, the largest impact of each term below a node."""

    def __init__(self, ids: np.ndarray, owner: np.ndarray, column: np.ndarray, impact: np.ndarray, block: ItemBlock):
        self.block = block
        heavy = impact * block.levels[-1][0].astype(np.int64)[column]
        by = np.lexsort((-heavy, owner))
        docs, first = np.unique(owner[by], return_index=True)  # documents without a term of the block stay out
        docs = docs[np.argsort(column[by][first], kind="stable")]
        place = np.full(len(ids), -1)
        place[docs] = np.arange(len(docs))
        self.ids = ids[docs]
        order = np.argsort(place[owner], kind="stable")
        self.row, self.column, self.impact = place[owner][order], column[order], impact[order]
        self.cuts = np.searchsorted(self.row, np.arange(0, len(docs) + LEAF_DOCS, LEAF_DOCS))
        leaves = [self.leaf(i).max(axis=0) for i in range(-(-len(docs) // LEAF_DOCS))]
        self.levels = [np.array(leaves)] if leaves else []
        while self.levels and len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), DOC_FAN)))

    def leaf(self, i: int) -> np.ndarray:
        """The impacts of the documents of a leaf, by term."""
        table = self.block.levels[0]
        part = slice(self.cuts[i], self.cuts[i + 1])
        size = min(LEAF_DOCS, len(self.ids) - i * LEAF_DOCS)
        out = np.zeros((size, table.shape[1]), table.dtype)
        out[self.row[part] - i * LEAF_DOCS, self.column[part]] = self.impact[part]
        return out

    def search(self, best: Best) -> None:
        if self.levels:
            self._visit(len(self.levels) - 1, 0, len(self.block.levels) - 1, np.array([0]), best)

    def _visit(self, depth: int, node: int, level: int, groups: np.ndarray, best: Best) -> None:
        """A node of documents and nodes of items of one level."""
        bound = self.block.levels[level][groups] @ self.levels[depth][node]
        groups = groups[(bound > 0) & (bound >= self.block.weakest(best, level)[groups])]
        if not len(groups):
            return
        if level == 0 and depth == 0:
            scores = self.block.levels[0][groups] @ self.leaf(node).T
            at = node * LEAF_DOCS
            best.add(self.block.numbers[groups], scores.astype(np.int64), self.ids[at : at + LEAF_DOCS])
            return
        if level:
            below = (groups[:, None] * ITEM_FAN + np.arange(ITEM_FAN)).ravel()
            groups, level = below[below < len(self.block.levels[level - 1])], level - 1
        if not depth:
            self._visit(0, node, level, groups, best)
            return
        children = np.arange(node * DOC_FAN, min((node + 1) * DOC_FAN, len(self.levels[depth - 1])))
        hope = (self.levels[depth - 1][children] @ self.block.levels[level][groups].T).max(axis=1)
        for child in children[np.argsort(-hope, kind="stable")]:  # good documents first, they raise the k-th scores
            self._visit(depth - 1, int(child), level, groups, best)
