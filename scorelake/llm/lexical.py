"""Ranked lexical search: the best documents of each item by weighted terms, as products of dense blocks.

Items come in blocks of bounded size. A block's distinct terms are its vocabulary, which one pass counts over all documents.
A second pass multiplies tiles: the weights of the items' terms times the impacts of those terms in a few hundred documents,
over the terms that occur there. All numbers are integers and a tile's sums stay below 2**53, so 64-bit floats hold them
exactly; tiles add up as integers. Each task keeps the best documents of each item, ties by id, and lists of tasks are
merged in groups of bounded size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, split_words, text_chunks, written

MOST = 50
#: Bytes of items in a block; vocabulary and weights of a block are broadcast.
BLOCK_BYTES = 1 << 20
ITEMS, TERMS, DOCS = 1024, 4096, 256
#: Lists merged at once.
FAN_IN = 64
#: Impacts are below 1e6 and weights below 1000 ln(2**64), so the sums of a tile of terms are exact.
assert TERMS * math.ceil(1000 * math.log(2.0**64)) * 10**6 < 2**53

#: What a byte of a term becomes; all others end a term.
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
for _a, _b in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
    _LETTERS[_a:_b] = np.arange(_a, _b)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def split_terms(data: np.ndarray, at: np.ndarray):
    """The lower-cased terms as an Arrow array (each with a blank behind it), and where each text's begin."""
    import pyarrow as pa

    data, starts, _, first = split_words(_LETTERS[data], at)
    offsets = np.r_[starts, len(data)].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]), first


@dataclass
class Block:
    """Items, their distinct terms, and (item, term) pairs in order of the terms."""

    ids: list
    vocabulary: object
    item: np.ndarray
    term: np.ndarray

    @classmethod
    def of(cls, rows: list) -> Block:
        import pyarrow as pa
        import pyarrow.compute as pc

        batch = pa.RecordBatch.from_arrays([pa.array([r["text"] for r in rows], pa.string()), pa.array(np.arange(len(rows)))], ["text", "row"])
        words, items = [pa.array([], pa.large_binary())], [np.zeros(0, dtype=np.int64)]
        for part, data, at in text_chunks(batch):
            found, first = split_terms(data, at)
            words.append(found)
            items.append(np.repeat(part.column("row").to_numpy(), np.diff(first)))
        words, items = pa.concat_arrays(words), np.concatenate(items)
        vocabulary = pc.unique(words)
        term = pc.index_in(words, value_set=vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        pair = np.unique(term * max(len(rows), 1) + items)
        return cls([r["item_id"] for r in rows], vocabulary, pair % max(len(rows), 1), pair // max(len(rows), 1))


def occurrences(vocabulary, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, term and number of occurrences, by text and term, of the terms in the vocabulary; and the number of all terms of each text."""
    import pyarrow.compute as pc

    words, first = split_terms(data, at)
    term = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    doc, known, width = np.repeat(np.arange(len(first) - 1), np.diff(first)), term >= 0, max(len(vocabulary), 1)
    pair, times = np.unique(doc[known] * width + term[known], return_counts=True)
    return pair // width, pair % width, times, np.diff(first)


#: Rows of the counts that are no term's: documents with terms, and all terms.
DOCUMENTS, LENGTH = -1, -2


def _counted(block):
    def count(batches):
        import pyarrow as pa

        vocabulary = block.value.vocabulary
        df, documents, length = np.zeros(len(vocabulary), dtype=np.int64), 0, 0
        for batch in batches:
            for _, data, at in text_chunks(batch):
                _, term, _, n = occurrences(vocabulary, data, at)
                df += np.bincount(term, minlength=len(df))
                documents, length = documents + int((n > 0).sum()), length + int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[seen, DOCUMENTS, LENGTH].astype(np.int64)), pa.array(np.r_[df[seen], documents, length].astype(np.int64))], ["term", "n"])

    return count


@dataclass
class Model:
    block: Block
    weight: np.ndarray
    documents: int
    length: int

    def impacts(self, times: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of terms that occur so often in texts of n terms."""
        m = 50 + (50 * n * self.documents) // max(self.length, 1)
        return (1_000_000_000 * times) // (1000 * times + 20 * m)

    def tiles(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int):
        """Yields the first item of each tile of items and its scores, items by documents."""
        present, row = np.unique(term, return_inverse=True)
        dense = []
        for t in range(0, len(present), TERMS):
            own = (row >= t) & (row < t + TERMS)
            x = np.zeros((min(TERMS, len(present) - t), docs))
            x[row[own] - t, doc[own]] = impact[own]
            dense.append(x)
        a, b = np.searchsorted(self.block.term, present), np.searchsorted(self.block.term, present, "right")
        size = b - a
        at = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(present) else np.zeros(0, dtype=np.int64)
        item, column = self.block.item[at], np.repeat(np.arange(len(present)), size)
        for i in range(0, len(self.block.ids), ITEMS):
            height = min(ITEMS, len(self.block.ids) - i)
            scores = np.zeros((height, docs), dtype=np.int64)
            for k, x in enumerate(dense):
                own = (item >= i) & (item < i + ITEMS) & (column // TERMS == k)
                q = np.zeros((height, len(x)))
                q[item[own] - i, column[own] - k * TERMS] = self.weight[present[column[own]]]
                scores += (q @ x).astype(np.int64)
            yield i, scores


class Best:
    """The best documents of each item so far: by score, then by id, rows without an id last."""

    def __init__(self, items: int, most: int):
        self.most, self.floor = most, np.ones(items, dtype=np.int64)
        self.item, self.score, self.absent, self.doc = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, bool, np.int64))

    def add(self, item: np.ndarray, score: np.ndarray, absent: np.ndarray, doc: np.ndarray) -> None:
        """Of documents that score at least their item's floor."""
        item, score, absent, doc = (np.r_[x, y] for x, y in zip((self.item, self.score, self.absent, self.doc), (item, score, absent, doc), strict=True))
        order = np.lexsort((doc, absent, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[place < self.most]
        self.item, self.score, self.absent, self.doc = item[place < self.most], score[order], absent[order], doc[order]
        last = place[place < self.most] == self.most - 1
        self.floor[self.item[last]] = self.score[last]


def _searched(model, most: int):
    def search(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        own: Model = model.value
        best = Best(len(own.block.ids), most)
        for batch in batches:
            for part, data, at in text_chunks(batch):
                doc, term, times, n = occurrences(own.block.vocabulary, data, at)
                impact = own.impacts(times, n[doc])
                ids = part.column("doc_id")
                absent, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                for d in range(0, len(n), DOCS):
                    a, b = np.searchsorted(doc, [d, d + DOCS])
                    for i, scores in own.tiles(doc[a:b] - d, term[a:b], impact[a:b], min(DOCS, len(n) - d)):
                        item, place = np.nonzero(scores >= best.floor[i : i + len(scores), None])
                        best.add(item + i, scores[item, place], absent[place + d], ids[place + d])
        item, first = np.unique(best.item, return_index=True)
        tops = pa.StructArray.from_arrays([pa.array(-best.score), pa.array(best.absent), pa.array(best.doc, mask=best.absent)], ["minus", "absent", "doc_id"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(best.item)].astype(np.int32)), tops)
        task = pa.array(np.full(len(item), TaskContext.get().partitionId(), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(item), task, lists], ["item", "task", "top"])

    return search


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def _blocks(items: DataFrame, limit: int) -> list[DataFrame]:
    """The distinct items in parts of about `limit` bytes, dealt by hash; a part is at most twice as large unless it is one item."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = items.agg(F.sum(size).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // limit))
    while parts > 1:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
        largest = items.groupBy(part.alias("part")).agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("k"))
        if not largest.where((F.col("n") > 2 * limit) & (F.col("k") > 1)).limit(1).count():
            return [items.where(part == i) for i in range(parts)]
        parts *= 2
    return [items]


def _merged(lists: DataFrame, tasks: int, most: int) -> DataFrame:
    """One list an item, of groups of at most FAN_IN lists at a time."""
    while tasks > 1:
        groups = lists.groupBy("item", F.floor(F.col("task") / FAN_IN).alias("task"))
        lists = groups.agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, most).alias("top"))
        tasks = -(-tasks // FAN_IN)
    return lists


def search(docs: DataFrame, items: DataFrame, most: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `most` documents (doc_id, text) of each item (item_id, text) with the highest scores above 0.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased. A term weighs
    floor(1000 ln((2N+2)/(2df+1))), and in a document of n terms counts 1e9 tf div (1000 tf + 20 m), m = 50 + (50 n N div L),
    where N documents have L terms in all. Equal scores go by ascending doc_id, rows without an id last; rows that share an
    id stand beside each other. Null and empty texts have no terms, and items without terms no rows. Repeated items count
    once. Empty tables give no rows. The result lies in the shared folder; each block of items reads the documents twice.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    items = items.select(items["item_id"].alias("item_id"), items["text"].alias("text")).distinct()
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for part in _blocks(items, block_bytes):
        block = Block.of(part.orderBy("item_id", "text").collect())  # bounded by block_bytes
        shared = spark.sparkContext.broadcast(block)
        counts = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_counted(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        documents, length = counts.pop(DOCUMENTS, 0), counts.pop(LENGTH, 0)
        df = np.zeros(len(block.vocabulary), dtype=np.int64)
        df[list(counts)] = list(counts.values())
        model = spark.sparkContext.broadcast(Model(block, weights(df, documents), documents, length))
        lists = written(rows.mapInArrow(_searched(model, most), "item long, task long, top array<struct<minus:long,absent:boolean,doc_id:long>>"), "lexical-lists")
        tasks = (lists.agg(F.max("task").alias("n")).first()["n"] or 0) + 1
        ids = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {kind}")
        ranked = _merged(lists, tasks, most).select("item", F.posexplode("top").alias("place", "x")).join(F.broadcast(ids), "item")
        found = written(ranked.select("item_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.doc_id").alias("doc_id"), (-F.col("x.minus")).alias("score")), "lexical")
        discard(lists)
        out = out.unionByName(found)
    return out
