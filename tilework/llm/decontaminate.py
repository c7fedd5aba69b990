"""Search for benchmark items inside documents: size-partitioned MinHash containment.

An item and a document are compared as sets of five-word shingles, A-Z lowered.
A document contains an item when it has 80 % or more of the item's shingles.

Items are partitioned by set size, each partition reaching to twice the size of
the one before. Under one random order of shingles, an item's sketch is its k
lowest values, k being one more than the shingles that an item of the
partition's greatest size may lack. So every containing document shares a sketch
value: nothing is missed. A document of any length is sketched for a partition
by its values up to the partition's highest sketch value, and the values are
looked up among the items'. Candidates are verified by counting shared shingles.

The items are the stated query set: they are held against all documents in
blocks of at most ``block_shingles`` shingles (8 bytes each), so what is
broadcast is bounded however many items there are; a further block costs another
pass over the documents. Documents are never shuffled, and each row is judged by
its own text, also rows without doc_id.

An item of one to four words is its whole sequence, contained where these words
occur in a row (a one-word item so is in many documents; ``min_words`` leaves out
shorter items). Null and empty items match nothing. Repeated items or documents are
reported each by its own id; rows with equal or null ids are reported once each.
Items without id are sought, too. Other columns are ignored, or kept by
``decontaminate``. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .words import Block, blocks, mix

N = 5
FOUND = "doc_id long, item_id long, n_item_shingles long, n_shared long"
_SALT = 71


class ItemIndex:
    """Sketches of a block of items by size partition, and their shingles. items: id, n (words of its shingles) and shingles."""

    def __init__(self, items: pa.Table, percent: int):
        self.ids, self.percent = items["item_id"].combine_chunks(), percent
        self.sets = [np.frombuffer(x, np.uint64) for x in items["shingles"].to_pylist()]
        n = items["n"].to_numpy()
        size = np.array([len(s) for s in self.sets], np.int64)
        self.parts = []
        for lo in (1 << np.arange(0, 40)).tolist():
            members = np.flatnonzero((size >= lo) & (size < 2 * lo) & (n == N))
            if not len(members):
                continue
            k = self.lacking(2 * lo - 1) + 1
            rows = [np.sort(mix(self.sets[i], _SALT))[:k] for i in members]
            value = np.concatenate(rows)
            item = np.repeat(members, [len(r) for r in rows])
            order = np.argsort(value, kind="stable")
            self.parts.append((value[order], item[order]))
        self.short = {}
        for k in range(1, N):
            members = np.flatnonzero(n == k)
            if len(members):
                value = np.array([self.sets[i][0] for i in members])
                order = np.argsort(value, kind="stable")
                self.short[k] = value[order], members[order]

    def lacking(self, n: int) -> int:
        """Shingles that an item of n may lack."""
        return n - -(-self.percent * n // 100)

    def candidates(self, doc: np.ndarray, shingle: np.ndarray) -> np.ndarray:
        """Distinct (document, item) that share a sketch value."""
        value = mix(shingle, _SALT)
        pairs = [np.zeros((2, 0), np.int64)]
        for keys, items in self.parts:
            low = np.flatnonzero(value <= keys[-1])
            pairs.append(_meet(doc[low], value[low], keys, items))
        return np.unique(np.concatenate(pairs, axis=1), axis=1)

    def find(self, b: Block) -> np.ndarray:
        """Rows of number of the text, number of the item, and shared shingles."""
        where, g = b.grams(N)
        doc = b.doc[where]
        first = np.searchsorted(doc, np.arange(b.docs + 1))
        out, last, own = [], -1, None
        for d, i in self.candidates(doc, g).T:
            if d != last:
                last, own = d, np.unique(g[first[d] : first[d + 1]])
            item = self.sets[i]
            slot = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shared = int((own[slot] == item).sum())
            if 100 * shared >= self.percent * len(item):
                out.append((d, i, shared))
        for k, (keys, items) in self.short.items():
            where, g = b.grams(k)
            out += [(d, i, 1) for d, i in np.unique(_meet(b.doc[where], g, keys, items), axis=1).T]
        return np.array(out, np.int64).reshape(-1, 3)


def _meet(doc: np.ndarray, value: np.ndarray, keys: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Columns (document, item) for each value among the keys (sorted; repeated where several items have one)."""
    a, z = np.searchsorted(keys, value), np.searchsorted(keys, value, "right")
    hit = np.flatnonzero(z > a)
    n = (z - a)[hit]
    slot = np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.stack([np.repeat(doc[hit], n), items[slot]])


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, b in blocks(batch.column(1), lower=True):
            doc, g = b.shingles(N)
            first = np.searchsorted(doc, np.arange(b.docs + 1))
            sets = [g[first[d] : first[d + 1]].tobytes() for d in range(b.docs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, b.docs), pa.array(np.minimum(np.diff(b.doc_first), N)), pa.array(np.diff(b.doc_first)), pa.array(sets, pa.binary())], ["item_id", "n", "words", "shingles"])


def _indexes(items: DataFrame, percent: int, block_shingles: int, min_words: int) -> Iterator[Broadcast]:
    """The items in blocks, each sent to all tasks."""
    sets = items.select(F.col("item_id").cast("long"), "text").mapInArrow(_item_sets, "item_id long, n long, words long, shingles binary").where(F.col("words") >= max(1, min_words))
    sets = materialise(sets.withColumn("row", F.monotonically_increasing_id()))
    total = sets.agg(F.sum(F.length("shingles") / 8)).first()[0] or 0
    n_blocks = max(1, -(-int(total) // block_shingles))
    for k in range(n_blocks if total else 0):
        block = sets.where(F.pmod(F.xxhash64("row"), F.lit(n_blocks)) == k).toArrow()
        yield items.sparkSession.sparkContext.broadcast(ItemIndex(block, percent))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, block_shingles: int = 1_000_000, min_words: int = 1) -> DataFrame:
    """A row (doc_id, item_id, n_item_shingles, n_shared) for each item that a document contains.

    docs: doc_id, text. items: item_id, text.
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    out = docs.sparkSession.createDataFrame([], FOUND)
    for index in _indexes(items, percent, block_shingles, min_words):

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, b in blocks(batch.column(1), lower=True):
                    d, i, shared = index.value.find(b).T
                    if len(d):
                        n = np.array([len(index.value.sets[x]) for x in i])
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + d)), index.value.ids.take(pa.array(i)), pa.array(n), pa.array(shared)], ["doc_id", "item_id", "n_item_shingles", "n_shared"])

        out = out.unionByName(texts.mapInArrow(find, FOUND))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80, block_shingles: int = 1_000_000, min_words: int = 1) -> DataFrame:
    """The rows of docs whose text contains no item, with all their columns. Nothing is joined: each row is judged where it is read."""
    for index in _indexes(items, percent, block_shingles, min_words):
        docs = docs.where(_is_clean(index)(F.col("text")))
    return docs


def _is_clean(index: Broadcast) -> Callable[..., Column]:
    def clean(text: pa.Array) -> pa.Array:
        out = np.ones(len(text), bool)
        for at, b in blocks(text, lower=True):
            out[at + index.value.find(b)[:, 0]] = False
        return pa.array(out)

    return F.arrow_udf(clean, "boolean")
