"""Counting and grouping very many hash values with few bytes each.

Tasks emit values as binary blobs by hash range instead of a row each; a range is
then worked on with numpy in one task, one range at a time. The number of ranges
follows the session's shuffle partitions, so a range stays small as the data
grows, and tasks gather many texts before they emit, so blobs stay large. Nothing
that grows with the data is broadcast or held by the driver.

A value that very many texts hold would make its range large. Such values are found
first on a sample of texts (hot_values); being listed only decides where a value is
worked on, never what comes out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .words import give_back

#: One text in so many is sampled for frequent values; a listed one is in at least so many of them, and is a twentieth of its range's.
SAMPLE, LEAST, SHARE = 64, 64, 20
#: Values that a task gathers before it emits them, at least; more where there are many ranges.
GATHERED, PER_RANGE = 250_000, 64


def gathered_values(n: int) -> int:
    return max(GATHERED, PER_RANGE * n)


def range_count(df: DataFrame) -> int:
    return max(16, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def range_of(v: np.ndarray, n: int) -> np.ndarray:
    """Range of 64-bit hashes; it doesn't depend on their low 32 bits."""
    return ((v >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def blobs(ranges: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row per range that occurs: the values of the columns that belong to it, as bytes."""
    order = np.argsort(ranges, kind="stable")
    which, first = np.unique(ranges[order], return_index=True)
    cut = [*first.tolist(), len(order)]
    parts = [[c[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)] for c in (x[order] for x in columns)]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), *[pa.array(x, pa.binary()) for x in parts]], ["range", *[f"v{i}" for i in range(len(parts))]])


def gathered(parts: Iterator[tuple[np.ndarray, ...]], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Tuples of columns joined until they are long enough for n ranges."""
    held: list[tuple[np.ndarray, ...]] = []
    size, most = 0, gathered_values(n)
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= most:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def per_key(rows: DataFrame, n: int, work: Callable[[int, list[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(key, rows without it) for each key, the first column of rows: all rows of one key together."""
    key = rows.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if held:
                        yield from work(now, held)
                    now, held = k, []
                held.append(tuple(row))
        if held:
            yield from work(now, held)
        held = []
        give_back()

    return rows.repartition(n, key).sortWithinPartitions(key).mapInArrow(run, schema)


def per_range(rows: DataFrame, n: int, kinds: list[type], work: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """work(range, values of v0, values of v1, ...) for each range, all of one range together."""

    def joined(r: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        yield from work(r, *[np.frombuffer(b"".join(h), k) for h, k in zip(zip(*held, strict=True), kinds, strict=True)])

    return per_key(rows, n, joined, schema)


class Hot:
    """Values that very many texts hold, with about how many do; at most SHARE for each range."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]

    def count(self, v: np.ndarray) -> np.ndarray:
        """About how many texts hold the values; 0 for those that aren't listed."""
        if not len(self.keys):
            return np.zeros(len(v), np.int64)
        at = np.minimum(np.searchsorted(self.keys, v), len(self.keys) - 1)
        return np.where(self.keys[at] == v, self.counts[at], 0)


def hot_values(texts: DataFrame, values: Callable[[pa.RecordBatch], Iterator[np.ndarray]], n: int) -> Broadcast:
    """The Hot values, broadcast. texts: doc_id, text; values: of a batch, each text's without repeats."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (v,) in gathered(((x,) for batch in batches for x in values(batch)), n):
            if len(v):
                u, k = np.unique(v, return_counts=True)
                yield blobs(range_of(u, n), u, k)

    def count(_: int, v: np.ndarray, k: np.ndarray) -> Iterator[pa.RecordBatch]:
        u, at = np.unique(v, return_inverse=True)
        total = np.bincount(at, weights=k).astype(np.int64)
        top = total >= max(LEAST, total.sum() // SHARE)
        yield pa.RecordBatch.from_arrays([pa.array(u[top].view(np.int64)), pa.array(total[top] * SAMPLE)], ["value", "texts"])

    sampled = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    with small_batches(texts.sparkSession):
        found = per_range(sampled.mapInArrow(emit, "range int, v0 binary, v1 binary"), n, [np.uint64, np.int64], count, "value long, texts long").toArrow()
    return texts.sparkSession.sparkContext.broadcast(Hot(found["value"].to_numpy().view(np.uint64), found["texts"].to_numpy()))

