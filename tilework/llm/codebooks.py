"""Compression of vectors by product codebooks, learned by delta-maintained Lloyd rounds.

``compress`` cuts each vector into equal parts and learns a codebook for each part
position. The state of a row (its integer components and the entries of its parts)
is written to the shared folder after every round, and the sums and counts behind
each entry are kept as integers from round to round. A round reads the state once:
each task assigns its parts to the codebooks, which are broadcast, writes the next
state, and of the parts whose entry changed it adds the components to the new entry's sum and
takes them from the old one's. So a round shuffles one row per entry whose parts
came or went, for each task, whatever number of vectors there is; vectors never move.
All arithmetic is in integers, so results don't depend on the partitioning.

Bounds: codebooks have 256 entries a part, and components at most ``LARGEST``.
Broadcast and held by the driver: codebooks and sums, 256 rows a part.

Defined results:
* A row is dropped if its vector is null, has a null, NaN or infinite component, or
  has not the length of the first kept vector (smallest id, ties by components),
  or fewer components than parts. A remainder that doesn't fill a part isn't coded.
* Codebooks start as the first kept rows by id (null ids last; equal ids by components);
  with fewer kept rows than entries the codebook is shorter. Repeated rows
  give repeated entries, of which the lower index takes the parts.
* Components beyond LARGEST raise an error, as distances would leave 64 bits.
* No kept row: no rows. Columns of ``vectors`` with other names are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise, remove, written

#: Of an integer component, in absolute value; distances of vectors of up to 4,096 components then fit.
LARGEST = 1 << 24
#: Up to so many vectors are compared with a codebook at once.
LOT = 4_096
_STATE = "vec_id long, label long, x binary, code binary"


@dataclass(frozen=True)
class Codebooks:
    """parts: parts of a vector. entries: entries of a codebook, at most 256. rounds: Lloyd rounds. scale: components become floor(scale * x)."""

    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    broadcast_labels: int = 200_000

    def __post_init__(self):
        if not (1 <= self.entries <= 256 and self.parts >= 1 and self.rounds >= 0):
            raise ValueError("codebooks have 1 to 256 entries and at least one part")


def integer_vectors(vectors: DataFrame, p: Codebooks) -> DataFrame:
    """vec_id, label, v: integer components of the rows whose vector is whole."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") >= p.parts) & finite)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * p.scale))
    small = F.forall("v", lambda x: x.between(-LARGEST, LARGEST))
    checked = F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {p.scale}")).cast("array<long>"))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).withColumn("v", checked)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry nearest to each row of x, the lower of equally near ones, and its squared distance; exact."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    exact_in_doubles = 4 * x.shape[1] * most * most < 1 << 53
    for a in range(0, len(x), LOT):
        part = x[a : a + LOT]
        if exact_in_doubles:
            f, g = part.astype(np.float64), book.astype(np.float64)
            d = (g * g).sum(1) - 2 * (f @ g.T)
            at[a : a + LOT] = d.argmin(1)
        else:
            d = (book * book).sum(1) - 2 * np.stack([(part * row).sum(1) for row in book], 1)
            at[a : a + LOT] = d.argmin(1)
        gap = part - book[at[a : a + LOT]]
        far[a : a + LOT] = (gap * gap).sum(1)
    return at, far


def _components(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def _assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (rows x parts), and the squared distances summed over parts."""
    parts, _, width = books.shape
    codes, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for k in range(parts):
        codes[:, k], far = nearest(x[:, k * width : (k + 1) * width], books[k])
        error += far
    return codes, error


def _bytes(rows: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in rows]


def _assign(state: DataFrame, books: Broadcast) -> DataFrame:
    """The state with new entries in code and those of before in was (null: none yet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = books.value
        for batch in batches:
            if batch.num_rows:
                codes, _ = _assigned(_components(batch["x"], b.shape[0] * b.shape[2]), b)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["x"], pa.array(_bytes(codes.astype(np.uint8)), pa.binary()), batch["code"]], ["vec_id", "label", "x", "code", "was"])

    return state.mapInArrow(run, f"{_STATE}, was binary")


def _deltas(moved: DataFrame, parts: int, entries: int, width: int) -> list:
    """Rows (part, entry, count, sums) of what came to entries less what went: only parts whose entry changed count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _components(batch["x"], parts * width).reshape(-1, parts, width)
            now = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(-1, parts)
            first = batch["was"].is_null().to_numpy(zero_copy_only=False)
            was = np.frombuffer(b"".join(c or bytes(parts) for c in batch["was"].to_pylist()), np.uint8).reshape(-1, parts)
            for k in range(parts):
                changed = first | (now[:, k] != was[:, k])
                for sign, entry, rows in ((1, now, changed), (-1, was, changed & ~first)):
                    np.add.at(count[k], entry[rows, k], sign)
                    np.add.at(sums[k], entry[rows, k], sign * x[rows, k])
        at = np.argwhere((count != 0) | (sums != 0).any(2))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(at[:, 1].astype(np.int32)), pa.array([int(count[k, e]) for k, e in at], pa.int64()), pa.array([sums[k, e].tolist() for k, e in at], pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    changes = moved.where("was is null or was != code").select("x", "code", "was").mapInArrow(run, "part int, entry int, n long, s array<long>")
    sums = [F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)]
    return changes.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect()  # at most parts * entries rows


def _digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, p: Codebooks = Codebooks()) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row of vectors (vec_id, embedding, label).

    code: two hex digits for each part. error: squared distance to the coded vector, in
    integer components. label_error: error summed over the rows of its label.
    """
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, p)
    result = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    seeds = [r.v for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(p.entries).collect()]
    if not seeds:
        return spark.createDataFrame([], result)
    width = len(seeds[0]) // p.parts
    seeds = [s for s in seeds if len(s) == len(seeds[0])]
    dims = width * p.parts
    books = np.array([[s[k * width : (k + 1) * width] for s in seeds] for k in range(p.parts)], np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["v"].flatten().to_numpy().astype(np.int32).reshape(batch.num_rows, -1)[:, :dims]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array(_bytes(flat), pa.binary()), pa.nulls(batch.num_rows, pa.binary())], ["vec_id", "label", "x", "code"])

    state, path = written(kept.where(F.size("v") == len(seeds[0])).mapInArrow(packed, _STATE), "vectors")
    count, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _ in range(p.rounds):
        moved, after = written(_assign(state, spark.sparkContext.broadcast(books)), "vectors")
        for row in _deltas(moved, *books.shape):
            count[row.part, row.entry] += row.n
            sums[row.part, row.entry] += np.array(row[3:], np.int64)
        used = count > 0
        books = books.copy()
        books[used] = np.floor_divide(sums[used], count[used][:, None])
        remove(spark, path)
        state, path = moved.select("vec_id", "label", "x", "code"), after

    last, digest = spark.sparkContext.broadcast(books), _digest(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, error = _assigned(_components(batch["x"], dims), last.value)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.hex() for c in _bytes(codes.astype(np.uint8))]), pa.array(error)], ["vec_id", "label", "code", "error"])

    out = materialise(state.mapInArrow(coded, "vec_id long, label long, code string, error long"))
    remove(spark, path)
    labels = materialise(out.groupBy(F.col("label").alias("__tw_label")).agg(F.sum("error").alias("label_error")))
    labels = F.broadcast(labels) if labels.count() <= p.broadcast_labels else labels
    joined = out.join(labels, F.col("label").eqNullSafe(F.col("__tw_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
