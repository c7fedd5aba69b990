"""Raw planar 8-bit 4:2:0 video as a Spark data source, and frames as a table.

    spark.dataSource.register(RawPlanar)
    spark.read.format("rawplanar").option("width", 352).option("height", 288).load(path)

Rows: frame_no, y, cb, cr (binary, raster order). A file has no header: its size must be a whole
number of frames, else reading fails. Frames are read in ranges, one per task, each with a seek; filters on frame_no
leave tasks and bytes of other frames out with option prune and spark.sql.python.filterPushdown.enabled. The
path must be one that executors can open as a file; ``read_frames`` goes through Spark's own readers
for any other store, a clip of at most 2 GB at a time. Writing gives a folder of files, each with the frames of one partition and named by
the first of them; range-partition and sort by frame_no before, and the files in order are the clip.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "frame_no int, y binary, cb binary, cr binary"


class FrameRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, width: int, height: int, per_task: int):
        self.path, self.luma, self.per_task = path, width * height, per_task
        self.frame = self.luma * 3 // 2
        self.first, self.last = 0, None

    def partitions(self) -> Sequence[InputPartition]:
        size = os.path.getsize(self.path)
        if size % self.frame:
            raise ValueError(f"{self.path} ends within a frame")
        n = size // self.frame
        n = n if self.last is None else max(self.first, min(n, self.last))
        return [FrameRange(i, min(i + self.per_task, n)) for i in range(self.first, n, self.per_task)] or [FrameRange(0, 0)]

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        quarter = self.luma // 4
        with open(self.path, "rb") as f:
            f.seek(partition.first * self.frame)
            for n in range(partition.first, partition.last):
                data = f.read(self.frame)
                if len(data) != self.frame:
                    raise ValueError(f"frame {n} is cut short")
                yield n, data[: self.luma], data[self.luma : self.luma + quarter], data[self.luma + quarter :]


class _PruningReader(_Reader):
    """Spark refuses readers with pushFilters where the session doesn't push filters, so it is asked for by an option."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of frame_no decide which bytes are read; all other filters, and those that bounds can't express, stay with Spark."""
        for f in filters:
            own = getattr(f, "attribute", None) == ("frame_no",)
            least = {EqualTo: lambda v: v, GreaterThanOrEqual: lambda v: v, GreaterThan: lambda v: v + 1, In: lambda v: min(v)}
            most = {EqualTo: lambda v: v, LessThanOrEqual: lambda v: v, LessThan: lambda v: v - 1, In: lambda v: max(v)}
            value = getattr(f, "value", None)
            if not own or value is None or type(f) not in least | most or value == ():
                yield f
                continue
            if type(f) in least:
                self.first = max(self.first, least[type(f)](value))
            if type(f) in most:
                self.last = most[type(f)](value) + 1 if self.last is None else min(self.last, most[type(f)](value) + 1)
            if isinstance(f, In):  # its bounds are wider than it
                yield f


class _Part(WriterCommitMessage):
    def __init__(self, written: str, final: str):
        self.written, self.final = written, final


class OrderedFiles(DataSourceWriter):
    """Each task writes a file of its own, named by the number of its first row; committing renames them and removes files of an earlier write."""

    def __init__(self, path: str, prefix: str, suffix: str, number: str, columns: list[str]):
        self.path, self.prefix, self.suffix, self.number, self.columns = path, prefix, suffix, number, columns
        os.makedirs(path, exist_ok=True)

    def write(self, rows: Iterator) -> WriterCommitMessage | None:
        last, written, final = None, os.path.join(self.path, f".part-{uuid.uuid4().hex}"), ""
        for r in rows:
            if last is None:
                final = os.path.join(self.path, f"{self.prefix}-{r[self.number]:010d}{self.suffix}")
                out = open(written, "wb")  # noqa: SIM115
            elif r[self.number] <= last:
                raise ValueError("rows must come in order within a partition")
            for c in self.columns:
                out.write(bytes(r[c]))
            last = r[self.number]
        if last is None:
            return None
        out.close()
        return _Part(written, final)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m:
                os.replace(m.written, m.final)
        own = {os.path.basename(m.final) for m in messages if m}
        for name in os.listdir(self.path):
            if name not in own and (name.startswith(f"{self.prefix}-") and name.endswith(self.suffix) or name.startswith(".part-")):
                os.remove(os.path.join(self.path, name))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.written):
                os.remove(m.written)


def check_empty(path: str, overwrite: bool) -> None:
    if not overwrite and os.path.exists(path) and os.listdir(path):
        raise ValueError(f"{path} exists")


class RawPlanar(DataSource):
    """Options: path, width, height, frames_per_task, prune (true: bounds of frame_no decide what is read)."""

    @classmethod
    def name(cls) -> str:
        return "rawplanar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        kind = _PruningReader if self.options.get("prune", "").lower() == "true" else _Reader
        return kind(self.options["path"], int(self.options["width"]), int(self.options["height"]), int(self.options.get("frames_per_task", "16")))

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        check_empty(self.options["path"], overwrite)
        return OrderedFiles(self.options["path"], "frames", ".yuv", "frame_no", ["y", "cb", "cr"])


def planes(frames: DataFrame, width: int, height: int) -> DataFrame:
    """frames (frame_no, data: a whole frame's bytes) with its planes instead."""
    luma = width * height
    cut = lambda first, size: F.expr(f"substring(data, {first}, {size})")
    whole = F.when(F.length("data") == luma * 3 // 2, F.col("data")).otherwise(F.raise_error(F.lit("a frame is cut short")))
    return frames.withColumn("data", whole).select("frame_no", cut(1, luma).alias("y"), cut(luma + 1, luma // 4).alias("cb"), cut(luma * 5 // 4 + 1, luma // 4).alias("cr"))


def read_frames(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """The same rows from any store that Spark reads: a file per clip, cut into frames where it is read."""
    frame = width * height * 3 // 2
    clip = spark.read.format("binaryFile").load(path).withColumn("n", F.expr(f"length(content) div {frame}"))
    whole = F.when(F.length("content") % frame == 0, F.col("content")).otherwise(F.raise_error(F.lit("a clip ends within a frame")))
    rows = clip.select(F.col("path").alias("clip"), whole.alias("content"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    frames = rows.select("clip", F.col("i").cast("int").alias("frame_no"), F.expr(f"substring(content, cast(i * {frame} + 1 as int), {frame})").alias("data"))
    return planes(frames, width, height)


def plane_blocks(frames: DataFrame, plane: str, width: int, height: int, n: int = 8) -> DataFrame:
    """frame_no, bx, by, px: n x n blocks of a plane as arrays of samples."""
    across, down = width // n, height // n

    def cut(column: pa.Array) -> pa.Array:
        whole = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, height, width)[:, : down * n, : across * n]
        px = whole.reshape(-1, down, n, across, n).transpose(0, 1, 3, 2, 4).astype(np.int32).reshape(-1)
        each = pa.ListArray.from_arrays(pa.array(np.arange(0, len(px) + 1, n * n), pa.int32()), pa.array(px))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(each) + 1, across * down), pa.int32()), each)

    out = frames.where(F.col(plane).isNotNull()).select("frame_no", F.posexplode(F.arrow_udf(cut, "array<array<int>>")(plane)).alias("i", "px"))
    return out.select("frame_no", (F.col("i") % across).alias("bx"), F.expr(f"i div {across}").cast("int").alias("by"), "px")


def planes_of_blocks(blocks: DataFrame, plane: str, width: int, height: int, *by: str) -> DataFrame:
    """by, frame_no and the plane (binary, raster order) of its blocks (frame_no, x, y: first sample; n: size; px): blocks of all sizes, in any order. Samples that no block covers are an error.

    A frame is put together in one group; it is bounded by the size of a picture, not by the clip.
    """
    parts = blocks.groupBy(*by, "frame_no").agg(F.collect_list(F.struct("x", "y", "n", F.transform("px", lambda v: v.cast("short")).alias("px"))).alias("parts"))

    def scatter(column: pa.Array) -> pa.Array:
        out = []
        for frame in column:
            flat = frame.values.flatten()
            x, y, n = (flat[i].to_numpy(zero_copy_only=False) for i in range(3))
            px, first = flat[3].flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(n * n)])
            whole = np.full((height, width), -1, np.int16)
            for size in np.unique(n):
                some = np.flatnonzero(n == size)
                inside = np.arange(size)
                at = (first[some][:, None] + np.arange(size * size)).reshape(-1, size, size)
                whole[y[some][:, None, None] + inside[:, None], x[some][:, None, None] + inside] = px[at]
            if (whole < 0).any():
                raise ValueError("blocks leave samples of a frame out")
            out.append(whole.astype(np.uint8).tobytes())
        return pa.array(out, pa.binary())

    return parts.select(*by, "frame_no", F.arrow_udf(scatter, "binary")("parts").alias(plane))
