"""Sinks for reports and streams: text files in order, and byte segments as one stream.

    write_tabs(stats, path)                      # tab-separated rows, in order of the first column
    spark.dataSource.register(ByteStream)
    segments.write.format("bytestream").save(path)

Rows of a report are range-partitioned by their order, so files in the order of their names are the
report, however large. Segments (number long, data binary) become files that, one behind the other, are the
stream; range-partition and sort them by number before. The paths of ``bytestream`` must be ones that
executors can open as files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter

from .rawplanar import OrderedFiles, check_empty


def write_tabs(rows: DataFrame, path: str, order: Sequence[str], files: int = 1, header: bool = True) -> None:
    """Rows as tab-separated text in so many files, in their order."""
    rows.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("sep", "\t").option("header", header).option("nullValue", "").csv(path)


def distortion_report(frames: DataFrame, fps: int) -> DataFrame:
    """frames (frame_no, bytes, psnr_y, psnr_cb, psnr_cr) as the rows of the report: one for each frame in KiB, and last the means, with KiB per second."""
    cells: list[Column] = [F.round(F.col(c), 6).alias(c) for c in ("psnr_y", "psnr_cb", "psnr_cr")]
    each = frames.select(F.col("frame_no").cast("string").alias("frame"), F.round(F.col("bytes") / 1024, 6).alias("kib"), *cells, F.col("frame_no").cast("long").alias("place"))
    means = frames.agg(F.avg("bytes").alias("bytes"), *[F.avg(c).alias(c) for c in ("psnr_y", "psnr_cb", "psnr_cr")])
    last = means.select(F.lit("avg").alias("frame"), F.round(F.col("bytes") * fps / 1024, 6).alias("kib"), *cells, F.lit(2**62).alias("place"))
    return each.unionByName(last)


class ByteStream(DataSource):
    """Options: path."""

    @classmethod
    def name(cls) -> str:
        return "bytestream"

    def schema(self) -> str:
        return "number long, data binary"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        check_empty(self.options["path"], overwrite)
        return OrderedFiles(self.options["path"], "segments", ".bin", "number", ["data"])
