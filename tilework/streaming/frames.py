"""Frame statistics as a stream: files of tile sizes that arrive one by one.

Frames are independent of each other, so a frame's statistics need no state across files; a total
per group of pictures is kept by Spark's streaming aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILES = "gop long, frame long, tile int, bytes long"


def tile_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Tile sizes from Parquet files as they appear under path."""
    return spark.readStream.schema(TILES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def gop_totals(tiles: DataFrame) -> DataFrame:
    """gop, tiles, bytes, largest; works on streams (output mode complete or update) and tables alike."""
    return tiles.groupBy("gop").agg(F.count("*").alias("tiles"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
