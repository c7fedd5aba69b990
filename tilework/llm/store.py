"""Intermediate results of the corpus operators, in the shared folder that the cluster names (see sources/scratch.py).

What is computed at once sends texts to Python in small batches, by a setting that
is put back afterwards. What is computed later, with a frame that an operator returns,
runs under the session's own settings; Spark bounds its batches to 64 MB unless told
otherwise (spark.sql.execution.arrow.maxBytesPerBatch).
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import clear, fresh_path, remove, shared_dir, written_paths

__all__ = ["clear", "fresh_path", "left_out", "materialise", "remove", "scratch", "shared_dir", "small_batches", "stored", "written"]

#: How many blocks of each session want small batches just now, and its own setting.
_SMALL: dict[int, list] = {}
_LOCK = Lock()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Batches to Python have at most so many rows meanwhile."""
    key, name = "spark.sql.execution.arrow.maxRecordsPerBatch", id(spark._jsparkSession)
    with _LOCK:  # threads of one session share its setting: the first sets it, the last puts it back
        state = _SMALL.setdefault(name, [0, spark.conf.get(key)])
        state[0] += 1
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, rows)
    try:
        yield
    finally:
        with _LOCK:
            state[0] -= 1
            if not state[0]:
                spark.conf.set(key, state[1])
                del _SMALL[name]


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """What is written meanwhile goes at the end, but for the paths put into the list."""
    before, keep = set(written_paths(spark)), []
    yield keep
    for path in [p for p in written_paths(spark) if p not in before and p not in keep]:
        remove(spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Compute once and read from the shared folder from then on; the frame and its path."""
    path = fresh_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """written() without the path."""
    return written(df, name)[0]


def materialise(df: DataFrame) -> DataFrame:
    """stored() without a name of its own."""
    return stored(df, "part")


def left_out(docs: DataFrame, ids: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids (doc_id: long). Texts stay where they are if the ids are few enough to be sent to every task."""
    ids = materialise(ids.select(F.col("doc_id").alias("__tw_doc")).distinct())
    ids = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    return docs.join(ids, F.col("doc_id") == F.col("__tw_doc"), "left_anti")
