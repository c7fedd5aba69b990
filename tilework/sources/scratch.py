"""Where intermediate results go: the shared folder that the cluster names.

``spark.checkpoint.dir`` is read from the session. Only where it is unset and
Spark runs on this machine alone (tests) a temporary folder is made; on a cluster
that is an error, as executors couldn't see it. Intermediate results are column files
in that folder. They are read again by what is built on them, also after a lost executor, so they stay until
the session's context is stopped, Python ends, or ``clear`` is called.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written by each application, and the temporary folder of one on this machine.
_WRITTEN: dict[str, list[str]] = {}
_LOCAL: dict[str, str] = {}


def written_paths(spark: SparkSession) -> list[str]:
    """Folders of this application that are still there; the first call makes sure that they go with it."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _WRITTEN:
        _WRITTEN[app] = []
        stop = sc.stop

        def clear_and_stop() -> None:
            try:
                clear(spark)
            finally:
                stop()

        sc.stop = clear_and_stop  # of this context alone
        atexit.register(clear, spark)
    return _WRITTEN[app]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named
    if not (sc.master or "").startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL:
        _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="tilework-")
        written_paths(spark).append(_LOCAL[sc.applicationId])
    return _LOCAL[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it goes with the application."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    written_paths(spark).append(path)
    return path


def settled(df: DataFrame, name: str = "part") -> DataFrame:
    """Compute once and read from the shared folder from then on, so that what is built on it, however often, starts there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, wherever Spark has it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in written_paths(spark):
        written_paths(spark).remove(path)


def clear(spark: SparkSession) -> None:
    """Removes all intermediate results of this application; frames built on them can't be read any more."""
    if spark.sparkContext._jsc is None:  # stopped, and cleared then
        return
    for path in reversed([*written_paths(spark)]):
        remove(spark, path)
    _LOCAL.pop(spark.sparkContext.applicationId, None)
