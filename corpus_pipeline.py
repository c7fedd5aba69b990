"""A training-corpus pipeline: documents in, packed sequences out.

STAGES in order; each takes (spark, docs, sf_dir), and its result is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents. Rows without doc_id pass line_dedup and near_duplicates as
they are, and are judged like others elsewhere:

* quality_rules drops documents that the base rule or the adaptive rules reject.
* line_dedup removes later occurrences of three-line passages; a document of
  which no word is left goes. n_chars follows the text.
* near_duplicates keeps, of each component of linked documents, the one with the
  smallest doc_id.
* decontamination drops documents that contain a benchmark item.
* packing returns where each piece of each document is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilework.llm.decontaminate import decontaminate
from tilework.llm.linededup import line_dedup
from tilework.llm.ngramjoin import one_of_each
from tilework.llm.packing import pack
from tilework.llm.quality import quality_filter
from tilework.llm.queries import packing_parameters
from tilework.llm.store import remove, scratch, written


def _alone(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The frame, computed and written at once in small batches, without what was written on the way."""
    with scratch(spark) as keep:
        out, path = written(build(), name)
        keep.append(path)
    return out


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _alone(spark, lambda: quality_filter(docs), "pipeline-quality")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup(docs, counts=("__lines", "__removed")).where(r"__removed = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _alone(spark, lambda: decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "pipeline-clean")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, packing_parameters())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs, after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.append(after)
        if path:
            remove(spark, path)
        path = after
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
