"""Removal of repeated passages by overlapping three-line windows.

Each run of three consecutive lines that holds a word is a window. Its first
occurrence in the corpus, by (doc_id, line number), stays; the lines of every
later occurrence go, overlapping ones merged into one stretch. Lines are what
lies between ``\\n``, compared exactly. A text of fewer than three lines has no
window and stays as it is, as do null and empty texts. Where a window repeats
within a text at overlapping places, the lines of the later one go, so ten equal
lines in a row leave one. With equal doc_id (repeated rows) the rows are told
apart by nothing: both count as the same place, and neither removes the other.

Windows are told apart by two independent hashes of 64 bits over their lines' hashes
(64 bits as well); lines themselves aren't compared.

Scale: one row of 32 bytes per window is shuffled, pre-aggregated to its first
place; windows seen once are dropped before anything meets the texts. A window
that very many documents share is a skewed join key against a single row, which
adaptive execution splits. Per document only line numbers are gathered. The ids of
documents with repeats are broadcast where they are at most ``broadcast_rows``, and
only these documents' texts are shuffled; beyond that all are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .words import blocks, ngrams

LINES = 3


def _window_rows(batches: Iterator[pa.RecordBatch], lines: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for at, b in blocks(batch.column(1)):
            doc, first, last, line = b.lines()
            if len(line) < lines:
                continue
            start = np.searchsorted(doc, np.arange(b.docs))
            worded = np.searchsorted(b.first, last[lines - 1 :]) > np.searchsorted(b.first, first[: 1 - lines])
            keep = (doc[: 1 - lines] == doc[lines - 1 :]) & worded
            d = doc[: 1 - lines][keep]
            where = np.flatnonzero(keep) - start[d]
            one, two = ngrams(line, lines)[keep], ngrams(line, lines, 1)[keep]
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(ids[at + d]), pa.array(where.astype(np.int32))], ["h1", "h2", "doc_id", "line"])


def repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id and the first lines, from 0, of its windows that occurred before."""
    windows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _window_rows(it, lines), "h1 long, h2 long, doc_id long, line int")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(first, ["h1", "h2"]).where("struct(doc_id, line) != first")
    return later.groupBy("doc_id").agg(F.collect_set("line").alias("__tw_starts"))


def _stays(text: Column, starts: Column, lines: int) -> list[Column]:
    """Text, n_lines and n_removed when the windows at starts go (null: none)."""
    parts = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + (lines - 1)))))
    left = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i)), "\n")
    return [F.when(starts.isNull(), text).otherwise(left).alias("text"), F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")]


def line_dedup(docs: DataFrame, lines: int = LINES, broadcast_rows: int = 500_000, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with text replaced by what stays, and two columns of counts (long): lines before, and removed ones. Other columns stay as they are."""
    starts = materialise(repeated_lines(docs, lines).withColumnRenamed("doc_id", "__tw_doc"))
    same = F.col("doc_id") == F.col("__tw_doc")
    own = [c for c in docs.columns if c not in counts]

    def result(rows: DataFrame, found: Column) -> DataFrame:
        text, n_lines, n_removed = _stays(F.col("text"), found, lines)
        return rows.select(*[text if c == "text" else F.col(f"`{c}`") for c in own], n_lines.alias(counts[0]), n_removed.alias(counts[1]))

    if starts.count() > broadcast_rows:
        return result(docs.join(starts, same, "left"), F.col("__tw_starts"))
    # few documents have repeats: only their texts are shuffled
    ids = F.broadcast(starts.select("__tw_doc"))
    touched = docs.join(ids, same, "left_semi").join(starts, same)
    return result(docs.join(ids, same, "left_anti"), F.lit(None).cast("array<int>")).unionByName(result(touched, F.col("__tw_starts")))
