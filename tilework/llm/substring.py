"""Removal of repeated word passages with suffix automata of reference shards.

A window is ``length`` consecutive words of one document. Every word covered by a
window that also starts in a document with a smaller doc_id goes; windows are
judged on the input. Words are compared as they are.

A suffix automaton of all documents can't be sent to every task, so documents only
meet the shards that can hold a match of theirs:

1. The anchor of a window is its least run of six words by hash, so equal windows
   have equal anchors. Anchors are grouped over all documents by hash range; those of
   one document only are dropped.
2. For each shared anchor the first document (smallest doc_id) that holds it is
   found. The stretches of a document whose windows have anchors with first
   document A are sent to A's shard; A's own stretches are the shard.
3. A shard's automaton is replicated, once for about every ``STREAM`` documents
   that come to it, and the others stream past for their matching statistics:
   maximal spans of at least ``length`` words that A holds are removed. A task
   holds one automaton, of one document's shared stretches, at a time.
4. A window that shares its anchor but isn't in A may still be in another earlier
   document. Such windows, few, are grouped by two independent hashes of 64 bits.

Skew: an anchor or shard that very many documents share is salted; first documents
are pre-aggregated. Nothing is capped. Broadcast are the list of very frequent
anchors, of bounded size (see ranges.py), their first documents, and the
ids of documents with repeats where they are at most ``broadcast_rows``; beyond
that the texts are shuffled.

Null texts have no words. Rows with equal doc_id don't remove from each other. Rows
without doc_id are compared with nothing and stay whole. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import blobs, gathered, hot_values, per_range, range_count, range_of
from .store import materialise, small_batches, stored
from .words import Block, blocks, mix, ngrams

LENGTH = 13
ANCHOR = 6
SALT_ROWS = 50_000
STREAM = 2_000


class Anchors:
    """Anchor of each window of a block: at (first word of each window), where (first word of its anchor) and value (hash)."""

    def __init__(self, b: Block, length: int):
        n = len(b.hash) - length + 1
        if n <= 0:
            self.at = self.where = np.zeros(0, np.int64)
            self.value = np.zeros(0, np.uint64)
            return
        g = ngrams(b.hash, ANCHOR)
        least, where, span = g, np.arange(len(g)), 1
        width = length - ANCHOR + 1
        while span < width:
            step = min(span, width - span)
            right = least[step:] < least[:-step]
            where = np.where(right, where[step:], where[:-step])
            least = np.where(right, least[step:], least[:-step])
            span += step
        self.at = np.flatnonzero(b.doc[:n] == b.doc[length - 1 :])
        self.where, self.value = where[self.at], least[self.at]

    def distinct(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, value) pairs without repeats."""
        change = np.ones(len(self.at), bool)
        change[1:] = self.where[1:] != self.where[:-1]
        d, v = doc[self.at[change]], self.value[change]
        order = np.lexsort((v, d))
        d, v = d[order], v[order]
        keep = np.ones(len(d), bool)
        keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
        return d[keep], v[keep]


def _first_of_hot(texts: DataFrame, hot: Broadcast, length: int) -> Broadcast:
    """Smallest doc_id and number of documents of each anchor that is so frequent that its rows are salted."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, b in blocks(batch.column(1)):
                d, v = Anchors(b, length).distinct(b.doc)
                keep = hot.value.count(v) >= SALT_ROWS
                yield pa.RecordBatch.from_arrays([pa.array(v[keep].view(np.int64)), pa.array(ids[at + d[keep]])], ["value", "doc_id"])

    found = [np.zeros(0, np.int64)] * 3
    if (hot.value.counts >= SALT_ROWS).any():
        with small_batches(texts.sparkSession):
            rows = texts.mapInArrow(emit, "value long, doc_id long").groupBy("value").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs")).toArrow()
        found = [rows[c].to_numpy() for c in ("value", "first", "docs")]
    values = found[0].view(np.uint64)
    order = np.argsort(values)
    return texts.sparkSession.sparkContext.broadcast((values[order], found[1][order], found[2][order]))


def _shared_anchors(texts: DataFrame, length: int) -> DataFrame:
    """doc_id, value, first, docs for each anchor of each document that another document has too."""
    n = range_count(texts)

    def values(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, b in blocks(batch.column(1)):
            yield Anchors(b, length).distinct(b.doc)[1]

    hot = hot_values(texts, values, n)
    firsts = _first_of_hot(texts, hot, length)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, b in blocks(batch.column(1)):
                d, v = Anchors(b, length).distinct(b.doc)
                yield v, ids[at + d]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for v, doc in gathered(anchors(batches), n):
            salts = (1 + hot.value.count(v) // SALT_ROWS).astype(np.uint64)
            yield blobs(range_of(mix(v + mix(doc.astype(np.uint64), 61) % salts, 62), n), v, doc)

    def work(_: int, v: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, v))
        v, doc = v[order], doc[order]
        head = np.ones(len(v), bool)
        head[1:] = v[1:] != v[:-1]
        group = np.cumsum(head) - 1
        new = np.append(True, (v[1:] != v[:-1]) | (doc[1:] != doc[:-1]))
        docs = np.bincount(group[new], minlength=int(head.sum()))[group]
        first = doc[head][group]
        known, least, many = firsts.value
        if len(known):
            slot = np.minimum(np.searchsorted(known, v), len(known) - 1)
            is_hot = known[slot] == v
            first, docs = np.where(is_hot, least[slot], first), np.where(is_hot, many[slot], docs)
        keep = new & (docs > 1)
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(v[keep].view(np.int64)), pa.array(first[keep]), pa.array(docs[keep].astype(np.int64))], ["doc_id", "value", "first", "docs"])

    return per_range(texts.mapInArrow(emit, "range int, v0 binary, v1 binary"), n, [np.uint64, np.int64], work, "doc_id long, value long, first long, docs long")


ROUTED = "first long, level int, salt int, streams boolean, doc_id long, start long, docs long, passage string"


def _stretches(texts: DataFrame, lists: DataFrame, length: int) -> DataFrame:
    """The stretches of each document that go to shards, as ROUTED."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = batch.column(0).to_numpy(), batch.column(2)
            for at, b in blocks(batch.column(1)):
                anchors = Anchors(b, length)
                bounds = np.searchsorted(b.doc[anchors.at], np.arange(b.docs + 1)) if len(anchors.at) else np.zeros(b.docs + 1, np.int64)
                rows: list[tuple] = []
                for d in range(b.docs):
                    x, z = bounds[d], bounds[d + 1]
                    own = shared[at + d].values
                    if x == z or own is None:
                        continue
                    keys, first, docs = (own.field(i).to_numpy() for i in range(3))
                    order = np.argsort(keys)
                    keys, first, docs = keys[order], first[order], docs[order]
                    v = anchors.value[x:z].view(np.int64)
                    slot = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
                    hit = keys[slot] == v
                    to, many = np.where(hit, first[slot], 0), np.where(hit, docs[slot], 0)
                    edge = np.flatnonzero(np.append(True, (hit[1:] != hit[:-1]) | (to[1:] != to[:-1])))
                    doc_id, words = int(ids[at + d]), int(b.doc_first[d])
                    levels = {1 << int(k // STREAM).bit_length() for k in np.unique(many[hit & (to == doc_id)]).tolist()}
                    for s, e in zip(edge.tolist(), [*edge[1:].tolist(), z - x], strict=True):
                        if not hit[s]:
                            continue
                        p, q = int(anchors.at[x + s]), int(anchors.at[x + e - 1]) + length - 1
                        most, text = int(many[s:e].max()), b.text(b.first[p], b.last[q])
                        if to[s] == doc_id:
                            rows += [(doc_id, level, salt, False, doc_id, p - words, most, text) for level in levels for salt in range(level)]
                        else:
                            level = 1 << int(most // STREAM).bit_length()
                            rows.append((int(to[s]), level, doc_id % level, True, doc_id, p - words, most, text))
                names = [x.split()[0] for x in ROUTED.split(", ")]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                for k in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 2000], strict=True), kinds, strict=True)], names)

    return texts.join(lists, "doc_id").select("doc_id", "text", "shared").mapInArrow(cut, ROUTED)


class SuffixAutomaton:
    """All runs of words of the passages that were added."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size, self.last = [-1], [0], 0

    def add(self, words: list) -> None:
        nxt, link, size, last = self.next, self.link, self.size, self.last
        for c in [*words, object()]:  # the end mark equals nothing
            cur = len(nxt)
            nxt.append({})
            size.append(size[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    size.append(size[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.last = last

    def statistics(self, words: list) -> list[int]:
        """For each word the length of the longest run that ends there and is in a passage."""
        nxt, link, size, at, n, out = self.next, self.link, self.size, 0, 0, []
        for c in words:
            while at and c not in nxt[at]:
                at = link[at]
                n = size[at]
            to = nxt[at].get(c)
            if to is None:
                n = 0
            else:
                at, n = to, n + 1
            out.append(n)
        return out


FOUND = "doc_id long, start long, stop long, h1 long, h2 long"


def _words(text: str) -> list[str]:
    return text.translate(_BLANKS).split(" ")


_BLANKS = {c: " " for c in range(0x09, 0x0E)}


def _spans(words: list[str], shard: SuffixAutomaton, length: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Maximal spans (merged where they overlap), and the windows that match."""
    n = np.array(shard.statistics(words))
    ends = np.flatnonzero(n >= length)
    spans: list[tuple[int, int]] = []
    for e in ends.tolist():
        s = e - int(n[e]) + 1
        if spans and s <= spans[-1][1]:
            spans[-1] = (min(s, spans[-1][0]), e + 1)
        else:
            spans.append((s, e + 1))
    return spans, ends - length + 1


def _against_shards(routed: DataFrame, length: int) -> DataFrame:
    """Spans to remove (h1 null), and windows that no shard decides (with their hashes), as FOUND."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, last = None, SuffixAutomaton(), (None, ([], None))
        for batch in batches:
            out: list[tuple] = []
            open_: list[tuple[int, int, str, np.ndarray]] = []
            for first, level, salt, streams, doc_id, start, docs, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (first, level, salt) != key:
                    key, shard, last = (first, level, salt), SuffixAutomaton(), (None, ([], None))
                words = [w for w in _words(text) if w] if last[0] != text or not streams else []
                if not streams:
                    shard.add(words)
                    continue
                if last[0] != text:
                    last = (text, (*_spans(words, shard, length), len(words)))
                spans, matched, count = last[1]
                out += [(doc_id, start + s, start + e, None, None) for s, e in spans]
                if docs > 2 and len(matched) < count - length + 1:
                    rest = np.ones(count - length + 1, bool)
                    rest[matched] = False
                    open_.append((doc_id, start, text, rest))
            if open_:
                for at, b in blocks(pa.array([x[2] for x in open_], pa.string())):
                    where, h1 = b.grams(length)
                    _, h2 = b.grams(length, 1)
                    begin = np.searchsorted(b.doc[where], np.arange(b.docs + 1))
                    for d in range(b.docs):
                        doc_id, start, _, rest = open_[at + d]
                        part = slice(begin[d], begin[d + 1])
                        out += [(doc_id, start + p, start + p + length, x, y) for p, x, y in zip(np.flatnonzero(rest).tolist(), h1[part][rest].view(np.int64).tolist(), h2[part][rest].view(np.int64).tolist(), strict=True)]
            for k in range(0, len(out), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[k : k + 20_000], strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    return routed.repartition("first", "level", "salt").sortWithinPartitions("first", "level", "salt", "streams").mapInArrow(match, FOUND)


def repeated_spans(docs: DataFrame, length: int = LENGTH, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id and spans (array of start, stop: word numbers) for documents with words to remove."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    lists = stored(_shared_anchors(texts, length).groupBy("doc_id").agg(F.collect_list(F.struct("value", "first", "docs")).alias("shared")), "anchors")
    found = stored(_against_shards(_stretches(_narrowed(texts, lists.select("doc_id"), broadcast_rows), lists, length), length), "spans")
    open_ = found.where("h1 is not null")
    least = open_.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least")
    late = open_.join(least, ["h1", "h2"]).where("doc_id > least").select("doc_id", "start", "stop")
    spans = found.where("h1 is null").select("doc_id", "start", "stop").unionByName(late)
    return spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def _narrowed(texts: DataFrame, ids: DataFrame, broadcast_rows: int) -> DataFrame:
    """Only the texts with those ids, where the ids are few enough to be sent to every task; else all."""
    return texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= broadcast_rows else texts


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column(2) if batch.num_columns > 2 else None
        for at, b in blocks(batch.column(1)):
            counts, removed, kept = np.diff(b.doc_first), [], []
            for d in range(b.docs):
                a, z = int(b.doc_first[d]), int(b.doc_first[d + 1])
                words = _words(b.text(b.first[a], b.last[z - 1])) if z > a else []
                words = [w for w in words if w]
                own = spans[at + d].values if spans is not None else None
                gone = 0
                if own is not None and len(own):
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, own.field(0).to_numpy(), 1)
                    np.add.at(step, own.field(1).to_numpy(), -1)
                    stays = np.cumsum(step[:-1]) == 0
                    gone = len(words) - int(stays.sum())
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                removed.append(gone)
                kept.append(" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, b.docs), pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, length: int = LENGTH, broadcast_rows: int = 500_000) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    spans = materialise(repeated_spans(docs, length, broadcast_rows))
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    if spans.count() <= broadcast_rows:
        ids = F.broadcast(spans.select("doc_id"))
        touched = texts.join(ids, "doc_id", "left_semi").join(spans, "doc_id").select("doc_id", "text", "spans")
        return texts.join(ids, "doc_id", "left_anti").mapInArrow(_kept, KEPT).unionByName(touched.mapInArrow(_kept, KEPT))
    return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_kept, KEPT)
