"""Toxicity of texts by a small convolutional network over hashed word embeddings, trained in numpy.

A text's words (A-Z lowered, ASCII punctuation removed) are looked up in four hashed tables: two
by independent hashes of the whole word, so that a rare word which shares a place with a
telling one in one table is told apart by the other, and two by its first 4 and 7 bytes, for inflected forms. Filters of one, two and three
words run over the joined vectors. Each filter's largest value is taken over each run of ``PIECE`` words; the
network's last layer sees the largest over the whole text and the mean over its runs, so long texts count with all their words. ``score`` is a
logistic function of its output, calibrated on rows that the network hasn't seen.

``thresholds``: for each language, the score from which texts are flagged, is calibrated on the same
rows: the cut with the best F1, drawn towards that of all languages where a language has few toxic rows.
It is applied by the column flagged; the score itself never sees the language.

Fitting learns from every labelled row that isn't held out, with all its words: a quarter of them, by a hash of doc_id,
calibrates, the rest trains. Training rows are dealt to shards by that hash (``Network.shard_rows`` each, ``Network.shards`` at most, from
where on shards grow). In a round, a task takes each shard's rows through steps of gradient descent from the network that all
share, a few texts at a time, each row at least once; what the shards changed is then averaged by Spark, number by number, over the shards
that changed it, and the averaged network starts the next round. Averages are of whole numbers (2^-32), so they don't depend on the order of
rows or files. One shard needs one round. Calibration and thresholds count all rows of their quarter, by language and 1/1024 of the network's output.

Broadcast: the network with its state (about 15 MB, fixed), ids of labelled rows while at most 500,000. Shuffled: labels, texts of the rows learned
from, and in each round at most one row per number group of the network and shard. Sent to the driver: the averaged network.

Defined results:
* A null text is scored as an empty one. Null doc_id: held_out is false; the row can't be learned from.
* Documents with several rows are learned from with each of them. Labels with several rows for a document count as toxic if one of them does; null labels don't count.
* Repeated rows are scored alike. No toxic or no other labelled row: every score is the share of toxic rows
  (0 without labels) and no row is flagged. Empty table: no rows. Columns of docs beyond doc_id, text and lang aren't read.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, small_batches
from .words import _IS_SPACE, Block, blocks, give_back, mix, text_buffers

#: Words of a run; a window that starts in a run may end in the next one.
PIECE, WIDTHS = 128, (1, 2, 3)
#: Rows of the tables as a power of two, and numbers in a row.
WORD_BITS, PREFIX_BITS, DIMS = 17, 16, 8
PREFIXES = (4, 7)
_TABLES = ((0, WORD_BITS), (1, WORD_BITS), (2, PREFIX_BITS), (3, PREFIX_BITS))
#: Runs that are worked on at once.
LOT = 256
_WORD = ~_IS_SPACE
_DROPPED = np.zeros(256, bool)
_DROPPED[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


@dataclass(frozen=True)
class Network:
    """filters: of each width. shard_rows, shards: rows of a shard, and most shards; rounds: of averaging, where there are several. steps: of a shard in all at least, a row once a round; lot_words: words that are worked on before the next ones. threshold: of predicted."""

    filters: int = 8
    shard_rows: int = 4_000
    shards: int = 64
    rounds: int = 4
    lot_words: int = 1_000_000
    steps: int = 900
    batch: int = 32
    rate: float = 0.08
    threshold: float = 0.7
    seed: int = 12


def word_rows(block: Block) -> np.ndarray:
    """Rows of the tables for each word (words x tables); row 0 stands for no word."""
    keys = [block.hash, mix(block.hash, 7), *[block.span_hash(block.first, np.minimum(block.last, block.first + n)) for n in PREFIXES]]
    return np.stack([(k >> np.uint64(64 - bits)).astype(np.int32) % ((1 << bits) - 1) + 1 for k, (_, bits) in zip(keys, _TABLES, strict=True)], 1)


def plain(column: pa.Array) -> pa.Array:
    """The texts without ASCII punctuation."""
    data, offsets = text_buffers(column)
    keep = ~_DROPPED[data]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at[offsets].tobytes()), pa.py_buffer(data[keep].tobytes()))


def runs_of(rows: np.ndarray, doc_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of words starts and how many texts' runs come before: starts, and the first run of each text. A text without words has one empty run."""
    count = np.diff(doc_first)
    runs = np.maximum(1, -(-count // PIECE))
    first = np.concatenate([[0], np.cumsum(runs)])
    within = np.arange(first[-1]) - np.repeat(first[:-1], runs)
    return np.repeat(doc_first[:-1], runs) + PIECE * within, first


def padded(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Table rows of the words of each run and of the words that its last windows reach (runs x words x tables), 0 beyond the text's end."""
    at = starts[:, None] + np.arange(PIECE + WIDTHS[-1] - 1)
    inside = at < ends[:, None]
    out = np.zeros((*at.shape, rows.shape[1]), np.int32)
    out[inside] = rows[at[inside]]
    return out


@dataclass
class Model:
    """tables, filters (one array per width: width*inputs x filters), their biases, last layer and calibration."""

    tables: list[np.ndarray]
    filters: list[np.ndarray]
    bias: np.ndarray
    last: np.ndarray
    offset: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    cuts: dict = field(default_factory=dict)

    def maxima(self, words: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest value of each filter in each run; where: also at which word."""
        x = np.concatenate([t[words[:, :, k]] for k, t in enumerate(self.tables)], 2)
        best, at = [], []
        for n, w in zip(WIDTHS, self.filters, strict=True):
            y = sum(x[:, j : j + PIECE] @ part for j, part in enumerate(np.split(w, n)))
            if where:
                at.append(y.argmax(1))
            best.append(y.max(1))
        return np.concatenate(best, 1) + self.bias, np.concatenate(at, 1) if where else None

    def raw(self, rows: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
        starts, first = runs_of(rows, doc_first)
        ends = np.repeat(doc_first[1:], np.diff(first))
        top = np.concatenate([np.tanh(self.maxima(padded(rows, starts[a : a + LOT], ends[a : a + LOT]))[0]) for a in range(0, len(starts), LOT)])
        seen = np.concatenate([np.maximum.reduceat(top, first[:-1]), np.add.reduceat(top, first[:-1]) / np.diff(first)[:, None]], 1)
        return seen @ self.last + self.offset

    def scores(self, rows: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(doc_first) - 1, self.constant)
        return sigmoid(self.slope * self.raw(rows, doc_first).astype(np.float64) + self.shift)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Learner:
    """A network in training: Adagrad with the sums of squares of each row of the tables (seen) and of each other number (past)."""

    def __init__(self, p: Network):
        rng = np.random.default_rng(p.seed)
        inputs, kinds = DIMS * len(_TABLES), p.filters * len(WIDTHS)
        tables = [rng.normal(0, 0.05, (1 << bits, DIMS)).astype(np.float32) for _, bits in _TABLES]
        for t in tables:
            t[0] = 0
        filters = [rng.normal(0, 1 / np.sqrt(n * inputs), (n * inputs, p.filters)).astype(np.float32) for n in WIDTHS]
        self.p, self.model = p, Model(tables, filters, np.zeros(kinds, np.float32), rng.normal(0, 0.3, 2 * kinds).astype(np.float32), 0.0)
        self.seen = [np.zeros(len(t), np.float32) for t in tables]
        self.past = [np.full_like(w, 1e-3) for w in (*filters, self.model.bias, self.model.last)]
        self.past_offset = 1e-3

    def copy(self) -> Learner:
        return copy.deepcopy(self)

    def step(self, texts: list[np.ndarray], labels: np.ndarray) -> None:
        """One step against some texts, given as table rows of their words; fewer than a batch weigh less."""
        p, m = self.p, self.model
        kinds = p.filters * len(WIDTHS)
        rows = np.concatenate(texts)
        doc_first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        starts, first = runs_of(rows, doc_first)
        count = np.diff(first)
        words = padded(rows, starts, np.repeat(doc_first[1:], count))
        found = [m.maxima(words[a : a + LOT], where=True) for a in range(0, len(words), LOT)]
        top, at = np.tanh(np.concatenate([t for t, _ in found])), np.concatenate([a for _, a in found])
        whole, mean = np.maximum.reduceat(top, first[:-1]), np.add.reduceat(top, first[:-1]) / count[:, None]
        z = np.concatenate([whole, mean], 1) @ m.last + m.offset
        dz = ((sigmoid(z) - labels) / p.batch).astype(np.float32)
        d_last = np.concatenate([whole, mean], 1).T @ dz + 1e-4 * m.last
        # back through the mean of all runs, and through the run that holds the largest value
        doc = np.repeat(np.arange(len(texts)), count)
        dtop = (dz / count)[doc][:, None] * m.last[kinds:]
        leads = top == whole[doc]
        leads = leads & (np.cumsum(leads, 0) - (np.cumsum(leads, 0) - leads)[first[:-1]][doc] == 1)
        dtop += leads * (dz[doc][:, None] * m.last[:kinds])
        dy = (dtop * (1 - top * top)).astype(np.float32)
        d_bias, d_filters, inputs = dy.sum(0), [], DIMS * len(_TABLES)
        ids, steps, r = [], [], np.arange(len(words))[:, None]
        for k, n in enumerate(WIDTHS):
            own = slice(k * p.filters, (k + 1) * p.filters)
            g, pos, w, d = dy[:, own], at[:, own], m.filters[k], []
            for j in range(n):
                hit = words[r, pos + j]  # runs x filters x tables
                x = np.concatenate([t[hit[:, :, i]] for i, t in enumerate(m.tables)], 2)
                d.append(np.einsum("rfi,rf->if", x, g))
                ids.append(hit.reshape(-1, len(_TABLES)))
                steps.append((g[:, :, None] * w[j * inputs : (j + 1) * inputs].T[None]).reshape(-1, inputs))
            d_filters.append(np.concatenate(d) + 1e-5 * w)
        for w, g, h in zip((*m.filters, m.bias, m.last), (*d_filters, d_bias, d_last), self.past, strict=True):
            h += g * g
            w -= p.rate * g / np.sqrt(h)
        total_dz = float(dz.sum())
        self.past_offset += total_dz**2
        m.offset -= p.rate * total_dz / self.past_offset**0.5
        all_ids, all_steps = np.concatenate(ids), np.concatenate(steps)
        for k, t in enumerate(m.tables):
            order = np.argsort(all_ids[:, k], kind="stable")
            one = all_ids[order, k]
            begin = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
            one, total = one[begin], np.add.reduceat(all_steps[order, k * DIMS : (k + 1) * DIMS], begin)
            total[one == 0] = 0
            self.seen[k][one] += (total * total).mean(1)
            t[one] -= p.rate * total / np.sqrt(self.seen[k][one] + 1e-9)[:, None]

    def lesson(self, texts: list[np.ndarray], labels: np.ndarray, steps: int | None, repeat: int, seed: int) -> None:
        """Steps with as many toxic texts as others, of which the fewer come again: so many, or as many as show each text so often."""
        rng, half = np.random.default_rng([self.p.seed, seed]), self.p.batch // 2
        kinds = [k for k in (np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)) if len(k)]
        if not kinds:
            return
        steps = steps or repeat * -(-max(map(len, kinds)) // half)
        turns = [np.concatenate([rng.permutation(k) for _ in range(-(-steps * half // len(k)))]) for k in kinds]
        for i in range(steps):
            pick = np.concatenate([t[i * half : (i + 1) * half] for t in turns])
            self.step([texts[j] for j in pick], labels[pick])

    def others(self) -> list[np.ndarray]:
        """What isn't a table, and the past of it, as two flat arrays."""
        m = self.model
        return [np.concatenate([*(np.asarray(w, np.float64).ravel() for w in ws), [last]]) for ws, last in (((*m.filters, m.bias, m.last), m.offset), (self.past, self.past_offset))]

    def set_others(self, now: np.ndarray, past: np.ndarray) -> None:
        at, m = 0, self.model
        for w, h in zip((*m.filters, m.bias, m.last), self.past, strict=True):
            w[...], h[...] = now[at : at + w.size].reshape(w.shape), past[at : at + w.size].reshape(w.shape)
            at += w.size
        m.offset, self.past_offset = float(now[at]), float(past[at])

    def changes(self, start: Learner) -> pa.RecordBatch:
        """What training changed since start: a row per row of a table that it touched and per eight other numbers, numbered through."""
        at, unit, delta, seen = 0, [], [], []
        for t, before, s, old in zip(self.model.tables, start.model.tables, self.seen, start.seen, strict=True):
            hit = np.flatnonzero(s > old)
            unit.append(hit + at)
            delta.append(t[hit].astype(np.float64) - before[hit])
            seen.append(s[hit].astype(np.float64))
            at += len(t)
        for now, before in zip(self.others(), start.others(), strict=True):
            d = np.zeros((-(-len(now) // DIMS), DIMS))
            d.ravel()[: len(now)] = now - before
            unit.append(np.arange(len(d)) + at)
            delta.append(d)
            seen.append(np.zeros(len(d)))
            at += len(d)
        whole = np.rint(np.concatenate(delta) * _UNIT).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(unit)), *(pa.array(whole[:, i].copy()) for i in range(DIMS)), pa.array(np.concatenate(seen))], ["unit", *_DELTAS, "seen"])

    def average(self, changed: pa.Table) -> None:
        """Goes on by the mean of what shards changed (unit, sums of the deltas, n, largest seen)."""
        changed = changed.sort_by("unit")
        unit, n = (changed[c].to_numpy().astype(np.int64) for c in ("unit", "n"))
        mean = np.stack([changed[c].to_numpy() for c in _DELTAS], 1) / (n[:, None] * _UNIT)
        seen, at = changed["seen"].to_numpy(), 0
        for t, s in zip(self.model.tables, self.seen, strict=True):
            some = slice(*np.searchsorted(unit, [at, at + len(t)]))
            t[unit[some] - at] += mean[some].astype(np.float32)
            s[unit[some] - at] = seen[some]
            at += len(t)
        now, past = self.others()
        size = -(-len(now) // DIMS) * DIMS
        rest = mean[np.searchsorted(unit, at) :].ravel()
        self.set_others(now + rest[: len(now)], past + rest[size : size + len(past)])

    def done(self) -> Model:
        for t, s in zip(self.model.tables, self.seen, strict=True):
            t[s == 0] = 0  # rows that never mattered say nothing
        return self.model


#: A delta of 1 as a whole number, and the columns of a row of deltas.
_UNIT, _DELTAS = float(1 << 32), [f"d{i}" for i in range(DIMS)]


def train(texts: list[np.ndarray], labels: np.ndarray, p: Network) -> Model:
    """A network from texts at hand, given as table rows of the words of each, by p.steps steps."""
    learner = Learner(p)
    learner.lesson(texts, labels, p.steps, 1, 0)
    return learner.done()


def calibrate(m: Model, z: np.ndarray, labels: np.ndarray, rows: np.ndarray, steps: int = 50) -> None:
    """Platt's logistic fit of the labels to the network's output, each standing for so many rows, by Newton steps; labels are drawn in a little, so that it stays finite."""
    n1, n0 = (rows * labels).sum(), (rows * (1 - labels)).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(z).max(initial=0)), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))], 1)
    b = np.zeros(2)
    for _ in range(steps):
        q = sigmoid(x @ b)
        b -= np.linalg.solve((x * (rows * q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (rows * (q - target)) + 1e-6 * b)
    m.slope, m.shift = float(b[0] / scale), float(b[1])


def _cut(scores: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> float:
    """Score from which on flagging has the best F1, between two scores."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum((rows * labels)[order])
    f1 = 2 * hits / (np.cumsum(rows[order]) + max((rows * labels).sum(), 1))
    ends = np.append(np.diff(scores[order]) != 0, True)
    k = int(np.argmax(np.where(ends, f1, -1)))
    return float((scores[order[k]] + (scores[order[k + 1]] if k + 1 < len(order) else 0)) / 2)


def thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], rows: np.ndarray, prior: int = 10) -> dict:
    """The cut of each language, and under None that of all; a language's counts by its toxic rows against prior. Each score stands for so many rows."""
    out = {None: _cut(scores, labels, rows)}
    places: dict[str, list[int]] = {}
    for i, x in enumerate(langs):
        if x is not None:
            places.setdefault(x, []).append(i)
    for lang, own in sorted(places.items()):
        n = int((rows * labels)[own].sum())
        if 0 < n < rows[own].sum():
            out[lang] = (n * _cut(scores[own], labels[own], rows[own]) + prior * out[None]) / (n + prior)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Network = Network()) -> Model:
    """A network from all labelled rows of docs that aren't held out."""
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("__tw_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = materialise(marks.where(~held_out("__tw_doc")).withColumn("draw", F.xxhash64("__tw_doc", F.lit(p.seed))).withColumn("check", F.pmod("draw", F.lit(4)) == 0))
    many = marks.count()
    shards = min(p.shards, max(1, -(-3 * many // (4 * p.shard_rows))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).where(~held_out())
    rows = rows.join(F.broadcast(marks) if many <= 500_000 else marks, F.col("doc_id") == F.col("__tw_doc"))
    rows = rows.select("doc_id", "text", "lang", "toxic", "check", "draw", F.pmod(F.floor(F.col("draw") / 4), F.lit(shards)).cast("int").alias("shard"))
    # more partitions than shards, so that few shards share one
    rows = materialise(rows.repartition(8 * shards if shards > 1 else 1, "shard").sortWithinPartitions("shard", "check", "draw", "doc_id", F.xxhash64("text")))
    n = {(r["check"], r["toxic"]): r["count"] for r in rows.groupBy("check", F.col("toxic").cast("double").alias("toxic")).count().collect()}
    count = lambda toxic, *check: sum(k for (c, t), k in n.items() if c in check and t == toxic)
    ones, zeros = count(1, False), count(0, False)
    if not ones or not zeros:
        return Model([], [], np.zeros(0), np.zeros(0), 0.0, constant=count(1, False, True) / max(sum(n.values()), 1))
    m = _trained(rows.where("not check"), shards, max(ones, zeros), p)
    whole = not (count(1, True) and count(0, True))  # rows to calibrate on lack a label: all rows are taken
    found = _outputs(rows if whole else rows.where("check"), m)
    z, y, k = (found[c].to_numpy().astype(np.float64) for c in ("z", "toxic", "n"))
    calibrate(m, z / _Z, y, k)
    m.cuts = thresholds(sigmoid(m.slope * z / _Z + m.shift), y, found["lang"].to_pylist(), k)
    return m


def _trained(rows: DataFrame, shards: int, larger: int, p: Network) -> Model:
    """A network from rows (text, toxic, shard), sorted within shards. larger: rows of the commoner label."""
    spark, learner = rows.sparkSession, Learner(p)
    rounds = p.rounds if shards > 1 else 1
    repeat = max(1, round(p.steps * (p.batch // 2) * shards / (rounds * larger)))  # so often each row is seen in a round
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(learner)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            start = shared.value
            own, shard, texts, toxic, size, lots = None, None, [], [], 0, 0
            for batch in batches:
                of = batch["shard"].to_numpy()
                y = batch["toxic"].to_numpy()
                for i, b in blocks(plain(batch["text"]), lower=True):
                    w, cut = word_rows(b), b.doc_first
                    for d in range(b.docs):
                        if size >= p.lot_words or (own is not None and of[i + d] != shard):
                            own.lesson(texts, np.array(toxic, np.float64), None, repeat, turn << 20 | lots)
                            texts, toxic, size, lots = [], [], 0, lots + 1
                        if own is None or of[i + d] != shard:
                            if own is not None:
                                yield own.changes(start)
                            own, shard, lots = start.copy(), of[i + d], 0
                        texts.append(w[cut[d] : cut[d + 1]].copy())
                        toxic.append(y[i + d])
                        size += int(cut[d + 1] - cut[d])
            if own is not None:
                own.lesson(texts, np.array(toxic, np.float64), None, repeat, turn << 20 | lots)
                yield own.changes(start)
            give_back()

        with small_batches(spark):
            changed = rows.select("text", F.col("toxic").cast("double").alias("toxic"), "shard").mapInArrow(run, "unit long, " + "".join(f"{d} long, " for d in _DELTAS) + "seen double")
            learner.average(changed.groupBy("unit").agg(*[F.sum(d).alias(d) for d in _DELTAS], F.count("*").alias("n"), F.max("seen").alias("seen")).toArrow())
        shared.unpersist()
    return learner.done()


#: Outputs of the network are counted by 1/_Z, up to _MOST.
_Z, _MOST = 1024, 64


def _outputs(rows: DataFrame, m: Model) -> pa.Table:
    """lang, toxic, z (whole number of 1/_Z), n: rows with that output of the network, in order."""
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, b in blocks(plain(batch["text"]), lower=True):
                z = np.rint(np.clip(shared.value.raw(word_rows(b), b.doc_first).astype(np.float64), -_MOST, _MOST) * _Z).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch["lang"][i : i + b.docs], batch["toxic"][i : i + b.docs], pa.array(z)], ["lang", "toxic", "z"])
        give_back()

    with small_batches(rows.sparkSession):
        z = rows.select("text", "lang", "toxic").mapInArrow(run, "lang string, toxic int, z long")
        return z.groupBy("lang", "toxic", "z").agg(F.count("*").alias("n")).toArrow().sort_by([("z", "ascending"), ("toxic", "ascending"), ("lang", "ascending")])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, score of every row of docs (doc_id, text, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, b in blocks(plain(batch["text"]), lower=True):
                some = slice(i, i + b.docs)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][some], batch["lang"][some], pa.array(m.scores(word_rows(b), b.doc_first))], ["doc_id", "lang", "score"])
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, "doc_id long, lang string, score double")


def toxicity(docs: DataFrame, labels: DataFrame, p: Network = Network()) -> DataFrame:
    """doc_id, held_out, score, predicted, lang, threshold and flagged of every row of docs, by a network fitted to the labels (doc_id, toxic)."""
    model = fit(docs, labels, p)
    cuts = [x for k, v in model.cuts.items() if k is not None for x in (F.lit(k), F.lit(v))]
    own = F.create_map(*cuts)[F.col("lang")] if cuts else F.lit(None).cast("double")
    out = score(docs, model).withColumn("threshold", F.coalesce(own, F.lit(model.cuts.get(None)).cast("double")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= p.threshold).cast("int").alias("predicted"), "lang", "threshold", F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).alias("flagged"))
