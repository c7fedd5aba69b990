"""Packing tokenised documents into sequences: cutting stock by column generation.

1. Each text is tokenised once, closed with an end token, and cut into pieces of
   at most ``capacity`` tokens (whole sequences first, one remainder).
2. Pieces are counted by length class, a class being ``unit`` tokens wide. The
   histogram (at most capacity / unit cells, whatever the corpus) goes to the
   driver. A pattern says how many pieces of each class share a sequence. The
   linear program over patterns, least sequences that cover the histogram, starts
   with one-class patterns; a knapsack dynamic programme over the dual prices
   finds the next pattern until none lowers the count by ``gap`` in all.
3. Pattern counts are rounded down; what is left over (less than one sequence
   per pattern) is packed largest first.
4. Pieces get a rank within their class: counted by (class, hash bucket), then
   numbered inside a bucket, so no class is gathered in one task. A pattern owns a
   range of ranks of each of its classes; the rank says which sequence and slot.
   Offsets are running sums within a sequence, which holds a bounded number.

Lengths are rounded up to the class for planning only, so at most unit - 1 tokens
per piece are lost besides unused room. A sequence is padded to its capacity
unless its length is a power of two. Null and empty texts have the end token
alone. Each token is in exactly one piece. Repeated rows are packed once each.
An empty table gives no rows. Extra columns are ignored.

Tokenising: white space never joins tokens for the word vocabulary used here, so
a task tokenises each distinct word once (told apart by a 64-bit hash) and looks
the others up. For vocabularies where that doesn't hold set ``by_word`` to False; each
task tries it out on sample texts and refuses a tokenizer that doesn't work by words.

Pieces are ranked by doc_id, start, length and checksum, so a rerun task gives the same
places; rows equal in all of these are the same piece twice, and may swap.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .words import Block, blocks, text_buffers

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class Packing:
    """Parameters: path of the tokenizer file, id that closes a document, tokens of a sequence, width of a length class."""

    tokenizer: str
    end_id: int = 2
    capacity: int = 4096
    unit: int = 8
    gap: float = 0.001
    max_columns: int = 3000
    by_word: bool = True
    pad_id: int = 0


class WordTokens:
    """Token ids of words by their hash. Of further words than most, those of a block at hand are known for that block only, which bounds the memory."""

    SEPARATOR = "<|endoftext|>"
    #: Texts on which working by words must give the same ids.
    TRIALS = ("Two  plain words, it's 1,234.50 \n\n a\tb\x0bc \r\n x ", " leading and trailing ", "\u00e9t\u00e9 \u6f22\u5b57 \u6f22 \U0001f600 ab\xa0cd #*$%&|<> --- (a) [b] c_d", "the the The THE unbelievably antidisestablishmentarianism 007")

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        for text in self.TRIALS:
            if self.encode(text) != [i for w in re.findall(r"[^\x20\x09-\x0D]+", text) for i in self.encode(w)]:
                raise ValueError("this tokenizer doesn't work word by word: set by_word to False")
        # hashes of the known words in order, and which of first each has
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        plain = [i for i, w in enumerate(words) if self.separator is not None and self.SEPARATOR not in w]
        ids, lengths = [], []
        for k in range(0, len(plain), 4096):
            found = np.array(self.encode(self.SEPARATOR.join([words[i] for i in plain[k : k + 4096]])), np.uint32)
            between = found == self.separator
            lengths.append(np.diff(np.flatnonzero(between), prepend=-1, append=len(found)) - 1)
            ids.append(found[~between])
        others = sorted(set(range(len(words))) - set(plain))
        for i in others:
            ids.append(np.array(self.encode(words[i]), np.uint32))
            lengths.append([len(ids[-1])])
        slots = np.empty(len(words), np.int32)
        slots[plain + others] = np.arange(len(words)) + len(self.first) - 1
        where = np.searchsorted(self.known, hashes)
        self.known, self.slot = np.insert(self.known, where, hashes), np.insert(self.slot, where, slots)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(lengths))])
        self.ids = np.concatenate([self.ids, *ids])

    def tokens(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a block, and where each word's begin (one more at the end)."""
        before = self.known, self.slot, self.first, self.ids
        values, where, back = np.unique(b.hash, return_index=True, return_inverse=True)
        new = ~np.isin(values, self.known, assume_unique=True)
        if new.any():
            at = where[new]
            self._learn(values[new], [b.text(x, y) for x, y in zip(b.first[at], b.last[at], strict=True)])
        slot = self.slot[np.searchsorted(self.known, values)][back]
        first, n = self.first[slot], self.first[slot + 1] - self.first[slot]
        begin = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=begin[1:])
        ids = self.ids[np.repeat(first - begin[:-1], n) + np.arange(begin[-1])]
        if len(self.known) > self.most:
            self.known, self.slot, self.first, self.ids = before
        return ids, begin


@lru_cache(maxsize=1)
def _word_tokens(path: str) -> WordTokens:
    """One for all tasks of a Python worker."""
    return WordTokens(path)


def _documents(column: pa.Array, tokens: WordTokens, by_word: bool) -> Iterator[np.ndarray]:
    """Ids of each text."""
    if by_word:
        for _, b in blocks(column):
            ids, begin = tokens.tokens(b)
            for d in range(b.docs):
                yield ids[begin[b.doc_first[d]] : begin[b.doc_first[d + 1]]]
    else:
        data, offs = text_buffers(column)
        for i in range(len(offs) - 1):
            yield np.array(tokens.encode(data[offs[i] : offs[i + 1]].tobytes().decode()), np.uint32)


def pieces(docs: DataFrame, p: Packing, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece; with_ids adds the ids (array<int>)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(p.tokenizer)
        end = np.array([p.end_id], np.uint32)
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), _documents(batch.column(1), tokens, p.by_word), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                for start in range(0, len(ids), p.capacity):
                    part = ids[start : start + p.capacity]
                    rows.append((doc_id, start, len(part), zlib.crc32(part), len(ids), *[part.astype(np.int32)] * with_ids))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
            for k in range(0, len(rows), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 5000], strict=True), kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def _priced(prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest worth that fits: an unbounded knapsack. prices: of classes 1, 2, ..., room."""
    worth, pick = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for w in range(1, room + 1):
        options = worth[w - 1 :: -1] + prices[:w]  # class i leaves room w - i
        i = int(options.argmax())
        if options[i] > worth[w - 1]:
            worth[w], pick[w] = options[i], i + 1
        else:
            worth[w] = worth[w - 1]
    pattern, w = np.zeros(len(prices), np.int64), room
    while w:
        if pick[w]:
            pattern[pick[w] - 1] += 1
        w -= max(1, int(pick[w]))
    return float(worth[room]), pattern


def column_generation(demand: np.ndarray, gap: float = 0.001, max_columns: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often the linear program uses each. demand: pieces of classes 1, 2, ..., room."""
    room = len(demand)
    used = np.flatnonzero(demand)
    if not len(used):
        return []
    need = demand[used].astype(float)
    fits = room // (used + 1)
    basis = [np.where(np.arange(room) == i, n, 0) for i, n in zip(used, fits, strict=True)]
    inverse, amount = np.diag(1.0 / fits), need / fits
    for _ in range(max_columns):
        dual = inverse.sum(axis=0)
        prices = np.zeros(room)
        prices[used] = np.maximum(dual, 0)
        worth, pattern = _priced(prices, room)
        if worth <= 1 + gap:  # no pattern can lower the count by more than that share
            break
        step = inverse @ pattern[used]
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, amount / np.where(up, step, 1), np.inf)
        out = int(ratio.argmin())
        amount -= step * ratio[out]
        amount[out] = ratio[out]
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[out] = pattern
        np.maximum(amount, 0, out=amount)
    return [(b, float(x)) for b, x in zip(basis, amount, strict=True)]


def plan(demand: np.ndarray, gap: float = 0.001, max_columns: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that together hold the demand exactly."""
    left = demand.astype(np.int64).copy()
    out: list[tuple[np.ndarray, int]] = []
    for pattern, x in column_generation(demand, gap, max_columns):
        has = pattern > 0
        n = min(int(x + 1e-6), int((left[has] // pattern[has]).min())) if has.any() else 0
        if n > 0:
            out.append((pattern, n))
            left -= n * pattern
    bins: dict[tuple[int, ...], int] = {}
    while left.any():
        # fill a sequence with the largest that fit, and repeat it as long as they last
        pattern, room = np.zeros_like(left), len(left)
        while room > 0 and (fit := np.flatnonzero((left - pattern)[:room])).size:
            i = int(fit[-1])
            n = min(room // (i + 1), int(left[i] - pattern[i]))
            pattern[i] += n
            room -= n * (i + 1)
        has = pattern > 0
        n = int((left[has] // pattern[has]).min())
        bins[tuple(pattern.tolist())] = bins.get(tuple(pattern.tolist()), 0) + n
        left -= n * pattern
    return out + [(np.array(k), n) for k, n in bins.items()]


def _slots(patterns: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, ...]:
    """Ranges of ranks: class, first rank, number of the first sequence, sequences."""
    rows, taken, sequence = [], {}, 0
    for pattern, n in patterns:
        for i in np.flatnonzero(pattern).tolist():
            rows.append((i + 1, taken.get(i, 0), sequence, n))
            taken[i] = taken.get(i, 0) + int(pattern[i]) * n
        sequence += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4


def assign(pieces_: DataFrame, p: Packing) -> DataFrame:
    """pieces_ (doc_id, start, length and more; cheap to read again) with sequence_id and offset."""
    spark = pieces_.sparkSession
    own = pieces_.columns
    buckets = max(16, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pieces_.withColumns({"__class": F.expr(f"cast((length + {p.unit - 1}) div {p.unit} as int)"), "__bucket": F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int")})
    counts = materialise(rows.groupBy("__class", "__bucket").agg(F.count("*").alias("n")))
    demand = np.zeros(p.capacity // p.unit, np.int64)
    for c in counts.groupBy("__class").agg(F.sum("n").alias("n")).collect():
        demand[c[0] - 1] = c.n
    klass, first, sequence, copies = _slots(plan(demand, p.gap, p.max_columns))

    by_class = Window.partitionBy("__class").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__class", "__bucket", F.coalesce(F.sum("n").over(by_class), F.lit(0)).alias("__before"))
    local = F.row_number().over(Window.partitionBy("__class", "__bucket").orderBy("doc_id", "start", "length", "ids_crc32")) - 1
    ranked = rows.withColumn("__local", local).join(before, ["__class", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__local"))

    def place(c: pa.Array, r: pa.Array) -> pa.Array:
        c, r = c.to_numpy(zero_copy_only=False).astype(np.int64), r.to_numpy(zero_copy_only=False).astype(np.int64)
        span = np.int64(1) << 44
        at = np.searchsorted(klass * span + first, c * span + r, "right") - 1
        t = r - first[at]
        return pa.StructArray.from_arrays([pa.array(sequence[at] + t % copies[at]), pa.array(t // copies[at])], ["sequence_id", "slot"])

    placed = ranked.withColumn("__at", F.arrow_udf(place, "struct<sequence_id:bigint,slot:bigint>")(F.col("__class"), F.col("__rank")))
    order = Window.partitionBy("__at.sequence_id").orderBy(F.desc("__class"), "__at.slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*own, F.col("__at.sequence_id").alias("sequence_id"), F.coalesce(F.sum("length").over(order), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, p: Packing, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids the ids."""
    return assign(materialise(pieces(docs, p, with_ids)), p)


def sequences(packed: DataFrame, p: Packing) -> DataFrame:
    """sequence_id, ids (padded) of each sequence. packed: from pack() with ids."""
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")).withColumn("ids", F.flatten("parts.ids"))
    room = F.when(F.expr("bit_count(size(ids)) = 1"), 0).otherwise(p.capacity - F.size("ids"))
    return joined.select("sequence_id", F.concat("ids", F.array_repeat(F.lit(p.pad_id), room)).alias("ids"))
