"""N-gram Jaccard self-join: links between texts that share 80 % of their shingles.

A text is the set of its distinct five-word shingles, A-Z lowered (with fewer
words its whole sequence; without words or text the empty set, linked with
nothing). Texts link when 100 * intersection >= percent * union.

If two sets link, then under any one order of all shingles the first
n - ceil(percent * n / 100) + 1 of each share one: the prefix filter. Candidates
must pass it under three global orders at once:

1. Equal sets are one class from the start, whatever their number.
2. Each order has shingles of one text first, then those of two or three, of four to
   seven and so on, and each has a hash of its own inside these levels. Shingles are
   counted over all texts by four bytes of their hash within a hash range, and what is
   shared comes back to the texts; a rare confusion only changes the orders or adds a
   candidate. A shingle of one text is in no other prefix and isn't sent any further.
3. Classes with the same prefix shingle of the same order are a group. A group of at
   most GROUP classes gives its pairs, each pair (but for a few) in
   the group of its first common prefix shingle only: a row knows the PREVIOUS
   shingles before it, and pairs that share one of these were there already. A row also knows
   how many shingles come from this one on, which bounds what a pair can share: pairs that can't
   share enough any more aren't given. Pairs
   that all three orders give go on. Larger groups give no pairs: of the classes
   that could link with another one of the group, by sizes and these bounds, runs of overlapping sizes
   are tied together. So texts of one template, whose own parts keep them apart, aren't compared at all.
4. Pairs and ties make up connected groups of classes, nearly those of the links
   themselves. They are verified in tiles: whole groups where they are small; large
   ones split by set size, where only neighbouring sizes can link, and by salt, each
   pair of blocks in a tile of its own. No pair of blocks is left out, and no tile
   holds more than two blocks. Inside a tile the three filters are met once more,
   with the counts of the tile; what is left is verified by counting shared shingles.
   A tile returns links counted per class and a spanning forest.
5. Connected components of the forest give each text its component.

Skew: a shingle that very many texts hold (found on a sample, see ranges.py) counts as one of the
highest level without being counted, and is dealt out by a salt. Its group meets through nodes, one for
each size of sets (within BAND of each other): a class is tied to the nodes of the sizes that it could link with, and firmly to that of
its own size if it could link with one as large. Ties to nodes that no class holds firmly go. Nothing is sampled, capped or dropped. What is
broadcast is the list of such shingles, of bounded size, and the ids of copies to leave out and of classes to compare where they are at most ``broadcast_rows`` (they are
joined by a shuffle beyond). Classes are told apart by 64 bits and set size.

Repeated rows of one doc_id are one document. Null doc_ids are left out. An empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ranges import blobs, gathered_values, hot_values, per_key, per_range, range_count, range_of
from .store import left_out, materialise, scratch, stored, written
from .words import Block, blocks, mix

SALT_ROWS = 50_000
#: Bits of a tie through a node of a frequent shingle, and of a firm one; sizes within this factor share a node.
NODE, FIRM, BAND = 16, 8, 1.05
ORDERS, GROUP, PREVIOUS, LEVELS = 3, 64, 3, 40
WHOLE_ROWS, MOST_BLOCKS = 64, 16
BLOCK_ROWS, BLOCK_SHINGLES = 1_500, 500_000


def _least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def _could_link(group: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which members of groups have another one in theirs that could link with them: neither's size is beyond the other's most. Rows are sorted by group and size."""
    if not len(group):
        return np.zeros(0, bool)
    base = group.astype(np.int64) << 32
    reach = base + np.maximum(most, 0)
    upto = np.searchsorted(base + size, reach, "right")  # members of this and of groups before, up to the largest size that fits
    first = np.searchsorted(base, base)
    best = np.maximum.accumulate(reach)  # groups grow, so it starts anew with each
    passed = np.minimum(reach[1:], best[:-1])
    second = np.maximum.accumulate(np.concatenate([[-1], np.where(group[1:] == group[:-1], passed, -1)]))
    last = np.maximum(upto - 1, 0)
    own = np.where((size <= most) & (reach == best[last]), second[last], best[last])
    return (upto > first) & (own >= base + size)


def _runs(group: np.ndarray, size: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Number of the run of each member, where a run ends before a size that nothing before it reaches. Sorted as for _could_link."""
    if not len(group):
        return np.zeros(0, np.int64)
    base = group.astype(np.int64) << 32
    reach = np.maximum.accumulate(base + np.maximum(most, size))
    return np.cumsum(np.append(True, (base + size)[1:] > reach[:-1])) - 1


def _bands(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / np.log(BAND) + 1e-9).astype(np.int64)


def _node_ties(v: np.ndarray, k: np.ndarray, size: np.ndarray, most: np.ndarray, salt: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ties (class, node, bits) of the classes that share a frequent shingle: to the bands of all sizes that each could link with."""
    out, low, own = [], _bands(_least_shared(size, percent)), _bands(size)
    high = _bands(most)
    for step in range(int((high - low).max(initial=-1)) + 1):
        band = low + step
        some = band <= high
        node = mix(v[some] + mix(band[some].astype(np.uint64), 33), salt)
        out.append((k[some], node, np.where((most >= size) & (band == own), NODE | FIRM, NODE)[some]))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


class Sets:
    """Shingle sets of a block: doc and shingle (sorted by both), size and class of each text."""

    def __init__(self, b: Block):
        self.doc, self.shingle = b.shingles()
        self.size = np.bincount(self.doc, minlength=b.docs)
        self.first = np.cumsum(self.size) - self.size
        total = np.zeros(len(self.shingle) + 1, np.uint64)
        np.cumsum(mix(self.shingle, 31), out=total[1:])
        self.klass = mix(total[self.first + self.size] - total[self.first] + self.size.astype(np.uint64), 32)


def _sets(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, int, Sets]]:
    for batch in batches:
        for at, b in blocks(batch.column(column), lower=True):
            yield batch, at, Sets(b)


def _shingles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, _, s in _sets([batch]):
        yield s.shingle


FOUND = "flush long, range int, low binary, doc binary, level binary, klass binary, size binary, hot binary, hot_doc binary"


def _shared_shingles(texts: DataFrame, n: int, hot: Broadcast) -> DataFrame:
    """For each gathered lot of texts its shingles that other texts hold too, by range, with how many doublings of texts hold them.

    Four bytes of each shingle and two for the number of its text in the lot are sent to count; only what is
    shared comes back. The lot's name follows from its texts, so a rerun task gives the same.
    """

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        held, shingles, docs = [], 0, 0
        for _, _, s in _sets(batches):
            if held and (shingles + len(s.shingle) > gathered_values(n) or docs + len(s.size) > 1 << 16):
                yield held
                held, shingles, docs = [], 0, 0
            held.append(s)
            shingles, docs = shingles + len(s.shingle), docs + len(s.size)
        if held:
            yield held

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in lots(batches):
            before = np.cumsum([0, *[len(s.size) for s in held]])
            doc = np.concatenate([s.doc + k for s, k in zip(held, before[:-1], strict=True)]).astype(np.uint16)
            v, klass, size = (np.concatenate([getattr(s, x) for s in held]) for x in ("shingle", "klass", "size"))
            flush = int(mix(klass + np.arange(len(klass), dtype=np.uint64), 36).sum().view(np.int64)) if len(klass) else 0
            is_hot = hot.value.count(v) > 0
            sent = blobs(range_of(v[~is_hot], n), v[~is_hot].astype(np.uint32), doc[~is_hot])
            k, none = sent.num_rows, b""
            yield pa.RecordBatch.from_arrays([sent.column(0), pa.array([flush] * k, pa.int64()), sent.column(1), sent.column(2), *[pa.array([none] * k, pa.binary())] * 4], _SENT)
            own = [[flush % n], [flush], [none], [none], [klass.tobytes()], [size.astype(np.int64).tobytes()], [v[is_hot].tobytes()], [doc[is_hot].tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int32()), pa.array(own[1], pa.int64()), *[pa.array(x, pa.binary()) for x in own[2:]]], _SENT)

    def count(r: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        low = np.frombuffer(b"".join(x[1] for x in rows), np.uint32)
        _, at, texts_ = np.unique(low, return_inverse=True, return_counts=True)
        level = np.minimum(np.log2(texts_).astype(np.uint8), LEVELS)[at] if len(low) else np.zeros(0, np.uint8)
        begin, out = 0, []
        for flush, lows, docs, *own in rows:
            part = level[begin : begin + len(lows) // 4]
            begin += len(part)
            keep = part > 0
            out.append((flush, r, np.frombuffer(lows, np.uint32)[keep].tobytes(), np.frombuffer(docs, np.uint16)[keep].tobytes(), part[keep].tobytes(), *own))
        for k in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 256], strict=True), [pa.int64(), pa.int32(), *[pa.binary()] * 7], strict=True)], [x.split()[0] for x in FOUND.split(", ")])

    rows = texts.mapInArrow(emit, "range int, flush long, low binary, doc binary, klass binary, size binary, hot binary, hot_doc binary")
    return per_key(rows, n, count, FOUND)


_SENT = ["range", "flush", "low", "doc", "klass", "size", "hot", "hot_doc"]


def _prefix_edges(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b, orders) between classes: pairs of groups, with a bit for their order, and ties of large groups (no bit)."""
    hot = hot_values(texts, _shingles, n)

    def emit(_: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Prefixes of the texts of a lot under all orders. A shingle goes by its range and four bytes."""
        r, low, docs, levels, klass, size, hots, hot_docs = zip(*rows, strict=True)
        join = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
        low, klass, size, hots = join(low, np.uint32), join(klass, np.uint64), join(size, np.int64), join(hots, np.uint64)
        token = (np.repeat(np.array(r, np.uint64), [len(x) // 2 for x in docs]) << np.uint64(32)) | low
        own = (range_of(hots, n).astype(np.uint64) << np.uint64(32)) | (hots & np.uint64(0xFFFFFFFF))
        v = np.concatenate([token, own])
        doc = np.concatenate([join(docs, np.uint16), join(hot_docs, np.uint16)]).astype(np.int64)
        level = np.concatenate([join(levels, np.uint8), np.full(len(own), LEVELS, np.uint8)])
        often = np.concatenate([np.zeros(len(token), np.int64), hot.value.count(hots)])
        # shingles of one text come first, so the others only need to be put in order
        shared = np.bincount(doc, minlength=len(size))
        room = shared - _least_shared(size, percent)
        keep = room[doc] >= 0
        v, doc, level, often = v[keep], doc[keep], level[keep], often[keep]
        if not len(v):
            return
        for o in range(ORDERS):
            order = np.lexsort((mix(v, 70 + o), level, doc))
            d = doc[order]
            rank = np.arange(len(d)) - np.searchsorted(d, d)
            inside = rank <= room[d]
            d, w, many, rest = d[inside], v[order[inside]], often[order[inside]], (shared[d] - rank)[inside]
            before = np.zeros((PREVIOUS, len(w)), np.uint64)
            for j in range(1, PREVIOUS + 1):
                before[j - 1, j:] = np.where(d[j:] == d[:-j], w[:-j] + np.uint64(1), 0)  # 0: none
            k, salts = klass[d], (1 + many // SALT_ROWS).astype(np.uint64)
            # below zero: dealt out by a salt
            yield blobs(range_of(mix(w + mix(k, 33) % salts, 34), n) * ORDERS + o, w, k, np.where(many >= SALT_ROWS, -size[d], size[d]), rest, *before)

    def work(r: int, v: np.ndarray, k: np.ndarray, size: np.ndarray, rest: np.ndarray, *before: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((-rest, k, v))
        order = order[np.append(True, (v[order][1:] != v[order][:-1]) | (k[order][1:] != k[order][:-1]))]
        v, k, size, rest, before = v[order], k[order], size[order], rest[order], [x[order] for x in before]
        head = np.append(True, v[1:] != v[:-1])
        group = np.cumsum(head) - 1
        salted = size < 0
        # the largest size with which what is left of a class can link: all that two sets share comes from their first common shingle on
        most = (100 + percent) * rest // percent - np.abs(size)
        large = ~salted & (np.bincount(group)[group] > GROUP)
        at = np.flatnonzero(large)
        at = at[np.lexsort((size[at], group[at]))]
        at = at[_could_link(group[at], size[at], most[at])]
        run = _runs(group[at], size[at], most[at])
        lead = at[np.searchsorted(run, run)]
        ties = np.unique(np.stack([np.maximum(k[at], k[lead]), np.minimum(k[at], k[lead])]), axis=1)  # a > b, unlike pairs
        ties = ties[:, ties[0] != ties[1]]
        member, node, kind = _node_ties(v[salted], k[salted], -size[salted], most[salted], 35 + r % ORDERS, percent)
        few = ~salted & ~large
        k, size, most, group, before = k[few], size[few], most[few], group[few], [x[few] for x in before]
        pairs = [np.zeros((2, 0), np.uint64)]
        for step in range(1, GROUP):
            one = np.flatnonzero(group[step:] == group[: len(group) - step])
            if not len(one):
                break
            two = one + step
            fits = (size[two] <= most[one]) & (size[one] <= most[two])
            for x in before:
                for y in before:
                    fits &= (x[one] != y[two]) | (x[one] == 0)
            pairs.append(np.stack([k[one[fits]], k[two[fits]]]))
        found = np.unique(np.concatenate(pairs, axis=1), axis=1)  # k grows within a group, so a < b
        bits = np.concatenate([np.repeat(np.array([1 << r % ORDERS, 0], np.int32), [found.shape[1], ties.shape[1]]), kind.astype(np.int32)])
        a, b = np.concatenate([found, ties, np.stack([member, node])], axis=1).view(np.int64)
        for at in range(0, len(bits), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (a, b, bits)], ["a", "b", "orders"])

    columns = "range int, " + ", ".join(f"v{i} binary" for i in range(4 + PREVIOUS))
    return per_range(per_key(_shared_shingles(texts, n, hot), n, emit, columns), n, [np.uint64, np.uint64, np.int64, np.int64] + [np.uint64] * PREVIOUS, work, "a long, b long, orders int")


def candidates(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b, orders): pairs of classes that share a prefix shingle under every order, and ties. texts: doc_id, text, a text of each class."""
    edges = _prefix_edges(texts, n, percent).groupBy("a", "b").agg(F.bit_or("orders").alias("orders"))
    edges = materialise(edges.where(F.col("orders").isin(0, (1 << ORDERS) - 1) | (F.col("orders") >= NODE)))
    loose = edges.where(F.col("orders") >= NODE)
    held = loose.groupBy("b").agg(F.bit_or("orders").alias("bits"), F.count("*").alias("ties")).where((F.col("bits") == NODE | FIRM) & (F.col("ties") > 1))
    return edges.where(F.col("orders") < NODE).unionByName(loose.join(held.select("b"), "b", "left_semi").select("a", "b", "orders"))


def _signatures(texts: DataFrame) -> DataFrame:
    """doc_id, n, klass (null for the empty set)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, s in _sets(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(s.size)), pa.array(s.size), pa.array(s.klass.view(np.int64), mask=s.size == 0)], ["doc_id", "n", "klass"])

    return texts.mapInArrow(emit, "doc_id long, n long, klass long")


def _whole_sets(texts: DataFrame) -> DataFrame:
    """doc_id, klass and the shingles as bytes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, s in _sets(batches):
            parts = [s.shingle[a : a + z].tobytes() for a, z in zip(s.first.tolist(), s.size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(parts)), pa.array(s.klass.view(np.int64)), pa.array(parts, pa.binary())], ["doc_id", "klass", "shingles"])

    return texts.mapInArrow(emit, "doc_id long, klass long, shingles binary")


def _tiles(members: DataFrame) -> DataFrame:
    """members (comp, rep, klass, copies, n) with the tiles that each takes part in: tile (string) and its own block (int), and crossing: whether the tile is for two blocks, as its name says (salts that no row hashed to have tiles too)."""
    sized = members.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int"))
    parts = sized.groupBy("comp", "s").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    # more blocks than their size asks for, up to a number, so that a large group keeps many tasks busy
    spread = F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("rows") / WHOLE_ROWS))
    need = F.greatest(spread, F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    groups = parts.groupBy("comp").agg(F.sum("rows").alias("all_rows"), F.sum("shingles").alias("all_shingles"), F.map_from_entries(F.collect_list(F.struct("s", need.alias("k")))).alias("salts"))
    small = (F.col("all_rows") <= WHOLE_ROWS) & (F.col("all_shingles") <= BLOCK_SHINGLES)
    x = sized.join(groups, "comp").withColumn("block", F.when(small, F.lit(0)).otherwise(F.pmod(F.xxhash64("klass"), F.try_element_at("salts", F.col("s"))).cast("int")))
    same = "transform(sequence(0, try_element_at(salts, s) - 1), b -> concat_ws('.', comp, s, least(block, b), s, greatest(block, b)))"
    up = "transform(sequence(0, coalesce(try_element_at(salts, s + 1), 0)), b -> if(b = coalesce(try_element_at(salts, s + 1), 0), null, concat_ws('.', comp, s, block, s + 1, b)))"
    down = "transform(sequence(0, coalesce(try_element_at(salts, s - 1), 0)), b -> if(b = coalesce(try_element_at(salts, s - 1), 0), null, concat_ws('.', comp, s - 1, b, s, block)))"
    tiles = F.when(small, F.array(F.col("comp").cast("string"))).otherwise(F.expr(f"filter(concat({same}, {up}, {down}), t -> t is not null)"))
    own = F.when(small, F.lit(0)).otherwise(F.col("s") * 100_000 + F.col("block"))
    parts = F.split("tile", "[.]")
    crossing = (F.size(parts) == 5) & F.coalesce((F.try_element_at(parts, F.lit(2)) != F.try_element_at(parts, F.lit(4))) | (F.try_element_at(parts, F.lit(3)) != F.try_element_at(parts, F.lit(5))), F.lit(False))
    return x.select("rep", "klass", "copies", own.alias("block"), F.explode(tiles).alias("tile")).withColumn("crossing", crossing)


class Tile:
    """Classes to be compared with each other: prefix filters under three orders, then counting."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, np.array([len(s) for s in sets])
        self.owner = np.repeat(np.arange(len(sets), dtype=np.int32), self.size)
        flat = np.concatenate(sets)
        values, token = np.unique(flat, return_inverse=True)
        self.token = token.astype(np.int32)
        del token
        self.first = np.cumsum(self.size) - self.size
        df = np.bincount(self.token).astype(np.int32)
        self.mark = np.zeros(len(values), bool)
        self.orders = [self._order(np.lexsort((flat, df[self.token], self.owner))), self._order(np.lexsort((mix(flat, 41), self.owner))), self._order(np.lexsort((mix(flat, 42), self.owner)))]

    def _order(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Prefix shingles by text, and texts by prefix shingle."""
        rank = np.arange(len(order)) - self.first[self.owner]
        keep = order[rank <= (self.size - _least_shared(self.size, self.percent))[self.owner]]
        owner, token = self.owner[keep], self.token[keep]
        by_token = np.argsort(token, kind="stable")
        return token, np.searchsorted(owner, np.arange(len(self.size) + 1)), owner[by_token], np.searchsorted(token[by_token], np.arange(len(self.mark) + 1))

    def linked(self, i: int, wanted: np.ndarray) -> np.ndarray:
        """Those of the wanted texts (boolean) that link with text i."""
        n = self.size[i]
        wanted = wanted & (100 * np.minimum(n, self.size) >= self.percent * np.maximum(n, self.size))
        for token, by_text, holder, by_token in self.orders:
            if not wanted.any():
                return np.zeros(0, np.int64)
            own = token[by_text[i] : by_text[i + 1]]
            passed = np.zeros(len(self.size), bool)
            passed[np.concatenate([holder[by_token[t] : by_token[t + 1]] for t in own])] = True
            wanted = wanted & passed
        found = np.flatnonzero(wanted)
        if not len(found):
            return found
        mine = self.token[self.first[i] : self.first[i] + n]
        self.mark[mine] = True
        size = self.size[found]
        begin = np.cumsum(size) - size
        at = np.repeat(self.first[found] - begin, size) + np.arange(size.sum())
        shared = np.add.reduceat(self.mark[self.token[at]], begin, dtype=np.int64)
        self.mark[mine] = False
        return found[100 * shared >= self.percent * (n + size - shared)]


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Links within a tile: rows (a, b) of a spanning forest, and rows (a, null, links) with the texts that a's class links with. A crossing tile compares its two blocks; where no row hashed to one of them, there is nothing to compare."""
    crossing = table["crossing"][0].as_py()
    if crossing and len(pc.unique(table["block"])) < 2:
        return pa.table([pa.array([], pa.int64())] * 3, ["a", "b", "links"])
    rep, where = np.unique(table["rep"].to_numpy(), return_index=True)
    copies, block = table["copies"].to_numpy()[where], table["block"].to_numpy()[where]
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].take(pa.array(where)).to_pylist()]
    tile = Tile(sets, percent)
    links, root = np.zeros(len(rep), np.int64), list(range(len(rep)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    later = np.ones(len(rep), bool)
    for i in range(len(rep)):
        later[i] = False
        if crossing and block[i] != block.min():
            continue
        found = tile.linked(i, block != block[i] if crossing else later)
        links[i] += copies[found].sum()
        links[found] += copies[i]
        for j in found.tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((rep[i], rep[j]))
    has = np.flatnonzero(links)
    a = np.concatenate([np.array([e[0] for e in edges], np.int64), rep[has]])
    b = pa.array([*[int(e[1]) for e in edges], *[None] * len(has)], pa.int64())
    return pa.table([pa.array(a), b, pa.array(np.concatenate([np.zeros(len(edges), np.int64), links[has]]))], ["a", "b", "links"])


def ngram_jaccard_components(docs: DataFrame, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (documents that it links with)."""
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    n = range_count(docs)
    signed = materialise(_signatures(texts).groupBy("doc_id").agg(F.max(F.struct("n", "klass")).alias("x")).select("doc_id", "x.n", "x.klass"))
    classes = signed.where("klass is not null").groupBy("klass", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))

    # From here on a class is its first text.
    copied = classes.where("copies > 1").select(F.col("klass").alias("__klass"), F.col("rep"))
    others = signed.join(copied, F.col("klass") == F.col("__klass")).where("doc_id != rep").select("doc_id")
    few = others.count() <= broadcast_rows
    texts = texts.join(F.broadcast(others) if few else others, "doc_id", "left_anti")
    texts = texts if few else stored(texts, "classes")
    groups = connected_components(candidates(texts, n, percent).select("a", "b"))
    members = materialise(groups.withColumnsRenamed({"node": "klass", "component": "comp"}).join(classes, "klass").select("comp", "klass", "rep", "copies", "n"))
    wanted = members.select(F.col("rep").alias("doc_id"), "klass")
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted
    sets = _whole_sets(texts.join(wanted.select("doc_id"), "doc_id", "left_semi"))
    sets = sets.join(_tiles(members).withColumnsRenamed({"rep": "doc_id"}), ["doc_id", "klass"]).select(F.col("doc_id").alias("rep"), "copies", "block", "tile", "crossing", "shingles")

    def compare(table: pa.Table) -> pa.Table:
        return _compare(table, percent)

    found = materialise(sets.groupBy("tile").applyInArrow(compare, "a long, b long, links long"))
    components = connected_components(found.where("b is not null").select("a", "b"))
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    known = classes.join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(F.col("klass").alias("__klass"), F.col("n").alias("__n"), F.coalesce("component", "rep").alias("component"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = signed.join(known, (F.col("klass") == F.col("__klass")) & (F.col("n") == F.col("__n")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, percent: int = 80, broadcast_rows: int = 500_000) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all their columns; rows without doc_id stay, as no id tells them from each other."""
    with scratch(docs.sparkSession) as keep:
        losers, path = written(ngram_jaccard_components(docs, percent, broadcast_rows).where("doc_id != component_id").select("doc_id"), "losers")
        keep.append(path)
    return left_out(docs, losers, broadcast_rows)
