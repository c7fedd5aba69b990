"""Repair of the structure of conversations, by signatures that are solved once each.

A row of a conversation matters to its repair only by its role and its first fault, so
a conversation is written as a string with a letter a row: its signature. Most
conversations share few of them. Each distinct one is solved once, by a memoised recursion over what
is left of it and the role written before; the audits (strings of edits) are joined back, and
the edits are replayed on the rows.

A long conversation is a run of signatures of at most ``PIECE`` rows, each solved for every role
before and after it, and a cheapest way through the pieces is chosen then. So its rows are dealt
to many tasks by ranges of (conversation, turn), whatever share of all rows it has. Only
what is one value by contract comes together: the pieces of a conversation, and, as its
digest is one running hash, its rows, which pass one after another without being held.

Moves: a row of some 60 bytes for each row, to sort and to tell repeated ones (pre-aggregated:
a text that is everywhere in a conversation is one row for each turn); each text once, at the end.

Order and ties: rows are taken by turn (nulls first), ties by role, then by the SHA-256 of the text.
Nulls count as one space in conv_id and turn of the checksum, in role and in text. The null conv_id is
a conversation as well. Roles are known by their first character; a role without one, or with another
than s, u or a, can't be kept. Empty table: no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .words import give_back

#: Rows of a signature.
PIECE = 32
#: What has been written when a row comes: nothing, a system turn, a user's or an assistant's. A repaired conversation ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
#: Costs of edits, and of keeping a truncated text.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Where a kept, reroled or inserted turn leads from each of them, by its role's initial.
NEXT = {START: "su", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
FULL = {USER: "user", ASSISTANT: "assistant"}
_SPACE = r"[\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of conv_id:turn decides; nulls of role and text are one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    harm = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), harm.alias("harm")).where("harm != 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("harm") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "__copy")


def _arrow(kind: str) -> pa.DataType:
    return {"int": pa.int32(), "string": pa.string()}.get(kind, pa.int64())


def _order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]


def _digested(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _light(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, blank, ended, and earlier: the same role and text come at a smaller turn (copies within a turn are neighbours)."""
    last = rf"[.!?]{_SPACE}*\z"
    light = _digested(rows).select("conv_id", "turn", "role", "digest", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.col("text").rlike(last).alias("ended"))
    light = materialise(light)
    # a null turn is before all others, so it comes first as a struct whose flag is false
    at = F.struct(F.col("turn").isNotNull().alias("set"), F.col("turn").alias("turn"))
    same = ["conv_id", "role", "digest"]
    again = light.where("not blank").groupBy(*same).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"__{c}") for c in same], "first")
    match = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("role") == F.col("__role")) & (F.col("digest") == F.col("__digest"))
    earlier = F.coalesce(F.col("first") < at, F.lit(False))
    return light.join(again, match, "left").select(*light.columns, earlier.alias("earlier"))


def _pieces(light: DataFrame, parts: int) -> DataFrame:
    """A row for each run of up to PIECE rows of a conversation: its place, signature and counts."""
    schema = f"conv_id {dict(light.dtypes)['conv_id']}, part int, piece long, signature string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"
    names = [c.split()[0] for c in schema.split(", ")]
    batch_schema = pa.schema([(n, _arrow(k)) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, out = TaskContext.get().partitionId(), 0, []
        now, before = None, None

        def flush() -> None:
            nonlocal number
            if now:
                number += 1
                out.append((now["conv"], part, number, "".join(now["sig"]), *now["faults"], now["illegal"], now["first"], now["last"], now["low"], now["high"], now["turns"]))

        for batch in batches:
            for conv, turn, role, digest, blank, ended, earlier in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "digest", "blank", "ended", "earlier")), strict=True):
                row = (conv, turn, role, digest)
                if now is None or now["conv"] != conv or len(now["sig"]) == PIECE:
                    flush()
                    now = {"conv": conv, "sig": [], "faults": [0, 0, 0], "illegal": 0, "first": role[:1], "last": None, "low": None, "high": None, "turns": 0}
                fault = 0 if blank else 1 if earlier or row == before else None if ended else 2
                if fault is not None:
                    now["faults"][fault] += 1
                initial = role[:1]
                letter = initial if initial and initial in "sua" else "x"
                now["sig"].append("d" if fault in (0, 1) else letter.upper() if fault == 2 else letter)
                if now["last"] is not None and now["last"] + initial not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["last"] = initial
                if turn is not None:
                    if turn != now["high"]:
                        now["turns"] += 1
                    now["low"], now["high"] = turn if now["low"] is None else now["low"], turn
                before = row
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], batch_schema)
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], batch_schema)
        give_back()

    return light.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).mapInArrow(run, schema)


@lru_cache(maxsize=1 << 16)
def _best(left: str, state: int, end: int, inserts: int = 2) -> tuple[int, str] | None:
    """Least (cost, audit) that writes what is left and gets from one state to another; None if none does. No two inserts more than two in a row can help."""
    found = [] if left or state != end else [(0, "")]

    def then(cost: int, edit: str, rest: str, to: int, more: int) -> None:
        tail = _best(rest, to, end, more)
        if tail:
            found.append((cost + tail[0], edit + tail[1]))

    due = NEXT[state][-1]
    if left:
        letter, rest = left[0], left[1:]
        then(DELETE, "D", rest, state, 2)
        if letter != "d":
            kept = TRUNCATED if letter.isupper() else 0
            if letter.lower() in NEXT[state]:
                then(kept, "K", rest, STATE[letter.lower()], 2)
            if letter.lower() != due:
                then(REROLE + kept, "R", rest, STATE[due], 2)
    if inserts:
        then(INSERT, "I", left, STATE[due], inserts - 1)
    return min(found, default=None)


def solve(signature: str) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a signature, for every pair of states that edits can join."""
    found = ((a, z, _best(signature, a, z)) for a in range(4) for z in range(4))
    return [(a, z, *best) for a, z, best in found if best]


def _solved(pieces: DataFrame) -> DataFrame:
    """signature, ways: each distinct one once."""
    kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ways = [[dict(zip(("before", "after", "cost", "audit"), w, strict=True)) for w in solve(s)] for s in batch["signature"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["signature"], pa.array(ways, kind)], ["signature", "ways"])

    return pieces.select("signature").distinct().mapInArrow(run, "signature string, ways array<struct<before int, after int, cost long, audit string>>")


class Way:
    """Cheapest ways from START to each state over the pieces that have come, in order.

    Ways of equal cost to one state are never one the start of another, so the least of them stays the least
    whatever follows. What all ways have in common is put aside, which keeps those that are compared short.
    """

    def __init__(self) -> None:
        self.common: list[str] = []
        self.best: dict[int, tuple[int, str]] = {START: (0, "")}

    def add(self, ways: list[tuple[int, int, int, str]]) -> None:
        after: dict[int, tuple[int, str]] = {}
        for a, z, cost, audit in ways:
            if a in self.best:
                way = (self.best[a][0] + cost, self.best[a][1] + audit)
                if z not in after or way < after[z]:
                    after[z] = way
        shared = len(os.path.commonprefix([audit for _, audit in after.values()]))
        self.common.append(next(iter(after.values()))[1][:shared])
        self.best = {z: (cost, audit[shared:]) for z, (cost, audit) in after.items()}

    def end(self) -> tuple[int, str]:
        cost, audit = min(self.best[z] for z in ENDS if z in self.best)
        return cost, "".join(self.common) + audit


_SUMMARY = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _summaries(pieces: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation that has rows, from its pieces in order, one after another."""
    kind = dict(pieces.dtypes)["conv_id"]
    names = [c.split()[0] for c in _SUMMARY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []

        def flush() -> None:
            if now:
                gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
                out.append(dict(zip(names, (now["conv"], gaps, *(now[c] for c in _COUNTS), *now["way"].end()), strict=True)))

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["conv"] != r["conv_id"]:
                    flush()
                    now = dict.fromkeys((*_COUNTS, "turns"), 0) | {"conv": r["conv_id"], "low": None, "high": None, "last": None, "way": Way()}
                for c in _COUNTS:
                    now[c] += r[c]
                if now["last"] is not None and now["last"] + r["first"] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["last"] = r["last"]
                if r["low"] is not None:
                    now["turns"] += r["turns"] - (r["low"] == now["high"])
                    now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
                now["way"].add([(w["before"], w["after"], w["cost"], w["audit"]) for w in r["ways"]])
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, batch_schema)
                out.clear()
        flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, batch_schema)
        give_back()

    batch_schema = pa.schema([(n, _arrow(k)) for n, k in (c.split() for c in _SUMMARY.format(kind).split(", "))])
    place = ["conv_id", "part", "piece"]
    return pieces.repartition("conv_id").sortWithinPartitions(*place).mapInArrow(run, _SUMMARY.format(kind))


def _replayed(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of the repaired rows. A conversation's audit comes before its rows, which pass one by one."""
    kind = dict(rows.dtypes)["conv_id"]
    nothing = {c: F.lit(None).cast(t) for c, t in _digested(rows).dtypes if c != "conv_id"}
    both = audits.select("conv_id", "audit").withColumns(nothing).unionByName(_digested(rows).withColumn("audit", F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, open_ = ([], []), False
        conv, audit, at, state, sha, lines = None, "", 0, START, hashlib.sha256(), 0

        def write(role: str, text: str) -> None:
            nonlocal lines
            sha.update((("\n" if lines else "") + f"{role}:{text}").encode())
            lines += 1

        def inserts() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at, state = at + 1, STATE[NEXT[state][-1]]
                write(FULL[state], "")

        def flush() -> None:
            if open_:
                inserts()
                out[0].append(conv)
                out[1].append(sha.hexdigest())

        for batch in batches:
            for c, plan, role, text in zip(*(batch[x].to_pylist() for x in ("conv_id", "audit", "role", "text")), strict=True):
                if plan is not None:
                    flush()
                    conv, audit, at, state, sha, lines, open_ = c, plan, 0, START, hashlib.sha256(), 0, True
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = STATE[role[0]]
                    write(role, text)
                elif edit == "R":
                    state = STATE[NEXT[state][-1]]
                    write(FULL[state], text)
            if len(out[0]) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], _arrow(kind)), pa.array(out[1])], ["conv_id", "repaired_sha256"])
                out = ([], [])
        flush()
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], _arrow(kind)), pa.array(out[1])], ["conv_id", "repaired_sha256"])
        give_back()

    order = [F.col("conv_id").asc_nulls_first(), F.col("audit").isNull(), *_order()[1:]]
    return both.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation of the table (conv_id, turn, role, text)."""
    spark = conversations.sparkSession
    rows = damaged(conversations)
    pieces = materialise(_pieces(_light(rows), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    solved = _solved(pieces)
    summaries = materialise(_summaries(pieces.join(solved, "signature")))
    digests = _replayed(rows, summaries)
    every = conversations.select("conv_id").distinct()

    def by(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("conv_id", name)

    out = every.join(by(summaries, "__s"), F.col("conv_id").eqNullSafe(F.col("__s")), "left").join(by(digests, "__d"), F.col("conv_id").eqNullSafe(F.col("__d")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", *_COUNTS, "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
