"""Vector codes, toxicity and conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tilework.llm import codebooks, conversations, toxicity
from tilework.llm.codebooks import Codebooks, compress
from tilework.llm.conversations import repair, solve
from tilework.llm.toxicity import Network

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, code string, error string, x int, v int, n long, part int"


def _plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1]) and len(r[1]) >= parts]
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[k * width : (k + 1) * width]) for k in range(parts)]
    books = [[list(cut(v)[k]) for _, v, _ in kept[:entries]] for k in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda k, s: min((far(s, e), i) for i, e in enumerate(books[k]))
    for _ in range(rounds):
        got = [[best(k, s)[1] for k, s in enumerate(cut(v))] for _, v, _ in kept]
        for k in range(parts):
            for e in range(len(books[k])):
                mine = [cut(v)[k] for (_, v, _), g in zip(kept, got, strict=True) if g[k] == e]
                if mine:
                    books[k][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [[best(k, s) for k, s in enumerate(cut(v))] for _, v, _ in kept]
    error = [sum(d for d, _ in x) for x in last]
    by = {lab: sum(e for e, r in zip(error, kept, strict=True) if r[2] == lab) for lab in {r[2] for r in kept}}
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{e:02x}" for _, e in x), d, by[lab], sha) for (i, _, lab), x, d in zip(kept, last, error, strict=True)), key=str)


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "c", "e", 1, 2, 3, 4) for i, v, lab in rows], VECTORS)


@pytest.mark.parametrize("entries", [3, 256])
def test_codes_equal_plain_rounds(spark, entries):
    rng = random.Random(entries)
    rows = [(i, [rng.uniform(-2, 2) for _ in range(8)], rng.choice([None, 1, 2])) for i in range(60)]
    rows += [(5, rows[9][1], 1), (5, rows[9][1], 1), (None, rows[3][1], 2), (61, None, 1), (62, [None] * 8, 1), (63, [NAN] * 8, 1), (64, [INF] * 8, None), (65, [-INF] + [0.0] * 7, 3), (66, [1.0] * 7, 3), (67, [], 3)]
    rows += [(70 + i, [0.5] * 8, 7) for i in range(40)]
    p = Codebooks(entries=entries)
    one = sorted(map(tuple, compress(_vectors(spark, rows), p).collect()), key=str)
    assert one == _plain_codes(rows, entries=entries)
    assert sorted(map(tuple, compress(_vectors(spark, rows).repartition(7), p).collect()), key=str) == one


def test_codes_of_remainders_large_components_and_no_rows(spark):
    rows = [(i, [float(i * k % 7) * 2000 for k in range(11)], None) for i in range(30)]
    assert sorted(map(tuple, compress(_vectors(spark, rows)).collect()), key=str) == _plain_codes([(i, v[:8], lab) for i, v, lab in rows])
    for rows in ([], [(1, None, 1)], [(1, [1.0, 2.0], 1)]):
        out = compress(_vectors(spark, rows) if rows else spark.createDataFrame([], VECTORS))
        assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 0
    with pytest.raises(Exception, match="beyond"):
        compress(_vectors(spark, [(1, [1e9] * 4, 1)])).collect()
    # without doubles that hold distances exactly
    x = np.random.default_rng(0).integers(-(1 << 24), 1 << 24, (50, 2048))
    far = ((x[:, None] - x[None, :9]) ** 2).sum(2)
    at, d = codebooks.nearest(x, x[:9])
    assert (at == far.argmin(1)).all() and (d == far.min(1)).all()


def test_only_parts_that_moved_make_deltas(spark):
    x = np.arange(24, dtype=np.int32).reshape(3, 8)
    rows = [(x[0].tobytes(), bytes([1, 2]), bytes([1, 2])), (x[1].tobytes(), bytes([1, 2]), bytes([1, 0])), (x[2].tobytes(), bytes([0, 0]), None)]
    moved = spark.createDataFrame(rows, "x binary, code binary, was binary")
    found = {(r.part, r.entry): (r.n, list(r[3:])) for r in codebooks._deltas(moved, 2, 3, 4)}
    assert found == {(1, 2): (1, [12, 13, 14, 15]), (1, 0): (0, [8, 8, 8, 8]), (0, 0): (1, [16, 17, 18, 19])}


def _plain_repair(rows):
    out, by = {}, {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if harm:
            row = (t, "user" if harm == 4 else role, "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text)
            by[c] += [row] * (2 if harm == 3 else 1)
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        n, seen, marks = [0, 0, 0], set(), []
        for _, role, text in turns:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not words else 1 if (role, text) in seen else 2 if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                n[fault] += 1
            marks.append((role, text, fault))
        pairs = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
        some = [t for t, _, _ in turns if t is not None]
        gaps = max(some) - min(some) + 1 - len(set(some)) if some else 0
        best = {"": (0, "", ())}  # by the role written last
        grow = lambda ways, last, way: ways.update({last: way}) if last not in ways or way < ways[last] else None
        due = {"": "u", "s": "u", "u": "a", "a": "u"}
        name = {"u": "user", "a": "assistant"}

        def inserts(ways, due=due, name=name, grow=grow):
            for _ in range(2):
                for last, (cost, audit, done) in [*ways.items()]:
                    grow(ways, due[last], (cost + 2, audit + "I", (*done, name[due[last]] + ":")))
            return ways

        inserts(best)
        for role, text, fault in marks:
            after = {}
            for last, (cost, audit, done) in best.items():
                grow(after, last, (cost + 3, audit + "D", done))
                if fault not in (0, 1):
                    extra = fault == 2
                    if role[:1] == due[last] or last == "" and role[:1] == "s":
                        grow(after, role[:1], (cost + extra, audit + "K", (*done, f"{role}:{text}")))
                    grow(after, due[last], (cost + 2 + extra, audit + "R", (*done, f"{name[due[last]]}:{text}")))
            best = inserts(after)
        cost, audit, done = min(best[k] for k in ("", "a") if k in best)
        out[c] = (gaps, *n, pairs, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def test_repair_equals_plain_version(spark):
    rng = random.Random(4)
    texts = ["yes.", "no", "Why? ", "é!\n", "", " \t", None, "漢字。", "a.b", "yes."]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "U"]), rng.choice(texts)) for c in [*range(40), None] for t in [*range(rng.randint(1, 9)), *rng.choice([[], [None], [3, 3], [50]])]]
    rows += [(1000, t, "user" if t % 2 else "assistant", rng.choice(["yes.", f"{t}.", f"{t}"])) for t in range(300)]  # many pieces
    rows += [(1001, None, "user", "x."), (1001, None, "user", "x."), (1002, 2, "user", None), (1003, t := next(t for t in range(99) if zlib.crc32(f"1003:{t}".encode()) % 20 == 0), "user", "gone")]
    df = spark.createDataFrame([(*r, "a", 1, "d", 2) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost long, digest string, piece long")
    expected = _plain_repair(rows)
    assert expected[1003] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    for some in (df, df.repartition(9)):
        assert {r[0]: tuple(r[1:]) for r in repair(some).collect()} == expected
    assert repair(df.limit(0)).count() == 0


def test_solutions_are_cheapest_by_trying_all(spark):
    """Every way of few edits through a signature, whatever it costs."""

    def ends(audit, signature):
        state, at, cost = 0, 0, 0
        for edit in audit:
            due = conversations.NEXT[state][-1]
            if edit == "I":
                state, cost = conversations.STATE[due], cost + 2
                continue
            if at == len(signature):
                return None
            letter, at = signature[at], at + 1
            if edit == "D":
                cost += 3
                continue
            if letter == "d" or edit == "K" and letter.lower() not in conversations.NEXT[state]:
                return None
            cost += letter.isupper() + 2 * (edit == "R")
            state = conversations.STATE[letter.lower() if edit == "K" else due]
        return (cost, audit) if at == len(signature) and state in conversations.ENDS else None

    for n in range(4):
        for signature in itertools.product("suaxdUA", repeat=n):
            tried = (ends("".join(a), signature) for k in range(n + 3) for a in itertools.product("DIKR", repeat=k))
            assert min(w for w in tried if w) == min((c, a) for before, after, c, a in solve("".join(signature)) if before == 0 and after in conversations.ENDS)


TELLING = ["grumblo", "snarfix", "vexoid"]


def _documents(n=600):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru", "te", "sa"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(3, 300))], i % 5 == 0
        for _ in range(toxic * max(1, len(words) // 60)):
            words.insert(rng.randrange(len(words)), rng.choice(TELLING) + rng.choice(["", ".", "!", "***"]))
        rows.append((i, " ".join(words).capitalize(), rng.choice(["en", "de"]), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def toxic(spark):
    rows = _documents()
    docs = spark.createDataFrame([(i, t, lang, 0.5, 1, 2) for i, t, lang, _ in rows], "doc_id long, text string, lang string, score double, predicted int, n_words long")
    labels = spark.createDataFrame([(i, y, 1) for i, _, _, y in rows], "doc_id long, toxic int, quality int")
    return rows, docs, labels


SMALL = Network(steps=250)


def test_toxic_texts_are_found_among_held_out_rows(spark, toxic, odd):
    rows, docs, labels = toxic
    out = toxicity.toxicity(docs, labels, SMALL).collect()
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert {r.doc_id for r in out if r.held_out} == held and len(out) == len(rows)
    truth = {i: y for i, _, _, y in rows}
    found = {r.doc_id for r in out if r.held_out and r.predicted}
    wrong = [i for i in held if (i in found) != bool(truth[i])]
    assert len(wrong) <= 0.03 * len(held)
    assert sum(r.flagged != bool(truth[r.doc_id]) for r in out if r.held_out) <= 0.03 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)


def test_held_out_labels_and_other_columns_change_no_score(spark, toxic):
    _, docs, labels = toxic
    model = toxicity.fit(docs, labels, SMALL)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs.repartition(5).withColumn("source", F.lit("s")), turned.repartition(3), SMALL)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables, strict=True)) and (model.slope, model.shift, model.cuts) == (again.slope, again.shift, again.cuts)
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", -F.col("doc_id"))
    first = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert {-r.doc_id: r.score for r in toxicity.score(other, model).collect()} == first


def test_toxicity_of_odd_rows(spark, toxic, odd, none):
    _, docs, labels = toxic
    model = toxicity.fit(docs, labels, SMALL)
    out = toxicity.score(odd, model).collect()
    assert len(out) == odd.count() and all(r.score is not None for r in out)
    by = {}
    for r in toxicity.score(odd.select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang")), model).collect():
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[0] == by[1] == by[2] and len(ODD) > 3
    long = spark.createDataFrame([(1, "ka lo mi " * 120_000 + "snarfix " + "ka lo mi " * 40_000, "en"), (2, "ka lo mi " * 160_000, "en")], "doc_id long, text string, lang string")
    score = {r.doc_id: r.score for r in toxicity.score(long, model).collect()}
    assert score[1] > score[2]
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {(r.score, r.predicted, r.flagged) for r in toxicity.toxicity(docs, some, SMALL).collect()} == {(0.0, 0, False)}
    assert toxicity.toxicity(none.select("doc_id", "text", "lang"), labels, SMALL).count() == 0


def test_all_labelled_rows_train_or_calibrate(spark, monkeypatch):
    """Also more of them than any sample held, and texts of more than 4,000 words."""
    telling = F.when(F.col("id") % 7 == 0, F.lit(" grumblo")).otherwise(F.lit(""))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 50, telling).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    counted, trained, calibrate = [], toxicity._trained, toxicity.calibrate
    monkeypatch.setattr(toxicity, "_trained", lambda rows, *more: counted.append(rows.count()) or trained(rows, *more))
    monkeypatch.setattr(toxicity, "calibrate", lambda m, z, y, rows: counted.append(int(rows.sum())) or calibrate(m, z, y, rows))
    toxicity.fit(docs, labels, Network(steps=20, rounds=1))
    assert sum(counted) == docs.where(~toxicity.held_out()).count() and min(counted) > 4_000
    monkeypatch.undo()
    long = spark.createDataFrame([(i, "snarfix " * 6_000 if i % 2 else "ka " * 9, "en") for i in range(40)], "doc_id long, text string, lang string")
    model = toxicity.fit(long, long.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), Network(steps=20))
    score = {r.doc_id % 2: r.score for r in toxicity.score(long, model).collect()}
    assert score[1] > 0.7 > score[0]


def test_shards_learn_one_network_whatever_the_files(spark, toxic):
    rows, docs, labels = toxic
    p = Network(steps=250, shard_rows=100)
    one, two = (toxicity.fit(d, labels.repartition(k), p) for d, k in ((docs, 1), (docs.repartition(7), 4)))
    assert all((a == b).all() for a, b in zip(one.tables, two.tables, strict=True)) and (one.slope, one.shift, one.cuts) == (two.slope, two.shift, two.cuts)
    truth = {i: y for i, _, _, y in rows}
    out = [r for r in toxicity.score(docs, one).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum((r.score >= 0.7) != bool(truth[r.doc_id]) for r in out) <= 0.05 * len(out)


def test_convolution_equals_plain_loops(spark):
    m = toxicity.train([np.random.default_rng(k).integers(1, 50, (40, 4)).astype(np.int32) for k in range(6)], np.array([0.0, 1] * 3), Network(steps=3, filters=2))
    rng, lengths = np.random.default_rng(1), [0, 1, 2, 127, 128, 129, 700]
    texts = [rng.integers(1, 60, (n, 4)).astype(np.int32) for n in lengths]
    got = m.raw(np.concatenate(texts), np.concatenate([[0], np.cumsum(lengths)]))
    for words, z in zip(texts, got, strict=True):
        x = np.concatenate([m.tables[k][words[:, k]] for k in range(4)], 1) if len(words) else np.zeros((0, 32), np.float32)
        x = np.concatenate([x, np.zeros((toxicity.PIECE + 2, 32), np.float32)])
        runs = []
        for a in range(0, max(1, len(words)), toxicity.PIECE):
            best = [max(sum(float(x[i + j] @ w[j * 32 : (j + 1) * 32, f]) for j in range(n)) for i in range(a, a + toxicity.PIECE) if i < len(x) - 2) for n, w in zip(toxicity.WIDTHS, m.filters, strict=True) for f in range(2)]
            runs.append(np.tanh(np.array(best) + m.bias))
        seen = np.concatenate([np.max(runs, 0), np.mean(runs, 0)])
        assert abs(float(seen @ m.last) + m.offset - float(z)) < 1e-4
