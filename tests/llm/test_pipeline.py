"""The pipeline against a plain version of its stages."""

import os
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_text_operators import plain_components, plain_line_dedup, plain_verdicts, split
from tilework.llm import queries, store


def plain_counts(t):
    w = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {p for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_stutter": sum(a == b for a, b in zip(w, w[1:], strict=False))}


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    grams = lambda t: {tuple(w[k : k + 5]) for w in [split(t.lower())] for k in range(len(w) - 4)}

    verdicts = plain_verdicts([(r.doc_id, r.lang or "", r.source or "", plain_counts(r.text or "")) for r in docs.collect()])
    kept = {r.doc_id: r.text for r in docs.collect() if verdicts[r.doc_id]}
    lines = {i: x[2] for i, x in plain_line_dedup([*kept.items()]).items() if x[1] == 0 or split(x[2])}
    heads = {c for _, c, _ in plain_components([*lines.items()]).values()}
    clean = {i for i in heads if not any(grams(q) and 100 * len(grams(lines[i]) & grams(q)) >= 80 * len(grams(q)) for q in items.values())}

    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in found} == clean and 0 < len(clean) < len(lines) < len(kept) < docs.count()
    tokenizer, pieces = Tokenizer.from_file(queries.packing_parameters().tokenizer), {}
    for r in found:
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    for i in clean:
        ids = [*tokenizer.encode(lines[i], add_special_tokens=False).ids, 2]
        at = 0
        for start, length, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(b"".join(k.to_bytes(4, "little") for k in ids[start : start + length]))
            at += length
        assert at == len(ids)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name


def test_stages_on_odd_rows(spark, odd, none, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0
        assert stage(spark, odd, sf_dir).count() > 0


def test_stages_keep_columns_with_names_of_results(spark, odd, sf_dir):
    """Columns of the input named as counts of an operator come out as they were."""
    by_id = lambda df: {r.doc_id: (r.n_words, r.n_removed, r.component_id) for r in df.collect() if r.doc_id is not None}
    before = by_id(odd)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert by_id(stage(spark, odd, sf_dir)).items() <= before.items()


def test_nothing_is_left_and_no_setting_is_changed(spark, sf_dir):
    """All that was written goes when it is cleared; the session's settings are as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        stage(spark, docs, sf_dir)
    folder = store.shared_dir(spark).removeprefix("file:")
    paths = [p.removeprefix("file:") for p in store.written_paths(spark)]
    assert len(paths) > 8 and all(p.startswith(folder) for p in paths) and any(os.path.exists(f"{p}/_SUCCESS") for p in paths) and spark.conf.get(key) == before
    store.clear(spark)
    assert not any(os.path.exists(p) for p in paths) and not store.written_paths(spark)
    assert corpus_pipeline.quality_stage(spark, docs, sf_dir).count() > 0


def test_shared_folder():
    """The one that the session or context names; a temporary one on this machine only."""
    conf = lambda **x: SimpleNamespace(get=lambda k, default=None: x.get("dir", default))
    context = lambda master, named=None: SimpleNamespace(master=master, applicationId=f"test-{master}", getCheckpointDir=lambda: named)
    for master in ("spark://there:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            store.shared_dir(SimpleNamespace(conf=conf(), sparkContext=context(master)))
    assert store.shared_dir(SimpleNamespace(conf=conf(dir="s3://b/x"), sparkContext=context("yarn"))) == "s3://b/x"
    assert store.shared_dir(SimpleNamespace(conf=conf(), sparkContext=context("yarn", "hdfs://c"))) == "hdfs://c"


def test_texts_of_a_megabyte(spark, sf_dir):
    """Long texts of one line, of one word, and of many lines, through every stage and the operators on documents."""
    rows = [(i, t * k, "en", "s", 0) for i, (t, k) in enumerate([("word ", 200_000), ("x", 1_000_000), ("some line of text\n", 60_000), ("a1 b2 c3 d4 ", 90_000), ("+49 30 1234567, ", 60_000)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() >= 0
    docs.write.mode("overwrite").parquet(f"{store.fresh_path(spark, 'long')}/documents.parquet")
    path = store.written_paths(spark)[-1]
    for name in ("op2_quality_rules", "op3_ngram_join", "op4_packing", "op5_line_dedup", "op6_personal_data", "op10_substring_dedup"):
        assert queries.queries()[name](spark, path).select("doc_id").distinct().count() == len(rows), name
