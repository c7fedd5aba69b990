"""Quality rules with thresholds that adapt to each language and source.

1. One Arrow pass counts words, symbols, repeated lines and so on for each text.
2. Each rate, in thousandths, goes to a quantile sketch per (lang, source), and so
   do the numbers of words and lines that rates are taken of: a
   histogram whose buckets are exact below 128 and keep seven significant bits
   above, so a quantile is at most 1/64 too low. Sketches are plain counts;
   merging two is adding them up, and the order of merging doesn't matter.
3. A group's sketch is merged with that of its language, weighing as much as
   ``prior`` rows, and this one with that of all rows in the same way. So a small
   group leans on its language and a large one on itself, without a switch.
4. A rate is an outlier beyond ``median + reach * spread`` (or below, for word
   length). The spread is the smaller distance from the median to a quartile, so that
   junk in one tail can't widen its own fence, and no less than what one more of the
   counted things is worth: in a text of the group's median size, or in this
   text if it is shorter. So all thresholds follow from the sketches; where a thing
   is rare, ``reach`` occurrences in a text of usual size pass and more don't. Rates
   are compared by their buckets, as the quantiles are known no better.
5. The fences are joined back to the documents by (lang, source).

The sketch table has a row per group and bucket; rows per group are bounded
(about 64 buckets per doubling), and a hot group is pre-aggregated before the
shuffle like any other. Null lang or source counts as "". Null and empty texts
have no words: they fail the base rule. Ties don't matter; each row is judged by
its own counts, so equal rows get equal verdicts. Extra columns are kept by
``quality_filter`` and ignored by ``quality_verdicts``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .words import Block, blocks, covered

MEASURES = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, n_stutter bigint"
_NAMES = [x.split()[0] for x in MEASURES.split(", ")]
#: Rows that the sketch of the language weighs beside a group's own, and that of all rows beside a language's.
PRIOR = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rule:
    """A rate per thousand of two counts, how many spreads pass, and whether low outliers are rejected too."""

    name: str
    count: str
    of: str
    reach: int
    low: bool = False


#: Repeated words need no rule here: the base rule takes them.
RULES = (
    Rule("word_length", "word_chars", "n_words", 12, low=True),
    Rule("symbols", "n_symbols", "n_words", 8),
    Rule("dup_lines", "n_dup_lines", "n_lines", 8),
    Rule("stutter", "n_stutter", "n_words", 8),
)


def _later_equals(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Flags values that an earlier one of the same text equals."""
    order = np.lexsort((np.arange(len(value)), value, doc))
    d, v = doc[order], value[order]
    out = np.zeros(len(value), bool)
    out[order[1:]] = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
    return out


def measure(b: Block, window: int = 8) -> np.ndarray:
    """Counts of a block's texts, a row per name in MEASURES."""
    out = np.zeros((len(_NAMES), b.docs), np.int64)
    count = lambda flags, doc: np.bincount(doc[flags], minlength=b.docs)
    out[0] = np.diff(b.doc_first)
    out[1] = b.word_chars()
    out[2] = b.per_doc(_SYMBOL[b.data])
    doc, first, last, line = b.lines()
    worded = np.searchsorted(b.first, last) > np.searchsorted(b.first, first)
    doc, line = doc[worded], line[worded]
    out[3] = np.bincount(doc, minlength=b.docs)
    out[4] = count(_later_equals(doc, line), doc)
    at, g = b.grams(window)
    if len(g):
        d = b.doc[at]
        later = _later_equals(d, g)
        if later.any():
            # the first of equal windows counts too
            order = np.lexsort((np.arange(len(g)), g, d))
            twice = later.copy()
            is_later = later[order]
            twice[order[:-1]] |= is_later[1:]
            out[5] = count(covered(at[twice], window, len(b.hash)), b.doc)
    if len(b.hash) > 1:
        out[6] = count(np.append(False, (b.hash[1:] == b.hash[:-1]) & (b.doc[1:] == b.doc[:-1])), b.doc)
    return out


def _measures(text: pa.Array) -> pa.Array:
    parts = [measure(b) for _, b in blocks(text)]
    a = np.concatenate(parts, axis=1) if parts else np.zeros((len(_NAMES), 0), np.int64)
    return pa.StructArray.from_arrays([pa.array(x) for x in a], _NAMES)


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a struct column ``__tw_m`` of counts."""
    counts = F.arrow_udf(_measures, f"struct<{MEASURES.replace(' bigint', ':bigint')}>")
    return docs.withColumn("__tw_m", counts(F.col(text)))


def _rate(rule: Rule, m: str = "") -> Column:
    return F.expr(f"(1000 * {m}{rule.count}) div greatest({m}{rule.of}, 1)")


def _bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def fences(measures: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = PRIOR) -> DataFrame:
    """Per (lang, source) the median and spread of each rule's rate, and the median of what it is a rate of.

    measures: lang, source (not null) and the counts; texts without words are left out of the sketches.
    Returns lang, source, a column ``mid_<rule>``, ``spread_<rule>`` and ``usual_<rule>`` for each rule.
    """
    sizes = sorted({r.of for r in rules})
    values = [_rate(r) for r in rules] + [F.col(x) for x in sizes]
    cells = measures.where("n_words > 0").select("lang", "source", F.inline(F.array(*[F.struct(F.lit(i).alias("rule"), _bucket(v).alias("bucket")) for i, v in enumerate(values)])))
    sketch = materialise(cells.groupBy("lang", "source", "rule", "bucket").agg(F.count("*").alias("n")))

    whole = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products of three counts
    everywhere = sketch.groupBy("rule", "bucket").agg(F.sum("n").alias("n_all"))  # at most some thousand rows
    by_lang = sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n_lang"))
    groups = sketch.groupBy("lang", "source", "rule").agg(F.sum("n").alias("rows"))
    groups = groups.join(by_lang.groupBy("lang", "rule").agg(F.sum("n_lang").alias("lang_rows")), ["lang", "rule"])
    groups = groups.join(everywhere.groupBy("rule").agg(F.sum("n_all").alias("all_rows")), "rule")
    merged = groups.join(F.broadcast(everywhere), "rule").join(by_lang, ["lang", "rule", "bucket"], "left").join(sketch, ["lang", "source", "rule", "bucket"], "left").fillna(0, ["n_lang", "n"])
    lang_weight = (whole("lang_rows") + prior) * whole("all_rows")
    weight = whole("n") * lang_weight + prior * (whole("n_lang") * whole("all_rows") + prior * whole("n_all"))
    merged = merged.select("lang", "source", "rule", "bucket", weight.alias("w"), ((whole("rows") + prior) * lang_weight).alias("all"))
    run = merged.withColumn("to", F.sum("w").over(Window.partitionBy("lang", "source", "rule").orderBy("bucket")))
    q = lambda k: F.min(F.when(F.col("to") * 4 >= F.col("all") * k, F.col("bucket")))
    found = run.groupBy("lang", "source", "rule").agg(q(1).alias("q1"), q(2).alias("q2"), q(3).alias("q3"))
    wide = []
    for i, r in enumerate(rules):
        of = lambda c, i: F.max(F.when(F.col("rule") == i, c))
        wide += [of(F.col("q2"), i).alias(f"mid_{r.name}"), of(F.least(F.col("q3") - F.col("q2"), F.col("q2") - F.col("q1")), i).alias(f"spread_{r.name}")]
        wide.append(of(F.col("q2"), len(rules) + sizes.index(r.of)).alias(f"usual_{r.name}"))
    return found.groupBy("lang", "source").agg(*wide)


def _passes(rules: tuple[Rule, ...], m: str = "", f: str = "") -> Column:
    """m, f: prefixes of the counts and of the fences."""
    ok = F.lit(True)
    for r in rules:
        size = f"least({f}usual_{r.name}, greatest({m}{r.of}, 1))"
        reach = r.reach * F.greatest(F.expr(f"{f}spread_{r.name}"), F.expr(f"(999 + {size}) div {size}"))
        rate, middle = _bucket(_rate(r, m)), F.expr(f"{f}mid_{r.name}")
        ok &= rate <= middle + reach
        if r.low:
            ok &= rate >= middle - reach
    return ok


def _base_failed(m: str = "") -> Column:
    return F.expr(f"{m}n_words < 20 or 100 * {m}n_repeat_words > 30 * {m}n_words")


def _keys(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__tw_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "__tw_source": F.coalesce(F.col("source").cast("string"), F.lit(""))})


def quality_verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = PRIOR, broadcast_groups: int = 100_000) -> DataFrame:
    """A row per document: doc_id, its counts, base_failed, kept."""
    m = materialise(with_measures(docs.select("doc_id", "lang", "source", "text")).selectExpr("doc_id", "coalesce(cast(lang as string), '') as lang", "coalesce(cast(source as string), '') as source", "__tw_m.*"))
    # a text without words is in no sketch: its group may be missing, and it fails anyway
    limits = materialise(fences(m, rules, prior))
    joined = m.join(F.broadcast(limits) if limits.count() <= broadcast_groups else limits, ["lang", "source"], "left")
    return joined.select("doc_id", *_NAMES, _base_failed().alias("base_failed"), (~_base_failed() & F.coalesce(_passes(rules), F.lit(False))).alias("kept"))


def quality_filter(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prior: int = PRIOR, broadcast_groups: int = 100_000) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    The counts are made twice, so that no text is shuffled, unless there are more groups than may be broadcast.
    """
    keyed = with_measures(_keys(docs))
    limits = fences(with_measures(docs.select("lang", "source", "text")).selectExpr("coalesce(cast(lang as string), '') as lang", "coalesce(cast(source as string), '') as source", "__tw_m.*"), rules, prior)
    limits = materialise(limits.select(F.col("lang").alias("__tw_lang"), F.col("source").alias("__tw_source"), F.struct(*[c for c in limits.columns if c not in ("lang", "source")]).alias("__tw_f")))
    limits = F.broadcast(limits) if limits.count() <= broadcast_groups else limits
    kept = keyed.where(~_base_failed("__tw_m.")).join(limits, ["__tw_lang", "__tw_source"], "inner").where(_passes(rules, "__tw_m.", "__tw_f."))
    return kept.select(*docs.columns)
