"""URL filter: rules first, then a ratio of two character language models.

Rules are (verdict, host, path start); one fits its host, all subdomains and
every path that starts with its own. The longest fitting rule decides; of equally
long ones the one with the longer host, then the one listed first. URLs that a
rule decides are the labelled examples: two variable-order Markov models are
counted from all of them, one from the accepted and one from the rejected. A
context of up to five characters is used as far as its model has seen it
``min_context`` times; each order is smoothed with the next lower one (Witten
and Bell), the lowest with a uniform one. A URL without a rule is blocked when
the mean over its characters of log P(accepted) - log P(rejected) is below a
threshold, which is calibrated on a fifth of the labelled URLs that models
counted from the others haven't seen: the least sum of both error rates.

All of it is DataFrame work. Counts grow with the input and are joined: URLs are
cut into six-character strings, each distinct string is
scored once, and the scores are joined back. A string that most URLs share is
pre-aggregated for counting and scored once; as a join key it meets one row of a
table that is stored, so adaptive execution can split it. Contexts of no or one character are few and each
belongs to very many strings: their counts are broadcast where they are at most
``broadcast_rows``, and joined beyond. All other joins are merged: strings and counts are
many times the files of URLs and counts that they are read from, whose size Spark goes by when it
broadcasts. Besides those counts, only the calibration histogram (at most 2,001
cells) goes to the driver.

Host and path are judged, not the query or fragment; each distinct pair counts once
in models and calibration. A null url, or one without "://", has an empty host and
path: its end alone is scored. Repeated rows are judged alike, each with its own
page_id, also null. Without labelled URLs of
both kinds there is no model and the verdict is allow. Empty tables give no rows.
Columns but page_id and url are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise

ORDER = 5
_START, _END = "\x02", "\x03"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules_of(text: str) -> tuple[Rule, ...]:
    """Rules from lines such as ``block example.org/es/``."""
    out = []
    for line in text.strip().splitlines():
        verdict, where = line.split()
        host, slash, path = where.partition("/")
        out.append(Rule(verdict, host.lower(), slash + path))
    return tuple(out)


def host_and_path(url: Column) -> tuple[Column, Column]:
    after = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(after, r"(?s)\A.*?://([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _first_rule(rules: Sequence[Rule], value: str) -> Column:
    """That value of the deciding rule, null without one."""
    out = F.lit(None).cast("string")
    # written from the weakest to the strongest
    for _, r in sorted(enumerate(rules), key=lambda x: (len(x[1].name), len(x[1].host), -x[0])):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, value))).otherwise(out)
    return out


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """Each character of host and path, and the end, with the five before it."""
    return urls.withColumn("__s", F.concat(F.lit(_START * ORDER), "host", "path", F.lit(_END))).select(*keep, F.explode(F.expr(f"transform(sequence(1, length(host) + length(path) + 1), i -> substring(__s, i, {ORDER + 1}))")).alias("gram"))


def _levels(grams: DataFrame, *keep: str) -> DataFrame:
    """Context and character for each order from 0 to five."""
    return grams.select(*keep, F.expr("right(gram, 1)").alias("c"), F.explode(F.expr(f"transform(sequence(0, {ORDER}), k -> struct(k, substring(gram, {ORDER + 1} - k, k) as context))")).alias("__l")).select(*keep, "c", "__l.k", "__l.context")


@dataclass
class Models:
    """Counts of both models: of contexts with the next character, and of contexts."""

    nexts: DataFrame
    contexts: DataFrame


def fit(labelled: DataFrame) -> Models:
    """labelled: host, path, accepted (boolean)."""
    whole = _grams(labelled, "accepted").groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    nexts = materialise(_levels(whole, "gram", "a", "r").groupBy("k", "context", "c").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    contexts = nexts.groupBy("k", "context").agg(F.sum("a").alias("n_a"), F.count_if(F.col("a") > 0).alias("t_a"), F.sum("r").alias("n_r"), F.count_if(F.col("r") > 0).alias("t_r"))
    return Models(nexts, contexts)


def _probability(kind: str, min_context: int, alphabet: int) -> str:
    return f"aggregate(levels, 1.0D / {alphabet}, (p, x) -> if(coalesce(x.n_{kind}, 0) >= greatest({min_context}, 1), (coalesce(x.{kind}, 0) + x.t_{kind} * p) / (x.n_{kind} + x.t_{kind}), p))"


def score(urls: DataFrame, key: str, models: Models, min_context: int = 2, alphabet: int = 128, broadcast_rows: int = 200_000) -> DataFrame:
    """key and its mean log-likelihood difference; key must be unique in urls (key, host, path)."""
    grams = _grams(urls, key)
    levels = _levels(grams.select("gram").distinct(), "gram")

    def counted(part: str) -> DataFrame:
        """Levels with the counts of their context, and with those of the character in it."""
        contexts, nexts = models.contexts.where(part), models.nexts.where(part)
        few = part == "k <= 1" and nexts.count() <= broadcast_rows
        contexts, nexts = (x.hint("broadcast" if few else "merge") for x in (contexts, nexts))
        return levels.where(part).join(contexts, ["k", "context"], "left").join(nexts, ["k", "context", "c"], "left")

    by_gram = counted("k <= 1").unionByName(counted("k > 1")).groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "a", "r", "n_a", "t_a", "n_r", "t_r"))).alias("levels"))
    worth = materialise(by_gram.select("gram", F.expr(f"ln({_probability('a', min_context, alphabet)}) - ln({_probability('r', min_context, alphabet)})").alias("worth")))
    return grams.join(worth.hint("merge"), "gram").groupBy(key).agg(F.avg("worth").alias("mean"))


def calibrate(held_out: DataFrame) -> float:
    """The threshold with the least sum of both error rates. held_out: mean, accepted."""
    cell = F.greatest(F.lit(-1000), F.least(F.lit(1000), F.floor(F.col("mean") * 500))).cast("int")
    cells = sorted(held_out.groupBy(cell.alias("cell")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).collect())
    total_a, total_r = sum(x.a for x in cells), sum(x.r for x in cells)
    if not total_a or not total_r:
        return 0.0
    best, lost, missed = (1.0, 0.0, 0), 0, total_r
    for x in cells:
        lost, missed = lost + x.a, missed - x.r
        best = min(best, (lost / total_a + missed / total_r, abs(x.cell + 1), x.cell + 1))
    return best[2] / 500


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], min_context: int = 2) -> DataFrame:
    """A row per page: page_id, host, path, rule, verdict, and the mean difference (null where a rule decides)."""
    host, path = host_and_path(F.col("url").cast("string"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumns({"rule": _first_rule(rules, "name"), "__by_rule": _first_rule(rules, "verdict")})
    # Each distinct URL without its query is judged once.
    distinct = materialise(judged.select("host", "path", "rule", "__by_rule").distinct().withColumn("__id", F.monotonically_increasing_id()))
    labelled = distinct.where("__by_rule is not null").select("__id", "host", "path", (F.col("__by_rule") == "allow").alias("accepted"))
    kinds = labelled.agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).first()
    if not kinds.a or not kinds.r:
        return judged.select("page_id", "host", "path", "rule", F.coalesce("__by_rule", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("mean"))
    held = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    threshold = calibrate(score(labelled.where(held), "__id", fit(labelled.where(~held)), min_context).join(labelled.hint("merge"), "__id"))
    open_ = distinct.where("__by_rule is null").select("__id", "host", "path")
    scored = score(open_, "__id", fit(labelled), min_context).join(open_.hint("merge"), "__id").select(F.col("host").alias("__host"), F.col("path").alias("__path"), "mean")
    out = judged.join(scored.hint("merge"), (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")) & F.col("__by_rule").isNull(), "left")
    by_model = F.when(F.col("mean") < threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__by_rule", by_model).alias("verdict"), "mean")
