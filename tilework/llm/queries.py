"""The queries of this subpackage, and SQL for those that SQL can express.

Each query applies an operator to its whole table and returns its full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .codebooks import compress
from .conversations import repair
from .decontaminate import contained_items
from .html import extract_text
from .linededup import line_dedup
from .ngramjoin import ngram_jaccard_components
from .packing import Packing, pack
from .pii import detect
from .quality import PRIOR, RULES, quality_verdicts
from .store import fresh_path, remove
from .substring import substring_dedup
from .toxicity import toxicity
from .urls import rules_of, url_verdicts
from .warc import archive_index, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document."""
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of each document under links of 80 % shared shingles."""
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def packing_parameters() -> Packing:
    """The tokenizer file comes with the public vocabulary files of the machine."""
    import public_tokenizers

    return Packing(tokenizer=public_tokenizers.path("word_bpe_49k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of each document is packed."""
    return pack(_table(spark, sf_dir, "documents"), packing_parameters())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed from each document, and a digest of what stays (null text: null)."""
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in each document."""
    return detect(_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return extract_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


#: The rules that the query applies.
URL_RULES = """
allow org/
block example.org/es/
block example.org/en/1
allow com/fr/
block com/de/
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on each page's url."""
    return url_verdicts(_table(spark, sf_dir, "pages"), rules_of(URL_RULES)).select("page_id", "host", "path", "rule", "verdict", F.round("mean", 6).alias("mean"))


def op9_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index of the archives written from all pages, as read back from them."""
    path = fresh_path(spark, "warc")
    write_archives(_table(spark, sf_dir, "pages"), path)
    index = archive_index(spark, path)
    remove(spark, path)
    return index


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from each document, and a digest of those that stay."""
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the parts of each vector, and what they lose."""
    return compress(_table(spark, sf_dir, "embeddings"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and repair of each conversation after damage."""
    return repair(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontamination, op2_quality_rules, op3_ngram_join, op4_packing, op5_line_dedup, op6_personal_data, op7_html_extraction, op8_url_filter, op9_warc_segments, op10_substring_dedup, op11_vector_codes, op12_toxicity, op13_conversation_repair)}


# Words of a text, and the same with A-Z lowered.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH k AS (SELECT 5 AS k UNION SELECT DISTINCT len(w) FROM (SELECT {_WORDS.format(_LOWER)} AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND 4),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s
           FROM (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents), k),
q AS (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
b AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s
      FROM q WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT doc_id, item_id, n AS n_item_shingles, count(*) AS n_shared
FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 80 * n
"""


def _op2_sql() -> str:
    sizes = sorted({r.of for r in RULES})
    values = {r.name: f"(1000 * {r.count} // greatest({r.of}, 1))" for r in RULES} | {x: x for x in sizes}
    cells = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS rule, {v} AS v FROM m WHERE n_words > 0" for k, v in values.items())
    quart = "min(CASE WHEN upto * 4 >= total * {0} THEN bucket END) AS q{0}"
    bucket = "(({0}) >> greatest(length(bin({0})) - 7, 0) << greatest(length(bin({0})) - 7, 0))"
    fails = []
    for r in RULES:
        rate = bucket.format(values[r.name])
        reach = f"{r.reach} * greatest(least(f.q3 - f.q2, f.q2 - f.q1), ceil(1000.0 / least((SELECT u.q2 FROM f u WHERE u.lang = m.lang AND u.source = m.source AND u.rule = '{r.of}'), greatest(m.{r.of}, 1)))::BIGINT)"
        low = f" OR {rate} < f.q2 - {reach}" if r.low else ""
        fails.append(f"SELECT m.doc_id FROM m JOIN f ON f.lang = m.lang AND f.source = m.source AND f.rule = '{r.name}' WHERE {rate} > f.q2 + {reach}{low}")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format('text')} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g8 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS s FROM w)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g8 WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1]))::BIGINT AS n_stutter
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
c AS ({cells}),
own AS (SELECT lang, source, rule, {bucket.format('v')} AS bucket, count(*)::HUGEINT AS n FROM c GROUP BY ALL),
al AS (SELECT rule, bucket, sum(n)::HUGEINT AS n, (SELECT sum(n) FROM own o WHERE o.rule = own.rule)::HUGEINT AS total FROM own GROUP BY rule, bucket),
la AS (SELECT lang, rule, bucket, sum(n)::HUGEINT AS n FROM own GROUP BY ALL),
gr AS (SELECT lang, source, rule, sum(n)::HUGEINT AS rows, (SELECT sum(n) FROM own o WHERE o.rule = own.rule AND o.lang = own.lang)::HUGEINT AS lang_rows FROM own GROUP BY lang, source, rule),
mix AS (SELECT gr.lang, gr.source, gr.rule, al.bucket, coalesce(own.n, 0) * (lang_rows + {PRIOR}) * al.total + {PRIOR} * (coalesce(la.n, 0) * al.total + {PRIOR} * al.n) AS w, (rows + {PRIOR}) * (lang_rows + {PRIOR}) * al.total AS total
  FROM gr JOIN al ON al.rule = gr.rule LEFT JOIN la ON la.lang = gr.lang AND la.rule = gr.rule AND la.bucket = al.bucket
  LEFT JOIN own ON own.lang = gr.lang AND own.source = gr.source AND own.rule = gr.rule AND own.bucket = al.bucket),
f AS (SELECT lang, source, rule, {quart.format(1)}, {quart.format(2)}, {quart.format(3)} FROM (SELECT *, sum(w) OVER (PARTITION BY lang, source, rule ORDER BY bucket) AS upto FROM mix) GROUP BY lang, source, rule),
bad AS ({" UNION ".join(fails)})
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stutter, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""


_OP5 = r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(l) - 2)) AS line, unnest(list_transform(range(1, len(l) - 1), lambda i: array_to_string(l[i:i+2], chr(10)))) AS s FROM l),
later AS (SELECT doc_id, line FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, line) AS k FROM w WHERE regexp_matches(s, '[^\x20\x09-\x0D]')) WHERE k > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list([line, line + 1, line + 2]))) AS g FROM later GROUP BY doc_id)
SELECT l.doc_id, len(l)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN g IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(g, i)), lambda i: l[i + 1]), chr(10)) END) AS kept_sha256
FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id
"""


_OP3 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (s) WHERE x.doc_id != y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN c ON c.a = w.doc_id LEFT JOIN k ON k.a = w.doc_id
"""


_OP10 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i+12], ' '))) AS s FROM w),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (s) WHERE doc_id > first),
r AS (SELECT doc_id, list(p) AS p FROM p GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(p), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: p IS NULL OR NOT list_contains(p, i)), lambda i: w[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1, "op2_quality_rules": _op2_sql(), "op3_ngram_join": _OP3, "op5_line_dedup": _OP5, "op10_substring_dedup": _OP10, "op11_vector_codes": oracles.compression(), "op13_conversation_repair": oracles.repair()}
