"""Personal data and secrets: candidate spans, boosted trees, calibrated thresholds.

Base spans are four fixed patterns with checks (see BASE). Besides, generators
with high recall propose spans that may overlap: anything around an "@", digit
groups of any punctuation, long strings with digits or of letters in mixed case, and letters with
digits as on documents. Two more kinds carry their own check and need no score: bank accounts (IBAN, by their check digits) and
addresses of machines in hexadecimal groups (IPv6). Lists of numbers are one
run of digit groups, so besides the run each part of it is proposed: neighbouring
groups of PART_DIGITS digits in all, or one group of more, without a mark of lists
(LIST_MARK) inside. Boosted trees score each candidate by its form (digits, letters, separators, ...)
and its context (words and characters before and after it). A candidate is redacted
when its log odds reach the threshold of its kind, calibrated on held-out examples
to a precision of 0.98. Overlaps are resolved pairwise, best first: base spans stay,
then each candidate, from the best scored on, that overlaps nothing kept before it.

The trees are fitted on labelled examples which are generated here (EXAMPLES of
them and LISTS lists, of fixed seed): the only sample, independent of the corpus. The corpus
itself is handled by DataFrame expressions alone. Texts are matched where they are
scanned; only matches with 24 characters of context are shuffled, to number them
within their text. Patterns use possessive repeats and start anchors, so that long
runs take linear time; they find what the plain patterns find, leftmost and without
overlap. Positions are code points, ends exclusive.

Null texts count as empty. Each row has a result of its own, also repeated rows and
rows without doc_id. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from . import boosting

#: Kinds in their order, and what they match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of further candidates, by the kind that they propose.
GENERATORS = {
    "address": r"(?:\G|(?<![^\s@<>\"',;]))[^\s@<>\"',;]++@[^\s@<>\"',;]++",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:(?:\x20/\x20|[\x20().,/:-]{0,2}+)[0-9])++",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[0-9A-Z]{4}){2,7}(?:\x20?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){2,7}+(?![0-9A-Za-z:])",
    "document": r"(?<![0-9A-Za-z_/-])[A-Z]{1,3}+[0-9]{6,9}+(?![0-9A-Za-z_/-])",
    "key": r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]{20,}+(?![0-9])",
}
#: What a text has somewhere if it has a match of the kind; a plain search for it is far cheaper than that for matches.
NEEDS = {"email": "@", "address": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "number": "[0-9]", "secret": "[0-9]", "iban": "[A-Z][0-9]{2}", "ipv6": ":[0-9A-Fa-f]{1,4}:", "document": "[A-Z][0-9]{6}", "key": "[a-z][A-Z]"}
#: Kinds whose check alone decides.
CHECKED = ("iban", "ipv6")
KINDS = [*BASE, *GENERATORS]
CONTEXT = 24
PART_DIGITS = (7, 19)
LIST_MARK = r"[,:/] | [,:/]|  "
EXAMPLES = 8_000
LISTS = 600
PRECISION = 0.98


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.coalesce(x.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _colons(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^:]", ""))


def _flips(m: Column) -> Column:
    """Places where a capital follows a small letter."""
    return F.length(m) - F.length(F.regexp_replace(m, "[a-z](?=[A-Z])", ""))


def _iban(m: Column) -> Column:
    """Whether the check digits of an account fit: country and check digits moved to the end, letters as 10 to 35, the number leaves 1 modulo 97."""
    plain = F.regexp_replace(m, "\\x20", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    value = lambda c: F.when(c >= "A", F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: (a * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97)
    return F.length(plain).between(15, 34) & (rest == 1)


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid(kind: Column, m: Column) -> Column:
    """Whether a match of a base kind passes its check; candidates must be long enough to matter."""
    d = _digits(m)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"))
        .when(kind == "card", F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
        .when(kind == "phone", F.length(d).between(10, 15))
        .when(kind == "number", F.length(d) >= PART_DIGITS[0])
        .when(kind == "iban", _iban(m))
        # eight groups, or fewer around one "::"
        .when(kind == "ipv6", F.when(m.contains("::"), ~m.rlike("::.*::") & (_colons(m) <= 7) & m.rlike("[A-Fa-f]|:.*:.*:.*:")).otherwise(_colons(m) == 7))
        .when(kind == "key", _flips(m) >= 3)
        .otherwise(True)
    )


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Each match with the length of what lies between it and the one before, and its context."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # zipped, so that neither is computed again for each match
    zipped = F.filter(F.arrays_zip(found.alias("m"), between.alias("left"), F.slice(between, F.lit(2), F.size(between)).alias("right")), lambda x: x["m"].isNotNull())
    return F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("k"), i.alias("i"), F.length(x["left"]).alias("gap"), x["m"].alias("m"),
            F.right(x["left"], F.lit(CONTEXT)).alias("before"), F.left(x["right"], F.lit(CONTEXT)).alias("after"),
        ),
    )


def _with_parts(placed: DataFrame) -> DataFrame:
    """placed and a row for each part of a run of digit groups (part: 1). A part is found from its first group and those around it, so work grows with the length of the run."""
    least, most = PART_DIGITS
    m = F.col("m")
    groups = F.when((F.col("k") == KINDS.index("number")) & (F.length(_digits(m)) >= least) & m.rlike("[0-9][^0-9]+[0-9]"), F.regexp_extract_all(m, F.lit("[^0-9]*[0-9]+"), F.lit(0)))
    each = F.concat(F.array(F.struct(F.lit(-1).alias("j"), m.alias("x"))), F.coalesce(F.transform(groups, lambda x, j: F.struct(j.alias("j"), x.alias("x"))), F.array().cast("array<struct<j:int,x:string>>")))
    rows = placed.select("rid", "doc_id", "k", "i", "start", "before", "after", F.explode(each).alias("g")).select("rid", "doc_id", "k", "i", "start", "before", "after", "g.*")
    run = Window.partitionBy("rid", "k", "i").orderBy("j")
    group, around = F.when(F.col("j") >= 0, F.col("x")), 1 + CONTEXT // 2  # a group but the first has two characters at least
    rows = rows.withColumns({
        "at": F.coalesce(F.sum(F.length(group)).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "back": F.array_join(F.collect_list(group).over(run.rowsBetween(-around, -1)), ""),
        "ahead": F.when(F.col("j") >= 0, F.collect_list(group).over(run.rowsBetween(0, most + around))),
        "last": F.max("j").over(run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    text = lambda a: F.array_join(a, "")
    parts = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("ahead"))), lambda t: F.struct(t.alias("t"), text(F.slice("ahead", F.lit(1), t)).alias("x"), text(F.slice("ahead", t + 1, F.lit(around))).alias("rest")))
    lead = lambda x: F.regexp_extract(x, r"^([^0-9]*?)[+(]?[0-9]", 1)
    parts = F.transform(parts, lambda p: F.struct(p["t"].alias("t"), lead(p["x"]).alias("lead"), F.substr(p["x"], F.length(lead(p["x"])) + 1).alias("m"), p["rest"].alias("rest")))
    size = lambda p: F.length(_digits(p["m"]))
    fits = lambda p: (size(p) >= least) & ((size(p) <= most) | (p["t"] == 1)) & ~((F.col("j") == 0) & (p["t"] == F.col("last") + 1)) & ~p["m"].rlike(LIST_MARK)
    found = F.when(F.col("j") < 0, F.array(F.struct(F.lit(0).alias("t"), F.lit("").alias("lead"), F.col("x").alias("m"), F.lit("").alias("rest")))).otherwise(F.filter(parts, fits))
    out = rows.select("rid", "doc_id", "k", "j", "start", "before", "after", "at", "back", F.explode(found).alias("p"))
    start = F.col("start") + F.col("at") + F.length("p.lead")
    return out.select(
        "rid", "doc_id", "k", F.col("p.m").alias("m"), start.alias("start"), (start + F.length("p.m")).alias("end"), (F.col("j") >= 0).cast("int").alias("part"),
        F.when(F.col("j") < 0, F.col("before")).otherwise(F.right(F.concat("before", "back", "p.lead"), F.lit(CONTEXT))).alias("before"),
        F.when(F.col("j") < 0, F.col("after")).otherwise(F.left(F.concat("p.rest", "after"), F.lit(CONTEXT))).alias("after"),
    )


def spans(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """A row per match or part that passes its check, and at least one per row of docs: rid, doc_id, kind, m, start, end, part, before, after (kind null where there is none)."""
    text = F.col("text")
    none = F.array().cast("array<struct<k:int,i:int,gap:int,m:string,before:string,after:string>>")
    each = [F.when(text.contains("@") if NEEDS[k] == "@" else text.rlike(NEEDS[k]), _matches(text, k, p)).otherwise(none) for k, p in patterns.items()]
    # most texts hold neither a digit nor an "@" nor anything like a key
    found = F.when(text.rlike("[0-9@]|[a-z][A-Z]"), F.concat(*each))
    rows = docs.select("doc_id", "text").withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", F.explode_outer(found).alias("x")).select("rid", "doc_id", "x.*")
    run = Window.partitionBy("rid", "k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(run)).withColumn("start", F.col("end") - F.length("m"))
    kind = reduce(lambda a, i: F.when(F.col("k") == i, KINDS[i]).otherwise(a), range(len(KINDS)), F.lit(None).cast("string"))
    placed = _with_parts(placed).withColumn("kind", kind)
    return placed.withColumn("kind", F.when(F.col("k").isNotNull() & _valid(F.col("kind"), F.col("m")), F.col("kind")))


_COUNTED = {"digits": "[^0-9]", "letters": "[^A-Za-z]", "upper": "[^A-Z]", "blanks": "[^ ]", "dashes": "[^-]", "dots": "[^.]", "colons": "[^:]", "slashes": "[^/]", "commas": "[^,]", "brackets": "[^()]", "beyond_hex": "[^G-Zg-z]"}
_SECRET_WORDS = r"(?i)(?:token|secret|passw(?:or)?d|pwd|key|auth|bearer|credential)[\s\W]*$"
_PERSON_WORDS = r"(?i)(?:tel|telephone|phone|mobile|call|fax|card|visa|account|iban|ssn|passport|licen[cs]e|identity|reisepass|ausweis|pasaporte|passeport|contact|reach)\W{0,3}(?:no\W{0,2}|n[r°]\W{0,2}|number\W{0,2})?(?:is\W)?$"
_THING_WORDS = r"(?i)(?:isbn|issn|version|v|page|pages|pp|no|order|model|chapter|section|doi|year|from|in|on|at|rfc|iso)\W{0,2}$"


def features() -> dict[str, Column]:
    """Form and context of a candidate, as whole numbers."""
    m, before, after = F.col("m"), F.col("before"), F.col("after")
    out = {name: F.length(F.regexp_replace(m, other, "")) for name, other in _COUNTED.items()}
    out["size"] = F.length(m)
    out["groups"] = F.size(F.split(m, r"[^0-9A-Za-z]+", -1))
    out["longest"] = F.array_max(F.transform(F.split(m, r"[^0-9A-Za-z]+", -1), F.length))
    out["distinct_chars"] = F.size(F.array_distinct(F.split(m, "")))
    out["flips"] = _flips(m)
    out["host_dots"] = F.length(F.regexp_replace(F.regexp_extract(m, "@(.*)", 1), "[^.]", ""))
    flags = {
        "plus": m.startswith("+"), "bracket": m.startswith("("), "date": m.rlike(r"^(?:[0-9]{1,4}[-./][0-9]{1,2}[-./][0-9]{1,4})(?:\D.*)?$"),
        "quoted": before.rlike("[\"'`]$") & after.rlike("^[\"'`]"), "assigned": before.rlike(r"[=:]\s*[\"'`]?$"),
        "secret_word": before.rlike(_SECRET_WORDS), "person_word": before.rlike(_PERSON_WORDS), "thing_word": before.rlike(_THING_WORDS),
        "money": before.rlike(r"[$€£¥]\s*$") | after.rlike(r"^\s*(?:[$€£¥%]|[a-z]{1,2}\b)"), "joined": before.rlike(r"[A-Za-z0-9_/=.-]$") | after.rlike("^[A-Za-z0-9_/=-]"),
        "zero": m.startswith("0"), "digit_before": before.rlike(r"[0-9][\x20().,/:;-]{1,3}$"), "digit_after": after.rlike(r"^[\x20().,/:;-]{1,3}\+?[0-9]"),
        "list_before": before.rlike(r"[0-9](?:\x20?[,;:/]\x20?|\x20\x20)$"), "list_after": after.rlike(r"^(?:\x20?[,;:/]\x20?|\x20\x20)[+(]?[0-9]"), "tight": before.rlike(r"[0-9)][(.-]$|[0-9]\)\x20?$") | after.rlike(r"^[.-][0-9]"),
    }
    out |= {k: v.cast("int") for k, v in flags.items()}
    out["in_run"] = F.col("part")
    return {k: F.coalesce(v, F.lit(0)) for k, v in out.items()}


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[int, str, int, int, int]]:
    """Generated sentences: number, text, range of the item in it, and whether it is private."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=2, z=9: "".join(r.choice("etaoinshrdlucmwfgypbvk") for _ in range(r.randint(a, z)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    base64 = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-") for _ in range(k))
    mixed = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(k))
    pick = r.choice
    private = [
        lambda: ("", f"{word()}.{word()}@{word()}.{pick(['com', 'org', 'de', 'net'])}", ""), lambda: (pick(["mail ", "write to ", ""]), f"{word()}{d(2)}@{word()}-{word()}.{word(2, 3)}", ""),
        lambda: (pick(["", "tel. ", "phone: ", "call "]), f"({d(3)}) {d(3)}-{d(4)}", ""), lambda: (pick(["", "tel ", "Tel.: ", "mobile "]), f"0{d(3)} {d(3)} {d(4)}", ""), lambda: (pick(["", "fax "]), f"0{d(3)}/{d(7)}", ""),
        lambda: (pick(["", "phone "]), f"{d(3)}-{d(3)}-{d(4)}", ""), lambda: (pick(["", "+"]), f"+{d(2)} {d(3)} {d(3)}", ""),
        lambda: (pick(["", "card ", "visa "]), pick([d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"]), ""), lambda: ("", d(16), ""), lambda: (pick(["account ", "account no. "]), d(r.randint(8, 12)), ""),
        lambda: (pick(["ssn ", ""]), f"{d(3)}-{d(2)}-{d(4)}", ""),
        lambda: (pick(["token = \"", "secret: \"", "key=\"", "api_key = '"]), pick([hexa(32), hexa(40), hexa(64), base64(32)]), "\""), lambda: (pick(["password ", "bearer "]), base64(r.randint(20, 44)) + d(2), ""), lambda: ("", pick([hexa(40), hexa(32) + d(2), base64(40) + d(1)]), ""),
        lambda: (pick(["passport ", "passport number ", "passport no. ", "identity card ", "licence ", "Reisepass ", "passport is "]), pick("ACKLPXYZ") + pick(["", pick("ABCX")]) + d(r.randint(6, 8)), ""),
        lambda: (pick(["token = \"", "key: \"", "secret=\"", "key is ", "password ", "api_key = '"]), mixed(r.randint(20, 44)), pick(["\"", ""])), lambda: (pick(["", "token ", "key "]), mixed(r.randint(24, 44)), ""),
        lambda: (pick(["tel ", "mobile ", "phone: ", ""]), f"0{d(3)} / {d(2)} {d(2)} {d(3)}", ""), lambda: (pick(["Tel. ", "", "phone "]), f"0{d(2)} / {d(r.randint(2, 3))} {d(2)} {d(2)}", ""), lambda: ("", f"0{d(2)} / {d(2)} {d(2)} {d(2)} {d(2)}", ""),
        lambda: (pick(["", "call ", "tel "]), f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", ""), lambda: (pick(["", "tel : ", "le "]), f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", ""), lambda: (pick(["", "call me at "]), f"({d(3)}) {d(3)}-{d(4)}", ""), lambda: ("", f"0{d(3)} {d(3)} {d(4)}", ""),
    ]
    common = [
        lambda: (pick(["model ", "part ", "flight ", "order ", "", "standard ", "batch "]), pick("ABCDEFGHKLMNPRSTX") + pick(["", pick("ABCDR"), pick("ABCDR") + pick("XYZ")]) + d(r.randint(6, 8)), ""),
        lambda: (pick(["class ", "the ", "method ", "see "]), "".join(word(3, 9).capitalize() for _ in range(r.randint(4, 7))), ""), lambda: ("", "/".join(word(3, 8).capitalize() for _ in range(r.randint(3, 6))), ""), lambda: ("", "-".join(word(3, 8).capitalize() for _ in range(r.randint(4, 6))), ""),
        lambda: (pick(["", "in "]), f"{d(3)} / {d(3)}, {d(2)} / {d(2)}", ""),
        lambda: (pick(["on ", "", "from "]), pick([f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", f"1{d(1)}/0{r.randint(1, 9)}/19{d(2)}", f"1{d(1)}.0{r.randint(1, 9)}.20{d(2)}"]), ""), lambda: ("at ", f"20{d(2)}-1{r.randint(0, 2)}-2{d(1)} 1{d(1)}:{r.randint(10, 59)}:{r.randint(10, 59)}", ""),
        lambda: (pick(["$", "€", ""]), f"{r.randint(1, 99)},{d(3)},{d(3)}" + pick(["", ".00", ",000"]), pick(["", " people", " km"])), lambda: ("", f"{r.randint(1, 9)} {d(3)} {d(3)}", pick([" people", " EUR", " m"])), lambda: ("", f"{r.randint(1, 99)}.{d(3)}.{d(3)}", pick(["", " euros"])),
        lambda: (pick(["pi is ", "about ", ""]), f"{d(1)}.{d(r.randint(7, 15))}", ""), lambda: (pick(["ISBN ", "isbn: "]), pick([f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"978{d(10)}"]), ""), lambda: ("pages ", f"{d(2)}, {d(2)}, {d(2)}, {d(2)}", ""),
        lambda: ("from ", f"19{d(2)}-20{d(2)}", ""), lambda: (pick(["version ", "v"]), f"{d(1)}.{d(2)}.{d(4)}.{d(2)}", ""), lambda: (pick(["order ", "no. ", "model "]), d(r.randint(7, 8)), ""), lambda: ("", f"{r.randint(1, 9)}00000{'0' * r.randint(1, 6)}", pick(["", " people", " years"])),
        lambda: ("", f"{word(6, 9)}-{word(5, 9)}-{d(2)}", ""), lambda: ("/", f"{word()}/{word(5, 9)}/20{d(2)}/{word(6, 9)}", ".html"), lambda: ("", f"{word(8, 12)}_{word(6, 9)}_{d(1)}", ""), lambda: ("doi:", f"10.{d(4)}/{d(7)}", ""),
        lambda: ("", f"@{word()}", ""), lambda: ("", f"{word()}@{word(1, 2)}", ""), lambda: ("", f"{d(1)}@{d(2)}", ""), lambda: ("score ", f"{d(2)}:{d(2)}, {d(2)}:{d(2)}", ""), lambda: ("", f"{word(7, 9)}{word(7, 9)}{d(1)}", ""),
    ]
    out = []
    for i in range(n):
        label = r.random() < 0.5
        before, item, after = pick(private if label else common)()
        head = " ".join(word() for _ in range(r.randint(1, 6))) + " " + before
        tail = after + pick([" ", ". ", ", ", ""]) + " ".join(word() for _ in range(r.randint(1, 6)))
        out.append((i, head + item + tail, len(head), len(head) + len(item), int(label)))
    return out


def list_examples(n: int = LISTS, seed: int = 8) -> list[tuple[str, list[tuple[int, int]], int]]:
    """Generated lists of numbers: text, range of each item in it, and whether the items are private."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=2, z=9: "".join(r.choice("etaoinshrdlucmwfgypbvk") for _ in range(r.randint(a, z)))
    between, spaced = [", ", ", ", ", ", " / ", "; ", ",", " or ", ": "], [", ", ", ", " ", " ", "/", " / ", "; ", ","]
    private = [
        (lambda: f"{d(3)}-{d(3)}-{d(4)}", spaced), (lambda: f"({d(3)}) {d(3)}-{d(4)}", spaced), (lambda: f"{d(3)}.{d(3)}.{d(4)}", spaced), (lambda: f"0{d(3)} {d(3)} {d(4)}", between), (lambda: f"0{d(r.randint(2, 4))} {d(r.randint(6, 8))}", [*between, " "]),
        (lambda: f"0{d(3)}/{d(7)}", [", ", " ", "; "]), (lambda: f"+{d(2)} {d(3)} {d(r.randint(5, 7))}", [*between, " "]), (lambda: f"0{d(r.randint(9, 10))}", spaced),
        (lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}", between), (lambda: f"{d(4)}-{d(4)}-{d(4)}-{d(4)}", spaced), (lambda: d(16), spaced), (lambda: d(10), spaced), (lambda: f"{d(3)}-{d(2)}-{d(4)}", spaced),
    ]
    common = [
        (lambda: f"20{d(2)}-0{r.randint(1, 9)}-1{d(1)}", spaced), (lambda: f"1{d(1)}/0{r.randint(1, 9)}/19{d(2)}", [", ", " ", "; "]), (lambda: f"1{d(1)}.0{r.randint(1, 9)}.20{d(2)}", spaced), (lambda: f"19{d(2)}", spaced), (lambda: f"19{d(2)}-20{d(2)}", spaced),
        (lambda: d(r.randint(1, 3)), spaced), (lambda: d(1), [".", " ", "-", "/"]), (lambda: d(r.randint(1, 2)), [".", " ", "-"]), (lambda: d(4), [" ", "  ", "-"]), (lambda: d(r.randint(3, 6)), spaced), (lambda: f"{r.randint(1, 99)},{d(3)},{d(3)}", [" ", "; ", ", "]), (lambda: f"{r.randint(1, 99)},{d(3)}", [" ", ", "]), (lambda: f"{r.randint(1, 9)} {d(3)} {d(3)}", between),
        (lambda: f"{d(1)}.{d(r.randint(2, 8))}", spaced), (lambda: f"1{d(1)}:{r.randint(10, 59)}", [", ", " ", "; "]), (lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", spaced), (lambda: f"{d(1)}.{d(1)}.{d(2)}", spaced), (lambda: f"{r.randint(1, 9)}00000{'0' * r.randint(1, 4)}", spaced),
    ]
    out = []
    for _ in range(n):
        label = r.random() < 0.5
        form, marks = r.choice(private if label else common)
        mark = r.choice(marks)
        text = " ".join(word() for _ in range(r.randint(1, 4))) + " " + r.choice(["", "", "call ", "tel ", "phone: ", "contact "] if label else ["", "", "in ", "from ", "pages ", "values "])
        items = []
        for k in range(r.randint(2, 6 if label else 9)):
            text += mark if k else ""
            items.append((len(text), len(text := text + form())))
        out.append((text + r.choice([" ", ". ", ", "]) + word(), items, int(label)))
    return out


_FITTED: dict[str, tuple[boosting.Boosted, dict[str, float]]] = {}


def fit_model(spark: SparkSession) -> tuple[boosting.Boosted, dict[str, float]]:
    """The trees over kind_no and the features, and the threshold of each kind; fitted once for an application."""
    app = spark.sparkContext.applicationId
    if app not in _FITTED:
        _FITTED[app] = _fit(spark)
    return _FITTED[app]


def _fit(spark: SparkSession) -> tuple[boosting.Boosted, dict[str, float]]:
    made = examples()
    lists = list(enumerate(list_examples(), len(made)))
    docs = spark.createDataFrame([(i, t) for i, t, *_ in made] + [(i, t) for i, (t, *_) in lists], "doc_id long, text string")
    names = ["kind_no", *features()]
    rows = spans(docs, GENERATORS).where("kind is not null").withColumns(features()).select("doc_id", "start", "end", F.col("k").alias("kind_no"), *names[1:]).collect()
    rows.sort()
    x = np.array([list(r)[3:] for r in rows], np.int64)
    where = {i: ([(a, z)], y) for i, _, a, z, y in made} | {i: (items, y) for i, (_, items, y) in lists}

    def private(r: Row) -> bool:
        """A part must be an item as a whole, and so must any candidate in a list."""
        items, y = where[r.doc_id]
        return bool(y) and ((r.start, r.end) in items or len(items) == 1 and not r.in_run and r.start < items[0][1] and r.end > items[0][0])

    y = np.array([private(r) for r in rows], np.float64)
    held = np.array([r.doc_id % 4 == 0 for r in rows])
    model = boosting.fit(x[~held], y[~held])
    odds = model.predict(x)
    limits = {k: boosting.threshold(odds[held & (x[:, 0] == KINDS.index(k))], y[held & (x[:, 0] == KINDS.index(k))], PRECISION) for k in GENERATORS if k not in CHECKED}
    return model, limits


def detect(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    model, limits = fit_model(docs.sparkSession)
    odds = model.sql(["kind_no", *features()])
    found = spans(docs, BASE | GENERATORS)
    is_base = F.col("k") < len(BASE)
    # Only rows that matter go on; each row of docs keeps at least one (the first match, or the null one).
    names = {n: c for n, c in features().items()}
    scored = found.withColumns({n: F.when(~is_base & F.col("kind").isNotNull(), c) for n, c in names.items()}).withColumn("kind_no", F.col("k"))
    limit = reduce(lambda a, k: F.when(F.col("kind") == k, F.lit(limits[k])).otherwise(a), limits, F.lit(0.0))
    scored = scored.withColumn("odds", F.when(F.col("kind").isin(*CHECKED), 1e6).when(~is_base & F.col("kind").isNotNull(), F.expr(odds))).withColumn("chosen", F.col("kind").isNotNull() & (is_base | (F.col("odds") >= limit)))
    rows = scored.select("rid", "doc_id", F.when(F.col("chosen"), F.col("kind")).alias("kind"), F.col("k"), F.col("start"), F.col("end"), F.when(F.col("chosen"), F.coalesce("odds", F.lit(1e9))).alias("odds"), (is_base & F.col("chosen")).alias("base"))

    # Stretches of overlapping spans; in each, best first, what overlaps nothing kept before stays (base ones always).
    by_row = Window.partitionBy("rid").orderBy(F.expr("kind is null"), "start", "end", "k")
    reach = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum(F.when(F.col("start") >= F.coalesce(reach, F.lit(-1)), 1).otherwise(0)).over(by_row.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("stretch", F.when(F.col("kind").isNotNull(), stretch))
    ranked = F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct((-F.col("odds")).alias("order"), "start", (-F.col("end")).alias("far"), "k", "end", "kind", "base"))))
    kind = "array<struct<order:double,start:bigint,far:bigint,k:int,end:bigint,kind:string,base:boolean>>"
    best = lambda kept, x: F.when(x["base"] | ~F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])), F.concat(kept, F.array(x))).otherwise(kept)
    grouped = marked.groupBy("rid", "stretch").agg(F.first("doc_id").alias("doc_id"), ranked.alias("ranked"))
    kept = grouped.select("rid", "doc_id", F.explode_outer(F.aggregate("ranked", F.array().cast(kind), best)).alias("x")).select("rid", "doc_id", "x.*")
    kept = kept.withColumns({"stays": F.col("kind").isNotNull(), "base": F.coalesce("base", F.lit(False))})

    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("start", "k", "end", "kind"))))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE]
    out = kept.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), *counts, listed(F.col("base")).alias("b"), listed(F.col("stays")).alias("s"))
    return out.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(joined(F.col("b")).cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
