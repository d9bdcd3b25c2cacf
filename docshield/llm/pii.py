"""Personal data: high-recall candidates, boosted trees, calibrated thresholds.

Native DataFrame functions and Spark ML only.  Base spans (e-mail, IPv4, card and phone
numbers by fixed patterns and checks) always stay.  Generators propose more spans of these
kinds, which overlap each other and the base ones: written-out or bracketed signs, letters
of any script, other separators, numbers without a plus, IPv6, and what a base match has run
into a neighbour and so lost.  Gradient-boosted trees give each candidate a probability from
its format (counts, separators, checksums, ranges) and context (neighbouring words and
characters).  For each kind the least probability is taken as threshold at which a
calibration half of the findings still reaches ``PRECISION``; a kind for which none does adds
nothing.  Of accepted candidates that overlap, the most probable stays; one that overlaps a
base span stays only if it holds that span and more.

Findings to learn from are, unless the caller gives some, candidates that equal a base span
(personal) and those that fail their kind's check (not), with rewritings of the former:
the same value in other notations, with a broken checksum or range, and named as a version,
an order or a file.  All distinct findings are used, halved by a hash of the value: those of equal features
are one row with their number.  In the fit, findings of a kind and label weigh ``KIND_WEIGHT`` together at most,
so that a frequent kind doesn't drown the others; thresholds go by their numbers.

Defined cases: a null or empty text has no spans; repeated rows are judged once each; a null
doc_id is kept; without findings of both labels nothing is added; an empty table gives no rows;
other columns are ignored.  Offsets are code points.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docshield.llm.common import cut

KINDS = ["email", "ip", "card", "phone"]
KIND_WEIGHT = 1000.0
PRECISION = 0.98

#: The base patterns, with possessive quantifiers and starts outside words where the matches are the same: their time is linear.
BASE = [
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9]){11,}+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
_WORD = r"[\p{L}\p{N}-]++"
_LOCAL = r"(?:(?<![\p{L}\p{N}._%+-])|\G)[\p{L}\p{N}._%+-]++"
_DOT = r"\x20?[\[({]\x20?(?i:dot|punkt|punto|point|\.)\x20?[\])}]\x20?|\x20(?i:dot|punkt|punto|point)\x20"
_AT = r"\x20?[\[({]\x20?(?i:at|@|arobase|arroba)\x20?[\])}]\x20?"
#: (kind, pattern) of the generators; what they propose is judged by the trees.
GENERATORS = [
    (0, rf"{_LOCAL}(?:(?:@|{_AT}){_WORD}(?:(?:\.|{_DOT}){_WORD})++|\x20(?i:at)\x20{_WORD}(?:(?:{_DOT}){_WORD})++)"),
    (1, r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:(?:\.|" + _DOT + r")[0-9]{1,3}){3}(?![\p{L}\p{N}])"),
    (1, r"(?<![\p{L}\p{N}:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])"),
    (2, r"(?<![\p{L}\p{N}])(?:[0-9]{4}(?:[\x20._/ -]{0,2}+[0-9]{4}){3}|3[47][0-9]{2}[\x20._/ -]{0,2}+[0-9]{6}[\x20._/ -]{0,2}+[0-9]{5})(?![\p{L}\p{N}])"),
    (3, r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    (3, r"(?<![\p{L}\p{N}.])(?:\+|00)[1-9](?:[\x20()./-]{0,2}+[0-9]){7,13}+(?![0-9])"),
]
#: A text without any of these has no span.
GATE = r"[0-9@]|(?i:[\[({]\x20?(?:at|arobase|arroba)\x20?[\])}]|\x20(?:dot|punkt|punto|point)\x20|[\[({]\x20?(?:dot|punkt|punto|point)\x20?[\])}])|::"
#: Words that stand before personal data, and before other numbers and names.
SPEAKS_FOR = [r"e-?mail|mail|contact|kontakt|correo|courriel|write\x20to|schreib", r"\bip\b|host|server|client|peer|login|address|adresse", r"card|karte|tarjeta|carte|visa|mastercard|amex|credit|kredit|payment",
              r"phone|tel|fon\b|call|mobile|cell|handy|fax|whatsapp|sms|ruf"]
SPEAKS_AGAINST = r"(?i)(?:version|release|build|firmware|\bv|sha-?[0-9]*|commit|hash|token|order|invoice|isbn|issn|serial|article|\bno|\bnr|#|page|section|file|image|icon|package)[\x20:.=#\"']{0,3}$"
#: Endings of file names, which no mail domain has.
FILES = "png|jpg|jpeg|gif|svg|js|css|py|html|json|txt|pdf|zip|md"
FEATURES = [*(f"is_{k}" for k in KINDS), "size", "digits", "groups", "odd", "checksum", "range", "first", "plus", "bracket", "labels", "ending", "filelike", "at_word", "for_it", "against", "glued_before", "glued_after", "hexlike"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 12 to 19 digits pass the checksum."""
    d = _digits(value)
    one = F.reverse(F.regexp_extract_all(d, F.lit("[0-9]"), F.lit(0)))
    twice = lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(2 * x.cast("int") - F.when(x.cast("int") > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(one, twice), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)


def octets(value: Column) -> Column:
    """Whether no number in it is over 255."""
    return F.forall(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))


def passes(kind: Column, value: Column) -> Column:
    """The check of each kind."""
    return F.when(kind == 0, True).when(kind == 1, octets(value)).when(kind == 2, luhn(value)).otherwise(F.length(_digits(value)).between(9, 15))


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, found (array of pattern, nth, gap, value, before, after): every match of every pattern; ``docs`` has doc_id and text."""
    patterns = [*BASE, *(p for _, p in GENERATORS)]
    held = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(F.col("text").rlike(GATE), F.col("text")).alias("gated"))
    held = held.select("*", *(F.when(F.col("gated").rlike(p), F.regexp_extract_all("gated", F.lit(p), F.lit(0))).alias(f"v{k}") for k, p in enumerate(patterns)))
    held = held.select("row", "doc_id", *(f"v{k}" for k in range(len(patterns))), *(F.when(F.col(f"v{k}").isNotNull(), F.split("gated", p, -1)).alias(f"g{k}") for k, p in enumerate(patterns)))

    def of(k: int) -> Column:
        gaps, values = F.col(f"g{k}"), F.col(f"v{k}")
        each = lambda i: F.struct(
            F.lit(k).alias("pattern"), i.alias("nth"), F.length(F.get(gaps, i)).alias("gap"), F.get(values, i).alias("value"),
            F.right(F.concat(F.coalesce(F.get(values, i - 1), F.lit("")), F.get(gaps, i)), F.lit(40)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(16)).alias("after"))
        return F.when(values.isNotNull(), F.transform(F.sequence(F.lit(0), F.size(values) - 1), each)).otherwise(F.array().cast(FOUND))
    return cut(held.select("row", "doc_id", F.concat(*(of(k) for k in range(len(patterns)))).alias("found")))


FOUND = "array<struct<pattern:int,nth:int,gap:int,value:string,before:string,after:string>>"


def located(held: DataFrame) -> DataFrame:
    """row, kind, base, start, end, value, before, after of the matches that may count: base ones that pass, and candidates."""
    kinds = F.array(*(F.lit(k) for k in [*range(4), *(k for k, _ in GENERATORS)]))
    m = held.select("row", F.explode("found").alias("m")).select("row", "m.*")
    ahead = Window.partitionBy("row", "pattern").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value").cast("long")
    m = m.withColumn("end", F.sum(F.col("gap") + size).over(ahead)).withColumn("start", F.col("end") - size).withColumn("kind", F.get(kinds, F.col("pattern"))).withColumn("base", F.col("pattern") < len(BASE))
    return cut(m.withColumn("passes", passes(F.col("kind"), F.col("value"))).where("passes OR NOT base").select("row", "kind", "base", "start", "end", "value", "before", "after", "passes").distinct())


def features(found: DataFrame) -> DataFrame:
    """``found`` (kind, value, before, after, ...) with the trees' features."""
    v, kind = F.col("value"), F.col("kind")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    count = lambda pattern: F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0))).cast("double")
    speaks = F.when(F.lit(False), False)
    for k, words in enumerate(SPEAKS_FOR):
        speaks = speaks.when(kind == k, F.col("before").rlike(f"(?i)(?:{words})"))
    made = {f"is_{k}": flag(kind == n) for n, k in enumerate(KINDS)} | {
        "size": F.least(F.length(v), F.lit(64)).cast("double"), "digits": F.least(F.length(_digits(v)), F.lit(40)).cast("double"), "groups": F.least(count("[0-9]+"), F.lit(40.0)),
        "odd": F.least(count(r"[^\p{L}\p{N}]"), F.lit(40.0)), "checksum": flag(luhn(v)), "range": flag((kind == 1) & octets(v)), "first": F.coalesce(F.left(_digits(v), F.lit(1)).try_cast("double"), F.lit(-1.0)),
        "plus": flag(v.rlike(r"^(\+|00)")), "bracket": flag(v.rlike(r"[\[({]")), "labels": F.least(count(r"\.|(?i:dot|punkt|punto|point)"), F.lit(10.0)),
        "ending": F.least(F.length(F.regexp_extract(v, r"(?<!\p{L})(\p{L}++)$", 1)), F.lit(40)).cast("double"), "filelike": flag(v.rlike(rf"(?i)\.(?:{FILES})$")), "at_word": flag(v.rlike(r"(?i)\x20at\x20")),
        "for_it": flag(speaks), "against": flag(F.col("before").rlike(SPEAKS_AGAINST)),
        "glued_before": flag(F.col("before").rlike(r"[\p{L}\p{N}]$")), "glued_after": flag(F.col("after").rlike(r"^[\p{L}\p{N}]")), "hexlike": flag(F.col("before").rlike(r"(?i)[0-9a-f]{6,}[^\p{L}\p{N}\s]?$")),
    }
    return found.withColumns(made)


def findings_of(found: DataFrame) -> DataFrame:
    """kind, value, before, after, label: findings to learn from, of ``found`` as located."""
    value, kind = F.col("value"), F.col("kind")
    at = ["row", "kind", "start", "end"]
    own = found.where("NOT base").join(found.where("base").select(*at).distinct(), at, "left_semi").select("kind", "value", "before", "after").withColumn("label", F.lit(1.0))
    fails = found.where("NOT base AND NOT passes").select("kind", "value", "before", "after").withColumn("label", F.lit(0.0))
    digits = _digits(value)
    last = F.right(value, F.lit(1)).try_cast("int")
    other = F.concat(F.expr("left(value, length(value) - 1)"), ((last + 1) % 10).cast("string"))  # breaks the checksum
    cut4 = F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1.")
    local, domain = F.regexp_extract(value, r"^([^@]*)@", 1), F.regexp_extract(value, r"@(.*)$", 1)
    new = lambda v, label, before=F.col("before"): F.struct(v.alias("value"), before.alias("before"), F.lit(label).alias("label"))
    text = F.lit
    rewritten = F.when(kind == 0, F.array(
        new(F.concat(local, text(" (at) "), F.regexp_replace(domain, r"\.", " (dot) ")), 1.0), new(F.concat(local, text("[at]"), domain), 1.0),
        new(F.concat(local, text(" at "), F.regexp_replace(domain, r"\.", " dot ")), 1.0), new(F.concat(text("ü"), value), 1.0),
        new(F.concat(local, text("@2x.png")), 0.0), new(F.concat(local, text("@1.2.3")), 0.0), new(F.concat(local, text("@file.js")), 0.0, text("package ")), new(F.concat(local, text(" at 3 dot 5")), 0.0),
    )).when(kind == 1, F.array(
        new(F.regexp_replace(value, r"\.", "[.]"), 1.0), new(F.regexp_replace(value, r"\.", " dot "), 1.0), new(value, 1.0, text("server ")), new(text("2001:db8:85a3:0:0:8a2e:370:7334"), 1.0),
        new(F.regexp_replace(value, "^[0-9]+", "512"), 0.0), new(F.regexp_replace(value, "^[0-9]+", "999"), 0.0), new(value, 0.0, text("version ")), new(value, 0.0, text("firmware v")),
    )).when(kind == 2, F.array(
        new(cut4, 1.0), new(F.regexp_replace(cut4, r"\.", "  "), 1.0), new(F.regexp_replace(cut4, r"\.", "_"), 1.0), new(digits, 1.0, text("card: ")),
        new(other, 0.0), new(F.regexp_replace(F.concat(F.expr("left(value, length(value) - 1)"), ((last + 3) % 10).cast("string")), " ", "."), 0.0), new(other, 0.0, text("order no. ")), new(digits, 0.0, text("serial ")),
    )).otherwise(F.array(
        new(F.regexp_replace(value, r"^\+[0-9] ?", ""), 1.0), new(F.regexp_replace(value, r"^\+", "00"), 1.0), new(F.regexp_replace(value, r"[\x20()-]+", "."), 1.0), new(value, 1.0, text("call ")),
        new(F.regexp_replace(value, r"^\+[0-9] ?", ""), 0.0, text("order no. ")), new(F.left(digits, F.lit(7)), 0.0), new(F.concat(digits, digits), 0.0), new(value, 0.0, text("isbn ")),
    ))
    derived = own.select("kind", "after", F.col("value").alias("source"), F.explode(rewritten).alias("x")).select("kind", "x.value", "x.before", "after", "x.label", "source")
    return own.withColumn("source", value).unionByName(fails.withColumn("source", value)).unionByName(derived)


def _counted(findings: DataFrame) -> DataFrame:
    """learn (the half), kind, label, the features and n, the number of distinct findings that have them."""
    source = F.col("source") if "source" in findings.columns else F.col("value")
    rows = findings.groupBy("kind", "value", "before", "after", "label").agg(F.min(F.pmod(F.xxhash64(source), F.lit(2)) == 0).alias("learn"))
    held = features(rows).groupBy("learn", "kind", "label", *FEATURES).agg(F.count(F.lit(1)).alias("n"))
    # sums in the same order on every run: splits of equal gain are told apart by their last bits
    return cut(held.coalesce(2).sortWithinPartitions("learn", "kind", "label", *FEATURES))


def thresholds(judged: DataFrame, precision: float = PRECISION) -> dict[int, float]:
    """For each kind the least probability from which up the share of personal ones is ``precision`` or more; ``judged`` has kind, label, p[, n]."""
    n = F.col("n") if "n" in judged.columns else F.lit(1)
    at = judged.groupBy("kind", "p").agg(F.sum(n).alias("n"), F.sum(n * F.col("label")).alias("personal"))
    upto = Window.partitionBy("kind").orderBy(F.col("p").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # half way to the next probability below: the calibration half has nothing between
    lower = F.lead("p").over(Window.partitionBy("kind").orderBy(F.col("p").desc()))
    share = at.withColumns({"share": F.sum("personal").over(upto) / F.sum("n").over(upto), "bar": F.greatest((F.col("p") + F.coalesce(lower, F.col("p"))) / 2, F.lit(0.5))})
    return {r[0]: r[1] for r in share.where((F.col("share") >= precision) & (F.col("p") >= 0.5)).groupBy("kind").agg(F.min("bar")).collect()}  # a row for each kind


def model(findings: DataFrame, kind_weight: float = KIND_WEIGHT, precision: float = PRECISION):
    """The fitted trees and the thresholds, or None where the findings have one label only."""
    counted = _counted(findings)
    totals = counted.groupBy("learn", "kind", "label").agg(F.sum("n").alias("total"))  # a row for each half, kind and label
    if {(r[0], r[1]) for r in totals.select("learn", "label").distinct().collect()} != {(a, b) for a in (True, False) for b in (0.0, 1.0)}:
        return None
    weight = F.col("n") * F.least(F.lit(1.0), F.lit(kind_weight) / F.col("total"))
    made = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(counted.join(F.broadcast(totals), ["learn", "kind", "label"]).withColumn("weight", weight))
    trees = GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=10, maxDepth=4, stepSize=0.3, seed=13).fit(made.where("learn").select("vector", "label", "weight"))
    judged = trees.transform(made.where("NOT learn")).select("kind", "label", "n", vector_to_array("probability")[1].alias("p"))
    return trees, thresholds(judged, precision)


def scored(found: DataFrame, fitted) -> DataFrame:
    """``found`` with ``p`` and ``personal``: whether p reaches its kind's threshold."""
    trees, least = fitted
    out = trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(features(found)))
    bar = F.when(F.lit(False), 2.0)
    for k, p in least.items():
        bar = bar.when(F.col("kind") == k, p)
    p = vector_to_array("probability")[1]
    return out.select(*found.columns, p.alias("p"), (p >= bar.otherwise(2.0)).alias("personal"))


def spans(docs: DataFrame, findings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document and (row, kind, base, start, end, p) of every span; ``docs`` has doc_id and text."""
    held = matches(docs)
    found = located(held)
    base = found.where("base").select("row", "kind", "base", "start", "end").distinct()
    none = base.withColumn("p", F.lit(1.0))
    fitted = model(findings_of(found) if findings is None else findings)
    if fitted is None:
        return held.select("row", "doc_id"), none
    both = scored(found.where("NOT base"), fitted).where("personal").select("row", "kind", "base", "start", "end", "p").unionByName(none)
    # a candidate that overlaps a base span counts only if it holds the first such span, and more
    ahead, behind = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.col("start").desc())
    is_base = lambda c: F.when(F.col("base"), c)
    reach = F.max(is_base(F.col("end"))).over(ahead.rangeBetween(Window.unboundedPreceding, -1))
    first = F.min(is_base(F.struct("start", "end"))).over(behind.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumns({"reach": reach, "first": first})
    apart, holds = F.col("first.start") >= F.col("end"), (F.col("first.end") <= F.col("end")) & ((F.col("first.start") > F.col("start")) | (F.col("first.end") < F.col("end")))
    added = both.where(~F.col("base") & (F.coalesce(F.col("reach"), F.lit(0)) <= F.col("start")) & (F.col("first").isNull() | apart | holds)).drop("reach", "first")
    # of accepted candidates that overlap, the most probable stays
    in_order = Window.partitionBy("row").orderBy("start", "end", "kind")
    before = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    edge = F.when(F.coalesce(before, F.lit(0)) > F.col("start"), 0).otherwise(1)
    added = added.withColumn("edge", edge).withColumn("run", F.sum("edge").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.row_number().over(Window.partitionBy("row", "run").orderBy(F.col("p").desc(), (F.col("end") - F.col("start")).desc(), "start", "kind"))
    added = added.withColumn("place", place).where("place = 1").drop("edge", "run", "place")
    return held.select("row", "doc_id"), cut(none.unionByName(added))


def personal_data(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    rows, found = spans(docs, findings)
    name = F.get(F.array(*(F.lit(k) for k in KINDS)), F.col("kind"))
    found = found.withColumn("told", F.struct("start", "kind", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("text")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["text"]), ",")
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    told = found.groupBy("row").agg(*(n(F.col("base") & (F.col("kind") == k), f"n_{name}") for k, name in enumerate(KINDS)), n(~F.col("base"), "n_added"),
                                    listed(F.when(F.col("base"), F.col("told"))).alias("base_text"), listed(F.col("told")).alias("spans"))
    out = rows.join(told, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *(zero(f"n_{k}") for k in KINDS), F.sha2(F.coalesce("base_text", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_added"))
