"""Secret scan: candidates by pattern, false positives removed by a random forest.

Native DataFrame functions and Spark ML only.  Candidates are private-key blocks,
connection strings, dotted JWTs, providers' tokens, values of 8 or more characters that are
assigned to a credential's name, and every run of 16 or more key characters.  A candidate's features are length, character classes and transitions,
dictionary coverage, path signs and the neighbouring words; a random forest trained from
labelled findings gives the probability that it is a secret; without findings of the
caller's, a fixed format is a secret (1.0) whatever the forest says.

``labelled`` turns candidates into findings with labels: those in a provider's fixed
format or assigned to a credential's name are secrets; plain words, digests and parts of
paths are not; of the others nothing is known and they are left out.  Each labelled
secret also gives two counter-examples, the same value named as a checksum and as part
of a path.  The forest is fitted on at most ``FIT_ROWS`` findings of each label, taken by
hash order; everything else covers all rows.

Defined cases: a null or empty text has no candidates; a null doc_id is kept as null;
repeated rows give their findings once each; if the findings have one label only, it is
given to all candidates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docshield.llm.common import cut, with_row

#: Formats of well-known providers' keys.
PROVIDERS = (r"(?<![A-Z0-9])(AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}|(?<![A-Za-z0-9])(gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|xox[abprs]-[A-Za-z0-9-]{10,}"
             r"|sk[-_](live_|test_|proj-)?[A-Za-z0-9]{20,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,})")
#: A block with its end, or a cut-off one with the lines that follow its header.
KEY_BLOCK = (r"-----BEGIN (?:[A-Z0-9]{1,12} ){0,4}PRIVATE KEY(?: BLOCK)?-----(?:[^-]*+(?:-(?!----)[^-]*+){0,200}+-----END (?:[A-Z0-9]{1,12} ){0,4}PRIVATE KEY(?: BLOCK)?-----"
             r"|(?:(?:\\[nr]|\s){0,4}[A-Za-z0-9+/]{40,}+={0,2}+){0,400})")
CONNECTION = (r"(?<![A-Za-z0-9])(?i:(?:mongodb|postgres|postgresql|mysql|mariadb|redis|rediss|amqp|amqps|mssql)(?:\+[a-z0-9]{1,12})?://[^\s\"'<>]++"
              r"|[a-z][a-z0-9+.]{1,20}://[^\s:/@\"'<>]{0,64}:[^\s/@\"'<>]{1,128}@[^\s\"'<>]++)")
JWT = r"(?<![A-Za-z0-9_+/\-])eyJ[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]++"
FIXED = "|".join([KEY_BLOCK, CONNECTION, JWT, PROVIDERS])
#: A value of a credential's name: after a sign for any name, after white space for passwords; the look-behinds are bounded.
ASSIGNED = (r"(?<=[\s\"'=:>])(?:(?<=(?i:password|passwd|pwd)[\s\"':=]{1,8})|(?<=(?i:passphrase|pass|secret|tokens?|credentials?|auth|api[_-]?key|access[_-]?key|private[_-]?key)"
            r"[\"']?\s{0,3}[=:]{1,2}>?\s{0,3}[\"']?)|(?<=(?i:bearer)[\s:=]{1,3}))[^\s\"'=:>][^\s\"']{7,}+")
#: A run of key characters; the look-behind lets the search begin at a run's start only.
RUN = r"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{16,}+={0,2}+"
CANDIDATE = "|".join([KEY_BLOCK, CONNECTION, JWT, ASSIGNED, r"(?<![A-Za-z0-9_+/\-])xox[abprs]-[A-Za-z0-9-]{10,}+", RUN])
FIT_ROWS = 10_000
MASK = "[SECRET]"
NAMED = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|credentials?|auth|api[_-]?key|access[_-]?key|private[_-]?key|bearer)(?:[\"']?\s{0,3}[=:\s]{1,2}>?\s{0,3}[\"']?)$|(?i)(password|passwd|pwd)[\s\"':=]{1,8}$"
#: Words, names and sentences' ends: letters in one case (or a capital first), joined by hyphens, underscores or slashes.
WORDS = r"^[_/+\-]*+(?:(?:\p{Lu}?\p{Ll}{2,}+|\p{Lu}{2,}+)[_/+\-]*+)++[=.,;:!?)\]]*+$"
DIGESTS = r"(?i)(sha-?\d*|md5|commit|checksum|digest|hash|etag|uuid|revision|integrity)[\"']?\s{0,3}[=: ]{0,2}\s{0,3}[\"']?$"
#: Frequent words and word parts of the corpus languages.
DICTIONARY = ("the and ing tion ment able ness ful less ight ough this that with from have "
              "heit keit ung lich sch ein ich ver ber gen der die das und ent "
              "eau eux elle ique ion que pour dans est ier tre "
              "cion mente ado ada que los las para con esto").split()
FEATURES = ["size", "digits", "upper", "lower", "other", "turns", "variety", "vowels", "known", "hex", "path", "named", "digest", "assigned", "quoted", "format"]


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, nth, value, before, after, start and length (characters) of every candidate; ``docs`` has row, doc_id, text."""
    at = F.sequence(F.lit(0), F.size("found") - 1)
    # what is before is the text's own, the previous candidate with it: a credential's long name is a candidate itself
    found = docs.where(F.col("text").rlike(CANDIDATE)).select("row", "doc_id", F.split("text", CANDIDATE, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("found"))
    one = lambda i: F.struct(i.alias("nth"), F.get("found", i).alias("value"), F.right(F.concat(F.coalesce(F.get("found", i - 1), F.lit("")), F.get("gaps", i)), F.lit(48)).alias("before"), F.left(F.get("gaps", i + 1), F.lit(24)).alias("after"), F.length(F.get("gaps", i)).cast("long").alias("gap"))
    found = found.select("row", "doc_id", F.explode(F.transform(at, one)).alias("x")).select("row", "doc_id", "x.*")
    ahead = Window.partitionBy("row").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value").cast("long")
    return found.select("row", "doc_id", "nth", "value", "before", "after", (F.sum(F.col("gap") + size).over(ahead) - size).alias("start"), size.alias("length"))


def features(found: DataFrame) -> DataFrame:
    """``found`` (value, before, after, ...) with the forest's features."""
    v, n = F.col("value"), F.length("value")
    share = lambda pattern: F.length(F.regexp_replace(v, F.lit(pattern), F.lit(""))) / n  # noqa: E731  of what the pattern leaves
    flag = lambda c: c.cast("double")
    made = {
        "size": n.cast("double"), "digits": share("[^0-9]"), "upper": share("[^A-Z]"), "lower": share("[^a-z]"), "other": share("[A-Za-z0-9]"),
        "turns": F.length(F.regexp_replace(v, F.lit("[a-z]++|[A-Z]++|[0-9]++|[^A-Za-z0-9]++"), F.lit("#"))) / n,
        "variety": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64)),
        "vowels": share("[^AEIOUaeiou]"),
        "known": 1 - F.length(F.regexp_replace(F.lower(v), F.lit("|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))), F.lit(""))) / n,
        "hex": flag(v.rlike("^[0-9a-fA-F]+$")),
        "path": flag(v.rlike("/.*/|^/") | F.col("before").rlike(r"[/\\.~]$") | F.col("after").rlike(r"^(\.[a-z]{2,5}\b|[\\/])")),
        "named": flag(F.col("before").rlike(NAMED)), "digest": flag(F.col("before").rlike(DIGESTS)),
        "assigned": flag(F.col("before").rlike("[=:]\\s*[\"']?$")), "quoted": flag(F.col("after").rlike("^[\"']")),
        "format": flag(v.rlike(FIXED)),
    }
    return found.withColumns(made)


def known_label() -> Column:
    """1 for a fixed format or a value assigned to a credential's name, 0 for plain words, digests and parts of paths, null where nothing is known."""
    value, before, named = F.col("value"), F.col("before"), F.col("before").rlike(NAMED)
    signed = before.rlike("[=:]>?\\s*[\"']?$")
    path = value.rlike("^/|/.*/") | before.rlike(r"[/\\.~]$") | F.col("after").rlike(r"^(\.[a-z]{2,5}\b|[\\/])")
    return (F.when(value.rlike(FIXED) | (named & value.rlike("[0-9]")), 1.0)
            .when(named & signed, F.lit(None).cast("double"))
            .when(value.rlike(WORDS) | before.rlike(DIGESTS) | path, 0.0))


def labelled(found: DataFrame) -> DataFrame:
    """value, before, after, label: findings to learn from."""
    own = found.select("value", "before", "after", known_label().alias("label")).where("label IS NOT NULL")
    wrong = own.where("label = 1").select("value", F.explode(F.array(
        F.struct(F.lit("commit ").alias("before"), F.lit(" ").alias("after")), F.struct(F.lit("/usr/share/").alias("before"), F.lit("/index.html").alias("after")))).alias("x"))
    return own.unionByName(wrong.where(~F.col("value").rlike(FIXED)).select("value", "x.before", "x.after", F.lit(0.0).alias("label")))


def scored(found: DataFrame, findings: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """``found`` with ``p_secret`` by a forest trained on ``findings`` (value, before, after, label)."""
    order = F.xxhash64("value", "before", "after")
    parts = [findings.where(F.col("label") == k).orderBy(order, "value", "before").limit(fit_rows) for k in (0.0, 1.0)]
    sample = cut(parts[0].unionByName(parts[1]))
    seen = [r[0] for r in sample.select("label").distinct().collect()]
    if len(seen) < 2:
        return found.withColumn("p_secret", F.lit(float(seen[0]) if seen else 0.0))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="vector")
    forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=24, maxDepth=8, minInstancesPerNode=2, featureSubsetStrategy="sqrt", seed=11)
    model = forest.fit(vector.transform(features(sample)))
    out = model.transform(vector.transform(features(found)))
    return out.select(*found.columns, vector_to_array("probability")[1].alias("p_secret"))


def secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: row, doc_id, nth, value, start, length, kind, p_secret, secret.  ``docs`` has row, doc_id, text."""
    found = cut(candidates(docs))
    value = F.col("value")
    kind = F.when(value.rlike("^(?:" + KEY_BLOCK + ")"), "key").when(value.rlike("^(?:" + CONNECTION + ")"), "connection").when(value.rlike(JWT), "jwt").when(
        value.rlike(PROVIDERS), "provider").when(F.col("before").rlike(NAMED), "named").otherwise("run")
    out = scored(found, labelled(found) if findings is None else findings)
    if findings is None:
        out = out.withColumn("p_secret", F.when(value.rlike(FIXED), 1.0).otherwise(F.col("p_secret")))
    return out.select("row", "doc_id", "nth", "value", "start", "length", kind.alias("kind"), "p_secret", (F.col("p_secret") >= threshold).alias("secret"))


def redacted(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """The documents with every secret replaced by MASK; other columns as they are (``n_chars`` follows the text).
    Input columns may have any name, this module's own included.  Null and empty texts stay; repeated rows stay, each for itself."""
    names = docs.columns
    inner = [n if n in ("doc_id", "text") else f"_c{k}" for k, n in enumerate(names)]
    held = with_row(docs.toDF(*inner), "_row")
    hit = secrets(held.select(F.col("_row").alias("row"), "doc_id", "text"), findings).groupBy(F.col("row").alias("_row")).agg(
        F.max("secret").alias("any"), F.transform(F.array_sort(F.collect_list(F.struct("nth", "secret"))), lambda x: x["secret"]).alias("_flags")).where("any").drop("any")
    some = F.col("text").rlike(CANDIDATE)
    gaps, found = F.split("text", CANDIDATE, -1), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    part = lambda i: F.concat(F.get("_gaps", i), F.when(F.get("_flags", i), F.lit(MASK)).otherwise(F.coalesce(F.get("_found", i), F.lit(""))))
    changed = held.where(some).join(hit.hint("merge"), "_row", "left")
    own = F.col("_flags").isNotNull()
    changed = changed.withColumns({"_gaps": F.when(own, gaps), "_found": F.when(own, found)})
    text = F.when(own, F.concat_ws("", F.transform(F.sequence(F.lit(0), F.size("_found")), part))).otherwise(F.col("text"))
    out = held.where(F.coalesce(~some, F.lit(True))).select(*inner).unionByName(changed.withColumn("text", text).select(*inner)).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out
