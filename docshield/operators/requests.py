"""Request-side checks and dictionary joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docshield import constants as C
from docshield.operators.search import bounded_rows

BROADCAST_MAX_DICT = 1_000_000


def validate_queries(q: DataFrame) -> DataFrame:
    """Trimmed query 3..2000 chars, ids match the id pattern, top_k 1..20.
    Adds ``query`` (trimmed), ``valid`` and the first failing ``reject_reason``."""
    t = F.trim(F.col("query"))
    reason = (F.when(t.isNull() | (F.length(t) < C.QUERY_MIN_CHARS) | (F.length(t) > C.QUERY_MAX_CHARS), "query_length")
              .when(~F.coalesce(F.col("user_id").cast("string").rlike(C.ID_PATTERN), F.lit(False)), "user_id")
              .when(~F.coalesce(F.col("tenant_id").rlike(C.ID_PATTERN), F.lit(False)), "tenant_id")
              .when(~F.col("top_k").between(C.TOP_K_MIN, C.TOP_K_MAX), "top_k"))
    return q.withColumn("query", t).withColumn("reject_reason", reason) \
        .withColumn("valid", F.col("reject_reason").isNull())


def check_claims(claims: DataFrame, principals: DataFrame) -> DataFrame:
    """The claimed user/tenant must be the session's and the claimed roles
    a subset of the granted ones.  ``claims(request_id, user_id, tenant_id,
    roles)``, ``principals(user_id, tenant_id, roles)``."""
    p = principals.select("user_id", F.col("tenant_id").alias("p_tenant"), F.col("roles").alias("granted"))
    j = claims.join(p, "user_id", "left")
    extra = F.array_except("roles", F.coalesce("granted", F.array().cast("array<string>")))
    reason = (F.when(F.col("p_tenant").isNull(), "unknown_user")
              .when(F.col("p_tenant") != F.col("tenant_id"), "tenant_mismatch")
              .when(F.size(extra) > 0, "role_not_granted"))
    return j.select("request_id", "user_id", "tenant_id", reason.alias("reject_reason"),
                    F.array_sort(extra).alias("ungranted_roles"))


GRAM = 8  # characters of a token's key; shorter tokens are their own key


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, found by looking ahead from every place (``substring`` would count from the start each time)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def token_keys(tokens: DataFrame, n: int = GRAM) -> DataFrame:
    """(token, gram): each distinct token with the one of its grams that the fewest tokens have, so that tokens which
    begin alike are told apart by what differs."""
    t = tokens.select("token").where(F.length("token") > 0).distinct()
    each = t.select("token", F.explode(F.when(F.length("token") < n, F.array("token")).otherwise(grams(F.col("token"), n))).alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return each.join(often, "gram").groupBy("token").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))


def canary_join(texts: DataFrame, tokens: DataFrame, text_col: str = "response", key: str = "query_id") -> DataFrame:
    """(text row, token) pairs where the token occurs in the text, for token tables of any size.

    A token stands under its rarest gram; the grams of the texts meet these by an equi-join,
    and only texts that hold a token's gram are searched for it.  The texts themselves are
    joined once, to their candidates.  Null texts and empty or null tokens give no pairs; a repeated
    token is one token; rows that share ``key`` are searched for the candidates of all of them.
    """
    keys = token_keys(tokens)
    sizes = sorted(r[0] for r in keys.select(F.length("gram").alias("n")).distinct().collect())  # GRAM numbers at most
    if not sizes:
        return texts.withColumn("token", F.lit(None).cast("string")).where("false")
    text = F.col(text_col)
    found = texts.select(F.col(key).alias("_key"), F.explode(F.concat(*(grams(text, n) for n in sizes))).alias("gram")).join(keys, "gram").select("_key", "token").distinct()
    return texts.join(found, F.col(key).eqNullSafe(F.col("_key"))).where(F.contains(text, F.col("token"))).drop("_key")


def word_ngrams(text: Column, sizes) -> Column:
    """array<struct<name,start,end>>: every run of n words, n in ``sizes``, as it stands in the text.

    Words are runs of letters, digits and ``_``.  What stands between the words
    of a run belongs to it, so ``Ana. Li`` is not ``Ana Li`` and an apostrophe
    may stand inside a name.  Offsets are 0-based code points, end exclusive."""
    from docshield.functions.text import WORD, regex_matches
    from docshield.functions.vectors import let

    def runs(w, gaps, n):
        def run(i):
            parts = [F.get(w, i)["value"]]
            for k in range(1, n):
                parts += [F.get(gaps, i + k), F.get(w, i + k)["value"]]
            return F.struct(F.concat(*parts).alias("name"), F.get(w, i)["start"].alias("start"), F.get(w, i + (n - 1))["end"].alias("end"))
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), run)) \
            .otherwise(F.array().cast("array<struct<name:string,start:int,end:int>>"))

    return let(regex_matches(text, f"{WORD}+", F.lit(True)),
               lambda w: let(F.split(text, f"{WORD}+", -1), lambda gaps: F.concat(*[runs(w, gaps, n) for n in sizes])))


def gazetteer_spans(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dictionary entities by an n-gram equi-join (scales past the
    regex-alternation path, with the same matches: a name stands in the text as
    it is written, between word boundaries).  Output: (key, entity_type, name,
    start, end).

    The run lengths are those of the dictionary's own names.  Characters
    before a name's first and after its last word are not part of it."""
    from docshield.functions.text import WORD
    bare = F.regexp_extract("name", f"{WORD}(?:.*{WORD})?", 0)
    g = gazetteer.select(bare.alias("_gram"), "name", "entity_type").where("_gram <> ''").distinct()
    sizes = [r[0] for r in g.select(F.size(F.regexp_extract_all("_gram", F.lit(f"{WORD}+"), F.lit(0))).alias("n")).distinct().collect()]
    if not sizes:
        return docs.select(key, F.lit("").alias("entity_type"), F.lit("").alias("name"), F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    grams = docs.select(key, F.explode(word_ngrams(F.col(text_col), sorted(sizes))).alias("x")) \
        .select(key, F.col("x.name").alias("_gram"), "x.start", "x.end")
    if bounded_rows(g, BROADCAST_MAX_DICT) <= BROADCAST_MAX_DICT:
        g = F.broadcast(g)
    return grams.join(g, "_gram").select(key, "entity_type", "name", "start", "end")


def gazetteer_join(docs: DataFrame, gazetteer: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of ``gazetteer_spans``: (key, entity_type, name, n)."""
    return gazetteer_spans(docs, gazetteer, key, text_col).groupBy(key, "entity_type", "name").agg(F.count(F.lit(1)).alias("n"))
