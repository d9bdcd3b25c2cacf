"""Content-scanning expressions (Column in, Column out).

Everything here is a built-in Spark expression (regex, higher-order array
functions), so it runs inside the JVM row pipeline with no Python UDF and no
shuffle.  Match offsets come from the split trick: for a positive-width
pattern, ``regexp_extract_all`` and ``split`` use the same matcher, so the
start of match *i* is the total length of the first *i+1* split pieces plus
the first *i* matches.  Offsets are 0-based code points, end exclusive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from docshield import constants as C

WORD = r"[\p{L}\p{N}_]"

# A leftmost match of WORD*...WORD* never starts inside a word.  Saying so lets the
# matcher try a long token once instead of once per character; results are the same.
NOT_INSIDE_WORD = f"(?:(?<!{WORD})|(?!{WORD}))"

SPAN_TYPE = ("array<struct<entity_type:string,start:int,end:int,score:double,"
             "severity:string>>")
SECRET_TYPE = "array<struct<type:string,preview:string,start:int,end:int,severity:string>>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# Zero-width characters and phrases
# ---------------------------------------------------------------------------

def _contains(hay: Column, needle: Column) -> Column:
    return F.contains(hay, needle)


def zero_width_found(text) -> Column:
    t = _col(text)
    return F.filter(F.array(*[F.lit(z) for z in C.ZERO_WIDTH_CHARS]), lambda z: _contains(t, z))


def strip_zero_width(text) -> Column:
    return F.translate(_col(text), "".join(C.ZERO_WIDTH_CHARS), "")


def phrases_found(lowered, phrases) -> Column:
    """Phrases (lower-case literals) contained in an already lower-cased text."""
    from docshield.functions.vectors import let
    return let(_col(lowered), lambda t: F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: _contains(t, p)))


def phrases_found_any(lowered, phrases) -> Column:
    return F.size(phrases_found(lowered, phrases)) > 0


def count_present(text, needles) -> Column:
    from docshield.functions.vectors import let
    return let(_col(text), lambda t: F.size(F.filter(F.array(*[F.lit(p) for p in needles]), lambda p: _contains(t, p))))


# ---------------------------------------------------------------------------
# Regex matches with offsets
# ---------------------------------------------------------------------------

MATCH_TYPE = "array<struct<value:string,start:int,end:int>>"
FOLD_BLOCK = 32


def regex_matches(text, pattern: str, guard=None) -> Column:
    """array<struct<value,start,end>> of all non-overlapping matches.

    Lengths of the pieces and matches are summed in two levels, within blocks
    of ``FOLD_BLOCK`` matches and over the blocks, so the work grows with the
    number of matches and not with its square.
    """
    from docshield.functions.vectors import let
    t = _col(text)
    m = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    g = F.split(t, pattern, -1)
    pairs = F.zip_with(F.slice(g, F.lit(1), F.size(m)), m,
                       lambda a, b: F.struct(F.length(a).alias("gl"), b.alias("m")))

    def step(acc, p):
        st = acc["pos"] + p["gl"]
        en = st + F.length(p["m"])
        return F.struct(en.alias("pos"), F.concat(acc["out"], F.array(F.struct(
            p["m"].alias("value"), st.cast("int").alias("start"), en.cast("int").alias("end")))).alias("out"))

    def from_zero(ps):
        return F.aggregate(ps, F.struct(F.lit(0).alias("pos"), F.array().cast(MATCH_TYPE).alias("out")), step)

    def blocks(ps):
        at = F.sequence(F.lit(0), F.floor((F.size(ps) - 1) / FOLD_BLOCK).cast("int"))
        return F.transform(at, lambda b: from_zero(F.slice(ps, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK))))

    def placed(bs):
        starts = F.aggregate(bs, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["pos"])))
        shift = lambda b, st: F.transform(b["out"], lambda x: F.struct(
            x["value"].alias("value"), (x["start"] + st).alias("start"), (x["end"] + st).alias("end")))
        return F.flatten(F.zip_with(bs, let(starts, lambda st: F.slice(st, F.lit(1), F.size(bs))), shift))

    found = let(pairs, lambda ps: F.when(F.size(ps) <= FOLD_BLOCK, from_zero(ps)["out"]).otherwise(let(blocks(ps), placed)))

    # a cheap guard (a literal or the bare entity shape) keeps the full
    # extraction, split and fold off rows that cannot match
    if isinstance(guard, Column):
        g_ok = guard
    elif guard and guard.startswith("="):
        g_ok = F.contains(t, F.lit(guard[1:]))
    else:
        g_ok = t.rlike(guard or pattern)
    return F.when(g_ok, found).otherwise(F.array().cast(MATCH_TYPE))


# ---------------------------------------------------------------------------
# Secrets (T5)
# ---------------------------------------------------------------------------

def secret_patterns(include_generic: bool = False):
    pats = list(C.SECRET_PATTERNS)
    if include_generic:
        pats.append(C.GENERIC_TOKEN_PATTERN)
    return [(n, ("(?i)" + p) if ci else p) for n, p, ci in pats]


# Cheap pre-tests (a substring every match contains); patterns without one
# are guarded by themselves.  Our choice, not reproduced values.
SECRET_GUARDS = {"openai_key": "=sk-", "github_token": "=ghp_", "jwt": "=eyJ",
                 "private_key": "=-----BEGIN ", "connection_string": "=://", "generic_token": "=token"}


def secret_scan(text, include_generic: bool = False) -> Column:
    def hit(name):
        return lambda x: F.struct(
            F.lit(name).alias("type"),
            F.concat(F.substring(x["value"], 1, C.SECRET_PREVIEW_CHARS), F.lit("***")).alias("preview"),
            x["start"].alias("start"), x["end"].alias("end"),
            F.lit("critical").alias("severity"))

    t = _col(text)
    column_guards = {
        "aws_key": F.exists(F.array(*[F.lit(x) for x in ("AKIA", "AGPA", "AIDA", "AROA")]),
                            lambda x: F.contains(t, x)),
        "password_field": phrases_found_any(F.lower(t), ("password", "passwd", "pwd")),
    }
    return F.concat(*[F.transform(regex_matches(t, pat, column_guards.get(name, SECRET_GUARDS.get(name))), hit(name))
                      for name, pat in secret_patterns(include_generic)])


def mask_secret(value, show_chars: int = 4) -> Column:
    v = _col(value)
    return F.when(F.length(v) <= show_chars, F.lit("***")).otherwise(
        F.concat(F.substring(v, 1, show_chars), F.lit("***")))


# ---------------------------------------------------------------------------
# PII recognisers (T6, 2.3.1)
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Recognizer:
    entity: str
    core: str                 # the entity shape
    score: float              # score before validation / context
    wrap: bool = True         # require word boundaries around the match
    validator: str | None = None   # luhn | ipv4 | ssn | dea | iban | crypto
    context: tuple = field(default=())  # words that lift the score by CONTEXT_BOOST
    literal: str | None = None          # a substring every match contains
    needs_digit: bool = True            # every match contains a digit
    linear: str | None = None           # the same matches as ``core``, without recursion and restarts inside a run

    @property
    def pattern(self) -> str:
        return f"{WORD}*(?:{self.core}){WORD}*" if self.wrap else self.core

    @property
    def scan_pattern(self) -> str:
        """``pattern`` as Spark runs it: the same matches without retrying inside words."""
        return self.linear or (NOT_INSIDE_WORD + self.pattern if self.wrap else self.core)

    @property
    def guard(self) -> str:
        """Cheap pre-test: '=literal' for a substring test, else the bare shape."""
        return f"={self.literal}" if self.literal else self.core


CONTEXT_BOOST = 0.35
CONTEXT_WINDOW = 40

# An e-mail address for a backtracking matcher: its core retries the local part at every character of a run and
# descends once for each domain label.  Here a match starts where a run does, or where the last match ended; a label that
# can end the address begins with two letters, and labels are taken without going back, each run of others looked over twice.
_MAIL_LOCAL, _MAIL_LABEL = r"[\p{L}\p{N}._%+\-]", r"[\p{L}\p{N}\-]++"
_MAIL_OTHER = rf"(?:\.(?![A-Za-z]{{2}}){_MAIL_LABEL})*+"
MAIL_LINEAR = (rf"(?:(?<!{_MAIL_LOCAL})|\G){_MAIL_LOCAL}++@{_MAIL_LABEL}"
               rf"(?:{_MAIL_OTHER}\.(?=[A-Za-z]{{2}}){_MAIL_LABEL}(?={_MAIL_OTHER}\.[A-Za-z]{{2}}))*+{_MAIL_OTHER}\.[A-Za-z]{{2,}}+")

# Our recognisers, written from public format rules (see README).
RECOGNIZERS = [
    Recognizer("EMAIL_ADDRESS",
               r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)*\.[A-Za-z]{2,}",
               1.0, wrap=False, literal="@", needs_digit=False, linear=MAIL_LINEAR),
    Recognizer("URL", r"(?:https?://|www\.)[^\s<>\"'()\[\]{}]+", 0.5, wrap=False,
               context=("url", "website", "link", "site", "web"), needs_digit=False),
    Recognizer("IP_ADDRESS", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 1.0, validator="ipv4"),
    Recognizer("PHONE_NUMBER", r"(?:\+1[ .\-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-][0-9]{4}",
               0.4, context=("phone", "number", "telephone", "cell", "cellphone", "mobile",
                             "call", "tel", "fax")),
    Recognizer("CREDIT_CARD",
               r"(?:4[0-9]{3}|5[0-5][0-9]{2}|6[0-9]{3}|1[0-9]{3}|3[0-9]{3})[ \-]?[0-9]{3,4}[ \-]?[0-9]{3,4}[ \-]?[0-9]{3,5}",
               0.3, validator="luhn"),
    Recognizer("US_SSN", r"[0-9]{3}[ .\-][0-9]{2}[ .\-][0-9]{4}", 0.5, validator="ssn",
               context=("ssn", "social security", "social", "security")),
    Recognizer("US_PASSPORT", r"[A-Z][0-9]{8}|[0-9]{9}", 0.4, context=("passport",)),
    Recognizer("US_DRIVER_LICENSE", r"[A-Z][0-9]{7,12}", 0.4,
               context=("driver", "license", "licence", "dl")),
    Recognizer("IN_PAN", r"[A-Z]{5}[0-9]{4}[A-Z]", 0.85),
    Recognizer("IN_AADHAAR", r"[2-9][0-9]{3}[ \-][0-9]{4}[ \-][0-9]{4}|[2-9][0-9]{11}", 0.85),
    Recognizer("MEDICAL_LICENSE", r"[A-Za-z][A-Za-z9][0-9]{7}", 0.4, validator="dea"),
    Recognizer("IBAN_CODE", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?", 0.5,
               validator="iban"),
    Recognizer("CRYPTO", r"bc1[ac-hj-np-z02-9]{11,71}|[13][1-9A-HJ-NP-Za-km-z]{25,34}", 0.5,
               validator="crypto"),
    Recognizer("DATE_TIME", r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}", 0.85),
]
RECOGNIZER_BY_ENTITY = {r.entity: r for r in RECOGNIZERS}


def entity_set(mode: str = "none", entities=None) -> list[str]:
    mode = (mode or "none").lower()
    if mode == "gdpr":
        return list(C.GDPR_ENTITIES)
    if mode == "hipaa":
        return list(C.HIPAA_ENTITIES)
    if mode != "none":
        raise ValueError(f"unknown compliance mode {mode!r}")
    return list(entities or C.DEFAULT_ENTITIES)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _digit_at(s: Column, i) -> Column:
    return F.substring(s, i, F.lit(1)).cast("int")


def luhn_ok(v) -> Column:
    d = _digits(_col(v))
    n = F.length(d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + (
        F.when(i % 2 == 0, F.when(_digit_at(d, n - i + 1) * 2 > 9, _digit_at(d, n - i + 1) * 2 - 9)
               .otherwise(_digit_at(d, n - i + 1) * 2))
         .otherwise(_digit_at(d, n - i + 1))))
    return (n > 0) & (total % 10 == 0)


def ipv4_ok(v) -> Column:
    return F.forall(F.split(_col(v), r"\."), lambda x: x.cast("int") <= 255)


def ssn_ok(v) -> Column:
    p = F.split(_col(v), r"[ .\-]")
    d = _digits(_col(v))
    area, grp, ser = p.getItem(0), p.getItem(1), p.getItem(2)
    return (~area.isin("000", "666") & ~area.startswith("9") & (grp != "00") & (ser != "0000")
            & (F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) > 0))


def dea_ok(v) -> Column:
    s = _col(v)
    d = [F.substring(s, 2 + k, F.lit(1)).cast("int") for k in range(1, 8)]
    return ((d[0] + d[2] + d[4]) + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]


def iban_ok(v) -> Column:
    s = F.upper(F.regexp_replace(_col(v), " ", ""))
    r = F.concat(F.substring(s, 5, 1 << 20), F.substring(s, 1, 4))
    fold = F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0).cast("bigint"), lambda acc, i: F.when(
        F.substring(r, i, F.lit(1)).rlike("[0-9]"),
        (acc * 10 + F.substring(r, i, F.lit(1)).cast("int")) % 97).otherwise(
        (acc * 100 + F.ascii(F.substring(r, i, F.lit(1))) - 55) % 97))
    return fold == 1


def crypto_ok(v) -> Column:
    s = _col(v)
    return s.startswith("bc1") | (s.rlike("[A-Z]") & s.rlike("[a-z]"))


VALIDATORS = {"luhn": luhn_ok, "ipv4": ipv4_ok, "ssn": ssn_ok, "dea": dea_ok,
              "iban": iban_ok, "crypto": crypto_ok}


def _anchored(core: str) -> str:
    return f"^(?:{core})$"


def recognizer_spans(text, r: Recognizer, threshold: float = C.PII_CONFIDENCE_THRESHOLD) -> Column:
    t = _col(text)
    sev = C.PII_SEVERITY.get(r.entity, C.DEFAULT_SEVERITY)

    def score(x):
        s = F.lit(r.score)
        if r.validator:
            # a value that fails its check is no match: context can't lift it over any threshold
            s = F.when(VALIDATORS[r.validator](x["value"]), F.lit(1.0)).otherwise(F.lit(-1.0))
        if r.context:
            lo = F.greatest(x["start"] - CONTEXT_WINDOW, F.lit(0))
            window = F.lower(F.substring(t, lo + 1, x["start"] - lo))
            hit = F.exists(F.array(*[F.lit(w) for w in r.context]), lambda w: F.contains(window, w))
            s = F.when(hit, F.least(s + CONTEXT_BOOST, F.lit(1.0))).otherwise(s)
        return s

    cands = regex_matches(t, r.scan_pattern, r.guard)
    if r.wrap:
        anchored = _anchored(r.core)
        cands = F.filter(cands, lambda x: x["value"].rlike(anchored))
    scored = F.transform(cands, lambda x: F.struct(
        F.lit(r.entity).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"),
        F.round(score(x), 4).alias("score"), F.lit(sev).alias("severity")))
    return F.filter(scored, lambda x: x["score"] >= threshold)


def pii_spans(text, entities=None, mode: str = "none",
              threshold: float = C.PII_CONFIDENCE_THRESHOLD, gazetteer=None) -> Column:
    """All PII spans of the active entity set, sorted by (start, end, type)."""
    active = entity_set(mode, entities)
    recs = [RECOGNIZER_BY_ENTITY[e] for e in active if e in RECOGNIZER_BY_ENTITY]
    parts = [recognizer_spans(text, r, threshold) for r in recs if not r.needs_digit]
    digit = [recognizer_spans(text, r, threshold) for r in recs if r.needs_digit]
    if digit:
        # one document-level test gates every recogniser whose matches need a digit
        parts.append(F.when(_col(text).rlike("[0-9]"), F.concat(*digit)).otherwise(F.array().cast(SPAN_TYPE)))
    for ent, names in (gazetteer or {}).items():
        if ent in active and names:
            parts.append(gazetteer_spans(text, ent, names))
    if not parts:
        return F.array().cast(SPAN_TYPE)
    from docshield.functions.vectors import let
    # the comparator sort only runs where there is something to order
    return let(F.concat(*parts), lambda a: F.when(F.size(a) > 1, F.array_sort(a, lambda x, y: _cmp_start(x, y)))
               .otherwise(a))


def _cmp(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def _cmp_start(a, b) -> Column:
    return F.when(a["start"] != b["start"], _cmp(a["start"], b["start"])).when(
        a["end"] != b["end"], _cmp(a["end"], b["end"])).otherwise(
        _cmp(a["entity_type"], b["entity_type"]))


# Dictionary recogniser (PERSON / LOCATION without a NER model): a bounded
# list compiles into one alternation; larger dictionaries go through the
# join operator operators.requests.gazetteer_join.
GAZETTEER_REGEX_MAX = 5000


def gazetteer_spans(text, entity: str, names) -> Column:
    names = sorted({n for n in names if n}, key=lambda s: (-len(s), s))
    if len(names) > GAZETTEER_REGEX_MAX:
        raise ValueError("gazetteer too large for the regex path; use operators.requests.gazetteer_join")
    alt = "|".join(re.escape(n) for n in names)
    pat = f"{NOT_INSIDE_WORD}{WORD}*(?:{alt}){WORD}*"
    anchored = f"^(?:{alt})$"
    sev = C.PII_SEVERITY.get(entity, C.DEFAULT_SEVERITY)
    t = _col(text)
    # substring tests are far cheaper than the regex alternation as a pre-test
    any_name = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(t, n)) \
        if len(names) <= 64 else t.rlike(alt)
    cands = F.filter(regex_matches(t, pat, any_name), lambda x: x["value"].rlike(anchored))
    return F.transform(cands, lambda x: F.struct(
        F.lit(entity).alias("entity_type"), x["start"].alias("start"), x["end"].alias("end"),
        F.lit(0.85).alias("score"), F.lit(sev).alias("severity")))


# ---------------------------------------------------------------------------
# Overlap resolution and redaction
# ---------------------------------------------------------------------------

def _better(x: Column, c: Column) -> Column:
    """Span x outranks the current best of component c: score, length, start, type."""
    xl = x["end"] - x["start"]
    return ((x["score"] > c["bscore"])
            | ((x["score"] == c["bscore"]) & (xl > c["blen"]))
            | ((x["score"] == c["bscore"]) & (xl == c["blen"]) & (x["start"] < c["bstart"]))
            | ((x["score"] == c["bscore"]) & (xl == c["blen"]) & (x["start"] == c["bstart"])
               & (x["entity_type"] < c["label"])))


COMP_STRUCT = "struct<start:int,end:int,label:string,bscore:double,blen:int,bstart:int>"
COMP_TYPE = f"array<{COMP_STRUCT}>"
REDACT_BLOCK = 64


def merge_spans(spans) -> Column:
    """Overlapping spans merge into one component labelled by its best span.

    Every detected character stays covered, so nothing leaks through a
    partial overlap.  Input must be sorted by start.
    """
    def comp(x):
        return F.struct(x["start"].alias("start"), x["end"].alias("end"),
                        x["entity_type"].alias("label"), x["score"].alias("bscore"),
                        (x["end"] - x["start"]).alias("blen"), x["start"].alias("bstart"))

    def merged(last, x):
        return F.struct(last["start"].alias("start"),
                        F.greatest(last["end"], x["end"]).alias("end"),
                        F.when(_better(x, last), x["entity_type"]).otherwise(last["label"]).alias("label"),
                        F.when(_better(x, last), x["score"]).otherwise(last["bscore"]).alias("bscore"),
                        F.when(_better(x, last), x["end"] - x["start"]).otherwise(last["blen"]).alias("blen"),
                        F.when(_better(x, last), x["start"]).otherwise(last["bstart"]).alias("bstart"))

    # components are appended to a short block, and full blocks to ``done``: appending copies
    # an array, so one long array would make the work quadratic
    def step(acc, x):
        first, joins = acc["last"].isNull(), x["start"] < acc["last"]["end"]
        full = F.size(acc["block"]) >= FOLD_BLOCK
        block = F.when(first | joins, acc["block"]).when(full, F.array(acc["last"])) \
            .otherwise(F.concat(acc["block"], F.array(acc["last"])))
        done = F.when(~first & ~joins & full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), block.alias("block"),
                        F.when(~first & joins, merged(acc["last"], x)).otherwise(comp(x)).cast(COMP_STRUCT).alias("last"))

    init = F.struct(F.array().cast(f"array<{COMP_TYPE}>").alias("done"), F.array().cast(COMP_TYPE).alias("block"),
                    F.lit(None).cast(COMP_STRUCT).alias("last"))
    def folded(a):
        return F.aggregate(a, init, step, lambda acc: F.when(acc["last"].isNull(), F.array().cast(COMP_TYPE)).otherwise(
            F.concat(F.flatten(acc["done"]), acc["block"], F.array(acc["last"]))))

    # spans that don't overlap, the usual case, are their own components
    def apart(a):
        return (F.size(a) <= 1) | F.forall(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.get(a, i)["start"] >= F.get(a, i - 1)["end"])

    from docshield.functions.vectors import let
    return let(_col(spans), lambda a: F.when(apart(a), F.transform(a, comp)).otherwise(folded(a)))


def redact(text, spans) -> Column:
    """Replace each merged component by ``<ENTITY_TYPE>``.

    A piece of a string is found by counting from its start, so pieces are cut
    from the stretch of ``REDACT_BLOCK`` components that they lie in."""
    from docshield.functions.vectors import let
    t = _col(text)

    def rebuilt(t, c):
        n = F.size(c)
        end = lambda i: F.when(i < 0, F.lit(0)).otherwise(F.get(c, i)["end"])

        def stretch(b):
            lo, hi = b * REDACT_BLOCK, F.least((b + 1) * REDACT_BLOCK, n) - 1
            def piece(s):
                return lambda i: F.concat(F.substring(s, end(i - 1) - end(lo - 1) + 1, F.get(c, i)["start"] - end(i - 1)),
                                          F.lit("<"), F.get(c, i)["label"], F.lit(">"))
            return let(F.substring(t, end(lo - 1) + 1, end(hi) - end(lo - 1)),
                       lambda s: F.array_join(F.transform(F.sequence(lo, hi), piece(s)), ""))

        blocks = F.sequence(F.lit(0), F.floor((n - 1) / REDACT_BLOCK).cast("int"))
        return F.concat(F.array_join(F.transform(blocks, stretch), ""), F.substring(t, end(n - 1) + 1, F.lit(1 << 30)))

    return let(t, lambda x: let(merge_spans(spans), lambda c: F.when(F.size(c) == 0, x).otherwise(rebuilt(x, c))))


def severity_class(spans) -> Column:
    """critical→RESTRICTED, high→CONFIDENTIAL, other→INTERNAL, none→PUBLIC."""
    s = _col(spans)
    return (F.when(F.size(s) == 0, "PUBLIC")
            .when(F.exists(s, lambda x: x["severity"] == "critical"), "RESTRICTED")
            .when(F.exists(s, lambda x: x["severity"] == "high"), "CONFIDENTIAL")
            .otherwise("INTERNAL"))


# ---------------------------------------------------------------------------
# Chunk trust
# ---------------------------------------------------------------------------

def trust_tenths(text) -> Column:
    """Trust in integer tenths: 10 - 4*phrases - 3*zero-width chars, floor 0."""
    t = _col(text)
    p = count_present(F.lower(t), C.CHUNK_TRUST_PHRASES)
    z = count_present(t, C.ZERO_WIDTH_CHARS)
    return F.greatest(F.lit(10) - 4 * p - 3 * z, F.lit(0))


def trust_display(tenths) -> Column:
    """The float trust as Python prints it (1.0 - 0.4*p - 0.3*z)."""
    return F.format_string("%.1f", _col(tenths) / 10.0)


# ---------------------------------------------------------------------------
# Grounding
# ---------------------------------------------------------------------------

def keywords(text) -> Column:
    toks = F.split(F.lower(_col(text)), r"[^\p{L}\p{N}_]+", -1)
    stops = F.array(*[F.lit(w) for w in C.STOP_WORDS])
    return F.array_distinct(F.filter(toks, lambda w: w.rlike("^[a-z]{3,}$") & ~F.array_contains(stops, w)))


def grounding_risk(response, context) -> Column:
    r, c = _col(response), _col(context)
    rk, ck = keywords(r), keywords(c)
    ratio = F.size(F.array_intersect(rk, ck)) / F.size(rk)
    return (F.when(r.isNull() | c.isNull() | (r == "") | (c == ""), "none")
            .when(F.size(rk) == 0, "low")
            .when(ratio >= C.GROUNDING_LOW, "low")
            .when(ratio >= C.GROUNDING_MEDIUM, "medium")
            .otherwise("high"))
