"""DuckDB SQL building blocks for the correctness oracle.

These mirror the Spark expressions in ``docshield.functions`` but are written
relationally where that is the natural SQL form (matches unnested into rows,
window-based span merging, ``string_agg`` rebuilds), so the oracle is an
independent formulation rather than a transliteration.
"""

from __future__ import annotations

import re

from docshield import constants as C
from docshield.functions.text import RECOGNIZERS, RECOGNIZER_BY_ENTITY, CONTEXT_BOOST, \
    CONTEXT_WINDOW, SECRET_GUARDS, entity_set, secret_patterns


def q(s: str) -> str:
    """SQL string literal (DuckDB does not process backslashes)."""
    return "'" + s.replace("'", "''") + "'"


def qlist(items) -> str:
    return "[" + ", ".join(q(x) for x in items) + "]::VARCHAR[]"


ZW = "".join(C.ZERO_WIDTH_CHARS)


def zw_found(t: str) -> str:
    return f"list_filter({qlist(C.ZERO_WIDTH_CHARS)}, lambda z: contains({t}, z))"


def strip_zw(t: str) -> str:
    return f"translate({t}, {q(ZW)}, '')"


def phrases(lowered: str, items) -> str:
    return f"list_filter({qlist(items)}, lambda p: contains({lowered}, p))"


def count_present(t: str, items) -> str:
    return f"len(list_filter({qlist(items)}, lambda p: contains({t}, p)))"


def matches(t: str, pattern: str) -> str:
    """list of {v, s, i}: value, 0-based start, 1-based match number."""
    p = q(pattern)
    return (f"list_transform(regexp_extract_all({t}, {p}, 0), lambda m, i: {{'v': m, "
            f"'s': cast(coalesce(list_sum(list_transform(regexp_split_to_array({t}, {p})[1:i], lambda y: length(y))), 0)"
            f" + coalesce(list_sum(list_transform(regexp_extract_all({t}, {p}, 0)[1:i-1], lambda y: length(y))), 0) AS BIGINT),"
            f" 'i': i}})")


def normalize_list(s: str) -> str:
    t = f"trim({s})"
    clean = "lambda x: trim(x)"
    return (f"(CASE WHEN {s} IS NULL OR {t} = '' THEN []::VARCHAR[] "
            f"WHEN starts_with({t}, '[') AND json_valid({t}) AND json_type({t}) = 'ARRAY' "
            f"THEN list_filter(list_transform(from_json({t}, '[\"VARCHAR\"]'), {clean}), lambda x: x <> '') "
            f"ELSE list_filter(list_transform(string_split({t}, ','), {clean}), lambda x: x <> '') END)")


def acl_or_default(s: str) -> str:
    n = normalize_list(s)
    return f"(CASE WHEN len({n}) = 0 THEN ['employee']::VARCHAR[] ELSE {n} END)"


# ---------------------------------------------------------------------------
# validators on a matched value v
# ---------------------------------------------------------------------------

def _digits(v):
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def v_luhn(v):
    d = _digits(v)
    dig = f"cast(substr({d}, length({d}) - i + 1, 1) AS INTEGER)"
    return (f"(length({d}) > 0 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
            f"CASE WHEN i % 2 = 0 THEN (CASE WHEN {dig} * 2 > 9 THEN {dig} * 2 - 9 ELSE {dig} * 2 END) "
            f"ELSE {dig} END)) % 10 = 0)")


def v_ipv4(v):
    return f"list_bool_and(list_transform(string_split({v}, '.'), lambda x: cast(x AS INTEGER) <= 255))"


def v_ssn(v):
    p = f"regexp_split_to_array({v}, '[ .\\-]')"
    d = _digits(v)
    return (f"({p}[1] NOT IN ('000', '666') AND NOT starts_with({p}[1], '9') AND {p}[2] <> '00' "
            f"AND {p}[3] <> '0000' AND length(replace({d}, substr({d}, 1, 1), '')) > 0)")


def v_dea(v):
    d = [f"cast(substr({v}, {2 + k}, 1) AS INTEGER)" for k in range(1, 8)]
    return f"((({d[0]} + {d[2]} + {d[4]}) + 2 * ({d[1]} + {d[3]} + {d[5]})) % 10 = {d[6]})"


def v_iban(v):
    s = f"upper(replace({v}, ' ', ''))"
    r = f"(substr({s}, 5) || substr({s}, 1, 4))"
    ch = f"substr({r}, i, 1)"
    return (f"(list_reduce(range(1, length({r}) + 1), lambda acc, i: CASE WHEN regexp_full_match({ch}, '[0-9]') "
            f"THEN (acc * 10 + cast({ch} AS BIGINT)) % 97 ELSE (acc * 100 + ascii({ch}) - 55) % 97 END, 0::BIGINT) = 1)")


def v_crypto(v):
    return f"(starts_with({v}, 'bc1') OR (regexp_matches({v}, '[A-Z]') AND regexp_matches({v}, '[a-z]')))"


VALIDATORS = {"luhn": v_luhn, "ipv4": v_ipv4, "ssn": v_ssn, "dea": v_dea, "iban": v_iban,
              "crypto": v_crypto}


def score_expr(r, t: str, v: str = "v", st: str = "st") -> str:
    s = f"{r.score}::DOUBLE"
    if r.validator:
        s = f"(CASE WHEN {VALIDATORS[r.validator](v)} THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
    if r.context:
        lo = f"greatest({st} - {CONTEXT_WINDOW}, 0)"
        win = f"lower(substr({t}, {lo} + 1, {st} - {lo}))"
        hit = f"len(list_filter({qlist(r.context)}, lambda w: contains({win}, w))) > 0"
        s = f"(CASE WHEN {hit} THEN least({s} + {CONTEXT_BOOST}, 1.0) ELSE {s} END)"
    return f"round({s}, 4)"


def guard_sql(r, t: str) -> str:
    g = r.guard
    return f"contains({t}, {q(g[1:])})" if g.startswith("=") else f"regexp_matches({t}, {q(g)})"


def pii_span_rows(src: str, key: str = "doc_id", t: str = "clean_text", entities=None,
                  mode: str = "none", threshold: float = C.PII_CONFIDENCE_THRESHOLD,
                  gazetteer=None, where: str = "TRUE") -> str:
    """SELECT producing rows (key, entity_type, st, en, score, severity)."""
    parts = []
    active = entity_set(mode, entities)
    for e in active:
        r = RECOGNIZER_BY_ENTITY.get(e)
        if r is None:
            continue
        sev = C.PII_SEVERITY.get(e, C.DEFAULT_SEVERITY)
        full = f" AND regexp_full_match(m.v, {q(r.core)})" if r.wrap else ""
        parts.append(
            f"SELECT {key}, {q(e)} AS entity_type, st, st + length(v) AS en, sc AS score, {q(sev)} AS severity FROM ("
            f"SELECT {key}, m.v AS v, m.s AS st, {score_expr(r, t, 'm.v', 'm.s')} AS sc FROM ("
            f"SELECT {key}, {t}, unnest({matches(t, r.pattern)}) AS m FROM {src} WHERE ({where}) AND {guard_sql(r, t)}"
            f") WHERE TRUE{full}) WHERE sc >= {threshold}")
    for e, names in (gazetteer or {}).items():
        if e not in active or not names:
            continue
        from docshield.functions.text import WORD
        alt = "|".join(re.escape(n) for n in sorted(set(names), key=lambda s: (-len(s), s)))
        pat = f"{WORD}*(?:{alt}){WORD}*"
        sev = C.PII_SEVERITY.get(e, C.DEFAULT_SEVERITY)
        parts.append(
            f"SELECT {key}, {q(e)} AS entity_type, m.s AS st, m.s + length(m.v) AS en, 0.85::DOUBLE AS score, {q(sev)} AS severity FROM ("
            f"SELECT {key}, unnest({matches(t, pat)}) AS m FROM {src} WHERE ({where}) AND regexp_matches({t}, {q(alt)})"
            f") WHERE regexp_full_match(m.v, {q(alt)})")
    if not parts:
        return f"SELECT {key}, NULL::VARCHAR AS entity_type, 0 AS st, 0 AS en, 0.0::DOUBLE AS score, NULL::VARCHAR AS severity FROM {src} WHERE FALSE"
    return "\nUNION ALL\n".join(parts)


def _guard(g, pat, t):
    if g and g.startswith("="):
        return f"contains({t}, {q(g[1:])})"
    return f"regexp_matches({t}, {q(g or pat)})"


def secret_rows(src: str, key: str = "doc_id", t: str = "clean_text", include_generic: bool = False,
                where: str = "TRUE") -> str:
    """rows (key, pat_no, hit_no, type, preview, st, en)."""
    parts = []
    for k, (name, pat) in enumerate(secret_patterns(include_generic), start=1):
        parts.append(
            f"SELECT {key}, {k} AS pat_no, m.i AS hit_no, {q(name)} AS type, "
            f"substr(m.v, 1, {C.SECRET_PREVIEW_CHARS}) || '***' AS preview, m.s AS st, m.s + length(m.v) AS en FROM ("
            f"SELECT {key}, unnest({matches(t, pat)}) AS m FROM {src} WHERE ({where}) AND {_guard(SECRET_GUARDS.get(name), pat, t)})")
    return "\nUNION ALL\n".join(parts)


def redaction_ctes(spans: str, docs: str, key: str = "doc_id", t: str = "clean_text",
                   prefix: str = "r") -> str:
    """CTEs ending in ``{prefix}_red(key, n_components, redacted)`` for docs with spans."""
    return f"""
{prefix}_w1 AS (
  SELECT *, max(en) OVER (PARTITION BY {key} ORDER BY st, en, entity_type
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max
  FROM {spans}),
{prefix}_w2 AS (
  SELECT *, sum(CASE WHEN prev_max IS NULL OR st >= prev_max THEN 1 ELSE 0 END)
           OVER (PARTITION BY {key} ORDER BY st, en, entity_type ROWS UNBOUNDED PRECEDING) AS grp
  FROM {prefix}_w1),
{prefix}_comp AS (
  SELECT {key}, grp, min(st) AS cs, max(en) AS ce,
         first(entity_type ORDER BY score DESC, en - st DESC, st, entity_type) AS label
  FROM {prefix}_w2 GROUP BY {key}, grp),
{prefix}_piece AS (
  SELECT c.*, coalesce(lag(ce) OVER (PARTITION BY {key} ORDER BY cs), 0) AS prev_end FROM {prefix}_comp c),
{prefix}_red AS (
  SELECT p.{key}, count(*) AS n_components,
         string_agg(substr(d.{t}, p.prev_end + 1, p.cs - p.prev_end) || '<' || p.label || '>', '' ORDER BY p.cs)
           || substr(any_value(d.{t}), max(p.ce) + 1) AS redacted
  FROM {prefix}_piece p JOIN {docs} d ON d.{key} = p.{key}
  GROUP BY p.{key})"""


def trust_tenths(t: str) -> str:
    p = count_present(f"lower({t})", C.CHUNK_TRUST_PHRASES)
    z = count_present(t, C.ZERO_WIDTH_CHARS)
    return f"greatest(10 - 4 * {p} - 3 * {z}, 0)"


def keywords(t: str) -> str:
    toks = f"regexp_split_to_array(lower({t}), '[^\\p{{L}}\\p{{N}}_]+')"
    return (f"list_distinct(list_filter({toks}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') "
            f"AND NOT list_contains({qlist(C.STOP_WORDS)}, w)))")


def grounding_risk(resp: str, ctx: str) -> str:
    rk, ck = keywords(resp), keywords(ctx)
    ratio = f"(len(list_intersect({rk}, {ck}))::DOUBLE / len({rk}))"
    return (f"(CASE WHEN {resp} IS NULL OR {ctx} IS NULL OR {resp} = '' OR {ctx} = '' THEN 'none' "
            f"WHEN len({rk}) = 0 THEN 'low' WHEN {ratio} >= {C.GROUNDING_LOW} THEN 'low' "
            f"WHEN {ratio} >= {C.GROUNDING_MEDIUM} THEN 'medium' ELSE 'high' END)")
