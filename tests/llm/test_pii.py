"""Personal data: base spans against brute force, added spans on planted findings, defined cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docshield.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
SCHEMA = "doc_id long, text string, row string, spans long"


def luhn(d):
    return sum((2 * x - 9 * (x > 4)) if k % 2 else x for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


#: Texts on which the plain patterns take quadratic time, and what they find.
SLOW = {"a@b.co " + "l" * 300_000: [(0, 0, 6)], "9" * 100_000: [], "1 " * 60_000 + "2": [], "+1" + " " * 100_000: []}


def brute(text):
    if text in SLOW:
        return SLOW[text]
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (k != 1 or all(int(x) <= 255 for x in m.group().split("."))) and (k != 2 or 12 <= len(d) <= 19 and luhn(d)) and (k != 3 or 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(found):
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest()


def card(r):
    d = "4" + "".join(r.choice("0123456789") for _ in range(14))
    return next(d + x for x in "0123456789" if luhn(d + x))


def corpus(n=160, seed=2):
    """Documents with personal data that the base finds."""
    r = random.Random(seed)
    say = lambda: " ".join(r.choice(["über", "lorem", "eau", "thing", "niño", "sea", "vz"]) for _ in range(8))
    return [(k, f"{say()} u.{k}@mail{k % 9}.example.com {say()} {r.randrange(1, 255)}.{r.randrange(255)}.{r.randrange(255)}.{r.randrange(1, 255)} {say()} {card(r)} {say()} +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} {say()}"
             f" {'4' + str(r.randrange(10**14, 10**15))[:15] if k % 2 else ''} {r.randrange(256, 999)}.1.2.3", "x", 7) for k in range(n)]


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(3)
    parts = ["a", "Z", "9", "1", "4", "@", ".", "-", " ", "+", "(", ")", "%", "_", "ü", "1.2.3.4", "256.1.1.1", "a@b.c", "@d.e", "4111 1111 1111 1111", "+49 30 1234567", "\n", "😀", "00007.8.9.010"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(400)]
    texts += ["x@" + "a." * 20_000 + "com 1", "1." * 50_000, "a.b@c" * 20_000, "", *SLOW]
    return texts


def test_base_spans_equal_brute_force(spark, odd_texts):
    docs = spark.createDataFrame([(k, t, "x", 7) for k, t in enumerate([*odd_texts, None])], SCHEMA)
    rows = pii.personal_data(docs.repartition(4)).collect()
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        want = brute([*odd_texts, None][r.doc_id])
        assert r.base_sha256 == digest(want), [*odd_texts, None][r.doc_id][:200]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[1] for x in want) for k in range(4))
        told = [tuple(x.split(":")) for x in r.spans.split(",") if x]
        assert {(pii.KINDS[k], str(s), str(e)) for s, k, e in want} <= set(told)
        assert told == sorted(told, key=lambda x: (int(x[1]), pii.KINDS.index(x[0]), int(x[2])))


def test_added_spans_catch_other_notations_and_leave_decoys(spark):
    planted = {1000: "write to anna.berg (at) mail7.example (dot) com today", 1001: "Kontakt: jürgen@büro.example.de bitte", 1002: "the server 10.20[.]30[.]40 is down",
               1003: "call (212) 555-0147 now", 1004: "my card: 4111.1111.1111.1111 ok", 1005: "und +1 (212) 555-0147 4111111111111111 da"}
    clean = {2000: "firmware v2.10.4.1 was released", 2001: "order no. 4111111111111112 shipped", 2002: "see icon@2x.png in the folder", 2003: "Version 3.0 of 2024", 2004: "meet at noon. Dot your letters at home", 2005: "9" * 40}
    docs = spark.createDataFrame(corpus() + [(k, t, "x", 7) for k, t in (planted | clean).items()], SCHEMA)
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    for k in planted:
        assert got[k].n_added >= 1, planted[k]
    assert got[1005].n_added == 2  # the base loses both: each has run into the other
    for k, t in clean.items():
        assert [x for x in got[k].spans.split(",") if x] == [f"{pii.KINDS[n]}:{s}:{e}" for s, n, e in brute(t)], t
    texts = [t for _, t, _, _ in corpus()]
    for r in got.values():  # in every document of the corpus the decoys stay
        if r.doc_id < 1000:
            assert r.n_added == 0 and (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1 + (r.doc_id % 2 and luhn(texts[r.doc_id].split()[-2])), 1)


def test_held_out_precision_and_recall(spark):
    docs = spark.createDataFrame(corpus(240, 5), SCHEMA)
    findings = pii.findings_of(pii.located(pii.matches(docs)))
    test = F.pmod(F.xxhash64("source"), F.lit(5)) == 0
    judged = pii.scored(findings.where(test), pii.model(findings.where(~test))).select("label", "personal").collect()
    hit = sum(r.label == 1 and r.personal for r in judged)
    assert hit >= 0.9 * sum(r.label == 1 for r in judged) and hit >= 0.95 * sum(r.personal for r in judged)


def test_defined_cases(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a@b.cd", "x", 7), (1, "a@b.cd", "x", 7), (1, "a@b.cd", "x", 7), (2, "", "x", 7), (3, None, "x", 7)]
    got = sorted((r.doc_id or 0, r.n_email, r.spans) for r in pii.personal_data(spark.createDataFrame(rows, SCHEMA)).collect())
    plan = pii.personal_data(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got == [(0, 1, "email:0:6"), (1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, ""), (3, 0, "")]


def test_the_model_counts_every_finding(spark):
    """Far more findings of a kind than any bound: none is left out, and a rare kind keeps its weight."""
    rows = [(0, f"u{k}@mail.example.com", "write to ", " now", 1.0) for k in range(3000)] + [(0, f"icon{k}@2x.png", "see ", " here", 0.0) for k in range(2600)]
    rows += [(1, f"10.20.30.{k}", "host ", "", 1.0) for k in range(40)] + [(1, f"10.20.30.{k}", "version ", "", 0.0) for k in range(40)]
    findings = spark.createDataFrame(rows + rows[:500], "kind int, value string, before string, after string, label double")
    counted = pii._counted(findings)
    assert {(r.kind, r.label): r.n for r in counted.groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()} == {(0, 1.0): 3000, (0, 0.0): 2600, (1, 1.0): 40, (1, 0.0): 40}
    assert counted.count() < 200  # findings of equal features are one row
    judged = pii.scored(findings, pii.model(findings)).groupBy("kind", "label").agg(F.avg(F.col("personal").cast("int")).alias("p")).collect()
    assert all(r.p >= 0.95 if r.label else r.p <= 0.05 for r in judged)
    p = spark.createDataFrame([(0, 1.0, 0.9, 98), (0, 0.0, 0.9, 2), (0, 1.0, 0.7, 1), (0, 0.0, 0.7, 1)], "kind int, label double, p double, n long")
    assert pii.thresholds(p, 0.98) == {0: pytest.approx(0.8)}
