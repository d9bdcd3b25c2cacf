"""Stages on tables with columns named like their own, and mixtures that do not depend on the batch."""

import numpy as np
from pyspark.sql import functions as F

from docshield.llm import decontam, langid, neardup, quality, secrets

CLASHES = ["_row", "row", "spans", "items", "n_words", "n_hit", "any", "nth", "value", "secret", "label", "vector", "class_id", "shard"]
LEAK = "one two three four five six seven eight nine ten"


def _docs(spark):
    good = " ".join(f"Sentence number {i} tells of a river, a bridge and the people who cross it before noon{i}." for i in range(12))
    rows = [(1, None), (2, ""), (3, f"before {LEAK} after"), (4, "password = hunter2pass99 stays"), (4, "password = hunter2pass99 stays"), (5, good), (6, good)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.select("doc_id", *(F.concat(F.lit(f"{n}-"), F.col("doc_id").cast("string")).alias(n) for n in CLASHES), "text")


def _whole(docs, out):
    assert out.columns == docs.columns
    rows = out.collect()
    for r in rows:
        assert all(r[n] == f"{n}-{r['doc_id']}" for n in CLASHES)
    return rows


def test_columns_named_like_a_stages_own_stay_as_they_are(spark):
    docs = _docs(spark)
    bench = spark.createDataFrame([(7, LEAK)], "item_id long, text string")
    rows = _whole(docs, decontam.decontaminated(docs, bench))
    assert len(rows) == 7 and all(LEAK not in (r["text"] or "") for r in rows)
    assert {r["doc_id"]: r["text"] for r in rows}[1] is None
    rows = _whole(docs, secrets.redacted(docs))
    assert len(rows) == 7 and sum("hunter2pass99" in (r["text"] or "") for r in rows) == 0
    rows = _whole(docs, quality.filtered(docs))
    assert {r["doc_id"] for r in rows} <= {5, 6}
    rows = _whole(docs, neardup.deduplicated(docs))
    assert sorted(r["doc_id"] for r in rows) == [1, 2, 3, 4, 4, 5]      # rows that share a doc_id are one document


def _alone(likelihood, rounds):
    """Mixture of one document by the definition: EM from equal shares, the least language leaves while the penalised likelihood does not fall."""
    n, langs = likelihood.shape
    on, best, kept = np.ones(langs), -np.inf, np.zeros(langs)
    for left in range(langs, 0, -1):
        pi = on / on.sum()
        for _ in range(rounds if left > 1 else 0):
            r = np.exp(likelihood - likelihood.max(1, keepdims=True)) * pi
            new = (r / r.sum(1, keepdims=True)).mean(0)
            done, pi = np.abs(new - pi).max() < 1e-3, new
            if done:
                break
        fit = np.log((np.exp(likelihood - likelihood.max(1, keepdims=True)) * pi).sum(1)).sum() - 0.5 * (left - 1) * np.log(max(n, 2)) - 2.0 * (left - 1)
        if fit < best:
            break
        best, kept = fit, pi
        on[np.where(on > 0, pi, np.inf).argmin()] = 0
    return kept


def test_mixtures_equal_the_definition_and_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 60, 30)
    doc = np.repeat(np.arange(30), sizes)
    likelihood = rng.normal(-8, 2.0, (len(doc), 4))
    likelihood[:, 0] += np.where(doc % 3 == 0, 3.0, 0.0)
    together = langid.mixtures(likelihood, doc, 30)
    for d in range(30):
        own = likelihood[doc == d]
        assert np.allclose(together[d], langid.mixtures(own, np.zeros(len(own), int), 1)[0], atol=1e-9)
        assert np.allclose(together[d], _alone(own, langid.ROUNDS), atol=1e-6)
