"""Language identification as a mixture of languages.

Training counts byte trigrams of the labelled documents for each language, in a table of
a fixed number of slots.  A document is a mixture: each of its words comes from language
l with probability pi_l, and the word's likelihood under l is that of its trigrams.
Expectation-maximisation estimates pi; languages are then taken out one by one, smallest
share first, as long as the penalised likelihood (BIC) improves.  The language with the
largest share is the prediction, the share is its score.

Defined cases: a null text or one without a letter is ``und`` with score 0; with nothing
to learn from everything is ``und``; ties go to the language that sorts first; a null
doc_id is never a training row; repeated rows count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docshield.llm.common import SPACED, spans, steps, utf8

SLOTS = 1 << 16
ROUNDS = 12
UNKNOWN = "und"


def _lower(col: pa.Array) -> pa.Array:
    return pa.array([t.lower() if t is not None else None for t in col.to_pylist()], pa.string())


def _word_grams(texts: pa.Array):
    """Slot of the trigram at every byte of a word (with one blank before and after each word), the first of each word, and its document."""
    buf, off = utf8(_lower(texts))
    s, e, d = spans(buf, off, SPACED)
    size = e - s + 2  # blank, bytes, blank; a trigram ends at each byte but the first
    at = np.cumsum(size) - size
    padded = np.full(int(size.sum()) + 2, 32, np.uint32)
    inner = np.ones(len(padded), bool)
    inner[at] = False
    inner[at + size - 1] = False
    inner[len(padded) - 2:] = False
    take = np.zeros(len(buf) + 1, np.int64)
    np.add.at(take, s, 1)
    np.add.at(take, e, -1)
    padded[inner] = buf[np.cumsum(take)[:-1] > 0]
    gram = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    gram = (gram * np.uint32(2654435761)) >> np.uint32(16)
    starts = at - np.arange(len(at)) * 2  # each word has size - 2 trigrams: drop the two that reach into the next word
    valid = np.ones(len(padded) - 2, bool)
    valid[at + size - 1] = False
    valid[at + size - 2] = False
    return gram[valid[:len(gram)]], starts, d


def _count(batches):
    """Rows (lang, slot, n) of what this task has read."""
    total: dict[str, np.ndarray] = {}
    for b in steps(batches):
        langs = np.array(b.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            grams, _, _ = _word_grams(b.column("text").filter(pa.array(langs == lang)))
            if lang not in total:
                total[lang] = np.zeros(SLOTS, np.int64)
            total[lang] += np.bincount(grams, minlength=SLOTS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "slot", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages in order, log probabilities [slot, language]) from documents with text and lang.  The model has SLOTS
    rows for each language, whatever the corpus."""
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counts = known.mapInArrow(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list("slot").alias("slot"), F.collect_list("n").alias("n")).collect()
    langs = sorted(r["lang"] for r in rows)
    table = np.full((SLOTS, len(langs)), 0.25)
    for r in rows:
        table[np.array(r["slot"]), langs.index(r["lang"])] += np.array(r["n"], float)
    return langs, np.log(table / table.sum(0)) if langs else table


def mixtures(likelihood: np.ndarray, doc: np.ndarray, docs: int, rounds: int = ROUNDS) -> np.ndarray:
    """Shares [document, language] of the languages that the penalised likelihood keeps.

    likelihood: [word, language], logarithms; doc: each word's document, ascending.
    """
    words, langs = likelihood.shape
    share = np.zeros((docs, langs))
    if not words or not langs:
        return share
    n = np.bincount(doc, minlength=docs)
    some = np.flatnonzero(n)
    first = np.searchsorted(doc, some)
    n = n[some].astype(float)
    row = np.repeat(np.arange(len(some)), n.astype(int))
    best = likelihood.max(1, keepdims=True)
    lik = np.exp(likelihood - best)
    on = np.ones((len(some), langs))
    todo = np.arange(len(some))  # documents whose set may still shrink
    result, score = np.zeros((len(some), langs)), np.full(len(some), -np.inf)
    for left in range(langs, 0, -1):
        pick = np.isin(row, todo) if len(todo) < len(some) else slice(None)
        own, at = lik[pick], np.searchsorted(todo, row[pick])
        begin = np.searchsorted(at, np.arange(len(todo)))
        pi = on[todo] / on[todo].sum(1, keepdims=True)
        live = np.ones(len(todo), bool)  # each document stops at its own convergence, whatever stands beside it
        for _ in range(rounds if left > 1 else 0):
            r = own * pi[at]
            r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
            new = np.add.reduceat(r, begin, axis=0) / n[todo, None]
            moved = np.abs(new - pi).max(1)
            pi = np.where(live[:, None], new, pi)
            live &= moved >= 1e-3
            if not live.any():
                break
        fit = np.add.reduceat(np.log(np.maximum((own * pi[at]).sum(1), 1e-300)), begin) - 0.5 * (left - 1) * np.log(np.maximum(n[todo], 2)) - 2.0 * (left - 1)
        better = fit >= score[todo]
        result[todo[better]], score[todo[better]] = pi[better], fit[better]
        todo, pi = todo[better], pi[better]
        if left == 1 or not len(todo):
            break
        on[todo, np.where(on[todo] > 0, pi, np.inf).argmin(1)] = 0
    share[some] = result
    return share


def _predict(langs, table):
    def run(batches):
        for b in steps(batches):
            texts = b.column("text")
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
            if langs and letters.any():
                grams, starts, doc = _word_grams(texts)
                likelihood = np.stack([np.add.reduceat(table[:, k][grams], starts) for k in range(len(langs))], 1) if len(starts) else np.zeros((0, len(langs)))
                share = mixtures(likelihood, doc, b.num_rows)
            else:
                share = np.zeros((b.num_rows, max(1, len(langs))))
            top = share.argmax(1)
            known = letters & (share.max(1) > 0)
            lang = [langs[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)]
            score = np.where(known, np.minimum(share.max(1), 1.0), 0.0)
            mix = [{langs[k]: float(p) for k, p in enumerate(s) if p > 0} if ok and langs else {} for s, ok in zip(share, known, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array([list(m.items()) for m in mix], pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])
    return run


def identified(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, lang_pred, score and the shares of all languages kept, for every document; learns from ``training`` (text, lang)."""
    langs, table = train(training)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_predict(langs, table.astype(np.float32)), f"doc_id {kind}, lang_pred string, score double, shares map<string,double>")
