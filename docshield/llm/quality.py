"""Quality rules as weak supervision.

Ten rules look at each document and vote good (+1), bad (-1) or abstain (0).  No rule
is trusted by itself: expectation-maximisation over the table of vote patterns finds,
for the hidden classes good and bad, how often each rule votes which way, and the
posterior probability of ``good`` replaces an all-must-pass filter.  The pattern table
has at most 3**10 rows at any input size, so only it goes to the driver.

Defined cases: a null or empty text has no words and fails the base rules; a null doc_id
is kept as null; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from string import ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docshield.llm.common import cut, steps

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
#: Very frequent function words of the corpus languages (fixed values).
STOP_WORDS = frozenset("a an and are as at be by for from in is it of on that the this to was with "
                       "der die das und ist nicht ein eine von zu den mit sich auf "
                       "le la les un une des et est de du en que qui dans pour "
                       "el los las una y por con para del se no".split())

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
           "n_lines long, n_distinct long, n_stop long, n_upper long, n_letters long, n_marks long, n_plain long"


def _repeat_words(words: list[bytes]) -> int:
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    hit = np.zeros(len(words), bool)
    again = np.flatnonzero(np.fromiter((seen[g] > 1 for g in grams), bool, len(grams)))
    for k in range(3):
        hit[again + k] = True
    return int(hit.sum())


def text_features(text: str | None) -> tuple[int, ...]:
    """The counts of FEATURES for one text; words are `[^\\x20\\x09-\\x0D]+`."""
    if not text:
        return (0,) * 12
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    forms = Counter(words)
    letters = sum(len(w) * k for w, k in forms.items() if w.isalpha())
    stop = sum(k for w, k in forms.items() if len(w) < 6 and w.lower().decode("utf-8", "replace") in STOP_WORDS)
    plain = sum(k for w, k in forms.items() if w.rstrip(b".,;:!?").isalpha() or max(w) > 127)
    upper = sum(map(text.count, ascii_uppercase))
    return (len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup, _repeat_words(words),
            lines, len(forms), stop, upper, letters, text.count("!"), plain)


NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def _features(carry: list[str], prefix: str = ""):
    def run(batches):
        for b in steps(batches):
            rows = [text_features(t) for t in b.column("text").to_pylist()]
            cols = np.array(rows, np.int64).reshape(len(rows), len(NAMES)).T
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), *(pa.array(c) for c in cols)], [*carry, *(prefix + n for n in NAMES)])
    return run


def votes() -> list[tuple[str, Column]]:
    """(rule, its vote): -1 bad, 0 abstain, 1 good."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda c: F.col(c) / n
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    mean = share("word_chars")
    letters = F.greatest(F.col("word_chars"), F.lit(1))
    return [
        ("length", vote(F.col("n_words") < 30, F.col("n_words") >= 80)),
        ("symbols", vote(share("n_symbols") > 0.2, share("n_symbols") < 0.03)),
        ("case", vote(F.col("n_upper") / letters > 0.4, F.col("n_upper") / letters < 0.15)),
        ("repeats", vote(share("n_repeat_words") > 0.5, share("n_repeat_words") < 0.15)),
        ("lines", vote((F.col("n_lines") > 3) & (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)) > 0.4), (F.col("n_lines") > 3) & (F.col("n_dup_lines") == 0))),
        ("word_size", vote((mean < 2) | (mean > 14), mean.between(3, 10))),
        ("stop_words", vote((F.col("n_words") >= 50) & (share("n_stop") < 0.005), share("n_stop") >= 0.04)),
        ("marks", vote(share("n_marks") > 0.2, share("n_marks") < 0.02)),
        ("variety", vote((F.col("n_words") >= 50) & (share("n_distinct") < 0.1), share("n_distinct") > 0.25)),
        ("plain", vote(share("n_plain") < 0.5, share("n_plain") > 0.8)),
    ]


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Prior of ``good`` and P(vote | class) as [rule, class (bad, good), vote + 1], by EM over vote patterns.

    Classes are named by the start: a pattern with more bad votes starts as likely bad, and a
    Dirichlet prior says that rules are better than chance.  No labels are read.
    """
    bad, good = (patterns < 0).sum(1), (patterns > 0).sum(1)
    q = np.where(bad == 0, 0.95, np.where(bad >= 2, 0.05, 0.35))
    belief = np.array([[3.0, 1.0, 1.0], [0.05, 1.0, 3.0]])
    onehot = np.stack([patterns == v for v in (-1, 0, 1)], -1).astype(float)
    prior, p = 0.9, np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        for c, w in ((0, 1 - q), (1, q)):
            m = np.einsum("n,nrv->rv", w * counts, onehot) + belief[c]
            p[:, c] = m / m.sum(1, keepdims=True)
        prior = (float((q * counts).sum()) + 9) / (counts.sum() + 10)
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + np.einsum("nrv,rv->n", onehot, np.log(p[:, 1] / p[:, 0])), -500, 500)))
        done, q = np.abs(new - q).max(initial=0) < 1e-9, new
        if done:
            break
    return prior, p


def model(counted: DataFrame) -> Column:
    """P(good) as an expression over the features' columns, by EM over the vote patterns of ``counted``."""
    rules = votes()
    names = [f"vote_{k}" for k, _ in rules]
    table = counted.select(*(v.cast("int").alias(n) for n, (_, v) in zip(names, rules, strict=True))).groupBy(*names).count().collect()  # at most 3**10 rows
    if table:
        prior, p = fit(np.array([[r[n] for n in names] for r in table]), np.array([r["count"] for r in table], float))
    else:
        prior, p = 0.5, np.full((len(names), 2, 3), 1 / 3)
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for j, (_, vote) in enumerate(rules):
        weigh = [float(np.log(p[j, 1, v] / p[j, 0, v])) for v in range(3)]
        odds = odds + F.when(vote == -1, weigh[0]).when(vote == 0, weigh[1]).otherwise(weigh[2])
    return 1 / (1 + F.exp(-odds))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: the base counts, ``base_failed``, the rules' votes, ``p_good`` and ``kept``."""
    counted = cut(docs.select("doc_id", "text").mapInArrow(_features(["doc_id"]), f"doc_id {dict(docs.dtypes)['doc_id']}, {FEATURES}"))
    p_good = model(counted)
    return counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          base_failed().alias("base_failed"), (~base_failed() & (p_good >= threshold)).alias("kept"), p_good.alias("p_good"),
                          *(v.cast("int").alias(f"vote_{k}") for k, v in votes()))


def filtered(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their columns.  Texts are never shuffled: they are counted once for the model and
    once more to apply it."""
    columns = docs.columns
    inner = [f"_c{k}" for k in range(len(columns))]  # input columns may have any name
    own = docs.toDF(*inner)
    texts = own.withColumnRenamed(inner[columns.index("text")], "text")
    inner[columns.index("text")] = "text"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)
    p_good = model(cut(texts.select("text").mapInArrow(_features([]), FEATURES)))
    kept = texts.mapInArrow(_features(inner), f"{fields}, {FEATURES}").where(~base_failed() & (p_good >= threshold))
    return kept.select(*inner).toDF(*columns)
