"""Hard negatives against brute force: nulls, ties, repeated rows, lengths, bounds and pruning."""

import math
from collections import Counter

import numpy as np
import pytest

from docshield.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, block long, score string"


def brute(rows, every=5):
    best = {}
    for i, v, lab, *_ in rows:
        if i is None or v is None or lab is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v])
        best[i] = min(best.get(i, row), row)
    out = []
    for a, (lab, v) in best.items():
        if a % every:
            continue
        s = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, own == lab) for i, (own, w) in best.items() if i != a and len(w) == len(v)]
        s.sort()
        for p, i, _ in [x for x in s if x[2]][:5]:
            fit = [x for x in s if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(a, i, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, dims))
    return [(i, [float(np.float32(x)) for x in centre[i % 6] + r.normal(scale=0.05, size=dims)], int(r.integers(0, 4)), 1, "x") for i in range(n)]


@pytest.mark.parametrize("sizes", [(4, 2, 3, 1, 2), (16, 8, 2, 2, 1)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    block, together, cell, cell_anchors, read = sizes
    for k, v in (("CELL", cell), ("CELL_ANCHORS", cell_anchors), ("READ", read)):
        monkeypatch.setattr(hardneg, k, v)
    rows = clustered(90, 6, 3)
    rows += [(i, rows[0][1], i % 3, 1, "x") for i in range(100, 120)]  # a hot vector: ties
    rows += [rows[5], rows[5], (200, None, 1, 1, "x"), (201, [1.0] * 6, None, 1, "x"), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, 1, "x"),
             (203, [float("nan")] + [0.0] * 5, 1, 1, "x"), (204, [float("inf")] + [0.0] * 5, 1, 1, "x"), (None, [1.0] * 6, 1, 1, "x"),
             (205, [0.5, 0.25], 2, 1, "x"), (206, [0.5, 0.5], 2, 1, "x"), (208, [0.25, 0.25], 3, 1, "x"), (210, [0.0] * 6, 3, 1, "x"), (215, [], 1, 1, "x")]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), 5, block, together)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_large_components_are_exact_and_overflow_is_an_error(spark):
    rows = [(i, [float(4_000_000 + 3 * i), -float(i), 1.0], i % 2, 1, "x") for i in range(12)]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, SCHEMA), 5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    far = [(i, [1e30, 1.0], i % 2, 1, "x") for i in range(8)]
    with pytest.raises(Exception, match="32 bits"):
        hardneg.hard_negatives(spark.createDataFrame(far, SCHEMA), 5).collect()


def test_empty_table(spark):
    assert hardneg.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bounds_hold_every_score_and_blocks_are_skipped(spark):
    rows = clustered(960, 8, 5)
    blocks = hardneg.blocks_of(hardneg.quantised(spark.createDataFrame(rows, SCHEMA)), 8)
    for b in blocks.collect():
        x = hardneg._matrix(b.vecs, b.dim, len(b.ids))
        least, most = hardneg.bounds(x[:3], np.array([b.lo]), np.array([b.hi]))
        s = x[:3].astype(int) @ x.astype(int).T
        assert (s >= least).all() and (s <= most).all()
    anchors = hardneg.anchors_of(blocks, 5, 2)
    n = blocks.count()
    asked = hardneg._packed(anchors.withColumns({"lows": hardneg.F.array(hardneg.F.lit(300_000)), "highs": hardneg.F.array(hardneg.F.lit(hardneg.FAR))}))
    pairs = hardneg._choose(asked, blocks, (n, asked.count()), True, False).count()
    assert 0 < pairs < 0.5 * sum(c * c for c in Counter(b.label for b in blocks.collect()).values()) * asked.count() / n  # of the label's own blocks


def test_curve_neighbours_differ_in_one_cell():
    cells = np.stack(np.meshgrid(*[np.arange(4)] * 3), -1).reshape(-1, 3)
    key = hardneg.hilbert(cells, 2)
    order = sorted(range(len(cells)), key=lambda k: key[k].tobytes())
    steps = np.abs(np.diff(cells[order], axis=0)).sum(axis=1)
    assert (steps == 1).all() and len({key[k].tobytes() for k in order}) == 64
