from __future__ import annotations

import math
import random
import struct

import numpy as np
import pytest

from loanweave.llm import hard_negatives

ROWS = "vec_id long, embedding array<float>, label int, score int, rank string, place int"


def brute(rows, every=100):
    usable = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    found = []
    for a, v, label in {(i, tuple(v), label) for i, v, label in usable if i % every == 0}:
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, k) for i, w, k in usable if i != a and len(w) == len(v))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            fit = [(t, n) for t, n, k in scored if k != label and 30 * -s <= 100 * -t <= 90 * -s]
            found += [(a, p, r + 1, n, -s, -t) for r, (t, n) in enumerate(fit[:10])]
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 0, "", 0) for i, v, label in rows], ROWS)


def floats(rng, n, spread=0.3):
    return [struct.unpack("f", struct.pack("f", rng.gauss(0, spread)))[0] for _ in range(n)]


@pytest.mark.parametrize(("size", "page"), [(16, 1 << 19), (70, 500), (3, 20)])
def test_against_all_pairs(spark, monkeypatch, size, page):
    rng = random.Random(size)
    rows = [(i, floats(rng, size), rng.randrange(10)) for i in range(600)]
    rows += [(1000 + i, rows[200][1], 3) for i in range(30)]  # ties
    rows += [(700 + i, [0.0] * size, i % 10) for i in range(5)]  # nothing to normalise
    rows += [(800, None, 1), (801, [None] * size, 1), (900, [float("nan")] * size, 1), (1100, [float("inf")] * size, 1), (1200, floats(rng, size), None), (None, floats(rng, size), 1)]
    rows += [(1300, [0.5] * 4, 1), (1301, [0.4] * 4, 1), (1302, [0.2] * 4, 2), (1400, [], 1), (1401, [], 1), (1402, [], 2), (1500, [9e4] * size, 1), (1501, [8e4] * size, 1), (1502, [4e4] * size, 2), (-100, floats(rng, size), -3)]
    monkeypatch.setattr(hard_negatives, "PAGE_VALUES", page)
    found = hard_negatives.mine(frame(spark, rows).repartition(4))
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(map(tuple, found.collect()))
    assert got == brute(rows) and len(got) > 100


def test_repeated_rows_and_several_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, floats(rng, 8), rng.randrange(3)) for i in range(300)]
    rows += [rows[100], rows[7], rows[7], rows[31]]
    wanted = brute(rows, every=10)
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), every=10).collect())) == wanted
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 16)
    assert sorted(map(tuple, hard_negatives.mine(frame(spark, rows), every=10).collect())) == wanted


def test_intervals_hold_and_become_narrow():
    rng = np.random.default_rng(4)
    vectors = rng.normal(0, 60, (500, 64)).round().astype(np.int64)
    centre = vectors.mean(axis=0)
    codes = hard_negatives.encode(vectors, centre)
    widths = []
    for q in vectors[:20]:
        true = vectors @ q
        steps = hard_negatives.Question(q, centre).intervals(codes, np.arange(500))
        at, low, high = next(steps)
        mean = []
        while low is not None:
            assert (low <= true[at]).all() and (true[at] <= high).all()
            mean.append((high - low).mean())
            at, low, high = steps.send(np.ones(len(at), bool))
        widths.append(mean)
    widths = np.mean(widths, axis=0)
    assert (np.diff(widths) < 0).all() and widths[-1] < 0.3 * widths[0]


def test_few_vectors_are_scored():
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 32, (8000, 64)).round().astype(np.int64)
    codes, best = hard_negatives.encode(vectors, np.zeros(64)), hard_negatives._Best(5)
    at = hard_negatives._sifted(hard_negatives.Question(vectors[0], np.zeros(64)), codes, np.arange(1, 8000), lambda low, high: high >= best.sure(low))
    assert len(at) < 1000
    assert set(np.argsort(-(vectors[1:] @ vectors[0]), kind="stable")[:5] + 1) <= set(at.tolist())


def test_empty(spark):
    assert hard_negatives.mine(frame(spark, [])).collect() == []
    assert hard_negatives.mine(frame(spark, [(1, [1.0], 0)])).collect() == []
    assert hard_negatives.mine(frame(spark, [(0, [1.0], 0)])).collect() == []
