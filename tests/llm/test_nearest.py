from __future__ import annotations

import math
import random

import pytest

from loanweave.llm import nearest

ROWS = "vec_id long, embedding array<float>, label int, score int"


def brute(rows, k=5, every=50):
    usable = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    found = []
    for q, a in usable:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(found)


@pytest.mark.parametrize("page", [8192, 7])
def test_against_all_pairs(spark, monkeypatch, page):
    rng = random.Random(2)
    floats = lambda n: [rng.gauss(0, 0.3) for _ in range(n)]
    rows = [(i, floats(16)) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)]  # ties
    rows += [(400, None), (450, [None] * 16), (500, [float("nan")] * 16), (550, [float("inf")] * 16), (600, [0.1] * 3), (650, [0.2] * 3), (None, [0.5] * 16), (700, []), (701, []), (100, rows[100][1]), (750, [9e4] * 16)]
    import struct

    rows = [(i, None if v is None else [None if x is None else struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], ROWS).repartition(3)
    monkeypatch.setattr(nearest, "PAGE_ROWS", page)
    found = nearest.top_k(df)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(tuple(r) for r in found.collect())
    wanted = brute(rows)
    # A query that stands there twice is asked twice.
    assert sorted({(q, s) for q, _, _, s in got}) == sorted({(q, s) for q, _, _, s in wanted})
    assert [r for r in got if r[0] != 100] == [r for r in wanted if r[0] != 100]
    assert sorted((i, s) for q, _, i, s in got if q == 100) == sorted((i, s) for q, _, i, s in wanted if q == 100)


def test_several_blocks_of_queries(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], 0, 0) for i in range(200)]
    df = spark.createDataFrame(rows, ROWS)
    one = sorted(map(tuple, nearest.top_k(df, every=5).collect()))
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 16)
    assert sorted(map(tuple, nearest.top_k(df, every=5).collect())) == one


def test_empty(spark):
    assert nearest.top_k(spark.createDataFrame([], ROWS)).collect() == []
    assert nearest.top_k(spark.createDataFrame([(0, [1.0], 0, 0)], ROWS)).collect() == []
