from __future__ import annotations

import re
from collections import defaultdict

import pytest
from helpers import DOCS, documents, prose, rows_of, with_clashing

from loanweave.llm import mixing


def reshared(sizes: dict, share=1.5, weights=(3, 1, 2), most=2.0) -> dict:
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, left = dict.fromkeys(order, 0.0), set(), share * sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        if not rest:
            return target
        all_weight = sum(weight[s] for s in rest)
        target |= {s: left * weight[s] / all_weight for s in rest}
        above = [s for s in rest if target[s] > most * sizes[s]]
        if not above:
            return target
        for s in above:
            target[s] = most * sizes[s]
            full.add(s)
            left -= target[s]


def test_targets_and_takings(spark):
    texts = [prose(i, 3 + i * 7 % 90) for i in range(900)] + [None, "", " \t\n", "one"]
    sources = ["a", "b", "b", "b", "c", "é", "Z", None, "tiny"] + ["a"] * 9
    docs = documents(spark, texts, sources)
    found = mixing.mix_to_weights(docs).collect()
    assert len(found) == len(texts)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in found:
        assert r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    wanted = reshared(sizes)
    for r in found:
        assert r["target"] == pytest.approx(wanted[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in sizes)


def test_reruns_and_layouts_agree(spark):
    docs = documents(spark, [prose(i, 5 + i % 40) for i in range(400)], ["a", "b", "c"])
    assert rows_of(mixing.mix_to_weights(docs)) == rows_of(mixing.mix_to_weights(with_clashing(docs.repartition(7)).orderBy("text")))


def test_rounding_is_fair(spark):
    docs = documents(spark, [prose(i, 10) for i in range(60)], ["a", "b", "c"])
    copies = [sum(r["copies"] for r in mixing.mix_to_weights(docs, seed=s).collect() if r["doc_id"] == 4) for s in range(12)]
    assert set(copies) <= {0, 1} and 1 <= sum(copies) <= 11  # its rate is one half


def test_repeated_rows_get_decisions_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7)] * 40 + [(None, "a b", "en", "s", 3)] * 3, DOCS)
    found = mixing.mix_to_weights(docs).collect()
    assert len(found) == 43 and abs(sum(r["taken"] for r in found) - 1.5 * 166) <= 4 and {r["copies"] for r in found} == {1, 2}


def test_empty(spark):
    assert mixing.mix_to_weights(spark.createDataFrame([], DOCS)).collect() == []
    only_empty = mixing.mix_to_weights(documents(spark, [None, ""], [None])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in only_empty] == [(0, 0.0, 0)] * 2
