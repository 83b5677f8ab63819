from __future__ import annotations

import re
from collections import Counter

from helpers import DOCS, documents, prose, rows_of, with_clashing

from loanweave.llm import decontamination

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def similarity(item: list[str], text: list[str]) -> float:
    """The best window of as many words, by its shingles' shared weight."""
    width = min(5, len(item))
    shingles = lambda w: Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    own, best = shingles(item), 0.0
    for start in range(len(text) - len(item) + 1):
        there = shingles(text[start : start + len(item)])
        shared = sum((own & there).values())
        best = max(best, shared / (sum(own.values()) + sum(there.values()) - shared))
    return best


def items(spark):
    texts = [prose(500 + i, 15 + 4 * i) for i in range(12)] + ["two words", "Ä b c d", "", None, "again and " * 12]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame([*rows, rows[0], (None, prose(700, 20))], ITEMS)


def corpus():
    planted = prose(503, 27).split()
    near = [*planted[:3], "changed", *planted[4:]]
    far = [w if i % 6 else "else" for i, w in enumerate(planted)]
    texts = [prose(i, 80) for i in range(25)]
    texts += [f"{prose(1, 30)} {prose(503, 27).upper()}! {prose(2, 30)}", prose(505, 35), " ".join(near) + " end", " ".join(far), f"so {prose(500, 15)}, {prose(504, 31)}", None, "", "two words"]
    return [*texts, "many two, WORDS here", "again and " * 40, prose(9, 100_000) + " " + prose(510, 55), "ä B c d", "Ä b C d", prose(700, 20)]


def test_against_every_window(spark):
    rows, benchmark = items(spark)
    known = {i: words(t) for i, t in rows if words(t)} | {None: words(prose(700, 20))}
    for blocks in (20_000, 5):  # also in several passes
        found = decontamination.report(with_clashing(documents(spark, corpus())), benchmark, block_items=blocks).collect()
        assert len(found) == len(corpus())
        for r in found:
            text = corpus()[r["doc_id"]]
            if text and len(text) > 100_000:
                assert r["items"] == "10"
                continue
            scores = {i: similarity(w, words(text)) for i, w in known.items()}
            wanted = {i for i, s in scores.items() if s >= 0.8 - 1e-9}
            assert r["n_items"] == len(wanted) and r["contaminated"] == bool(wanted), text
            assert r["items"] == ",".join(str(i) for i in sorted(i for i in wanted if i is not None)), text
            assert abs(r["similarity"] - max((scores[i] for i in wanted), default=0.0)) < 1e-9


def test_clean_rows_stay_whole(spark):
    docs = with_clashing(documents(spark, corpus()))
    kept = decontamination.without_leaks(docs, items(spark)[1])
    assert kept.columns == docs.columns
    dirty = {r["doc_id"] for r in decontamination.report(docs, items(spark)[1]).filter("contaminated").collect()}
    assert rows_of(kept) == rows_of(docs.filter(~docs["doc_id"].isin(dirty))) and 5 <= len(dirty) <= 12


def test_empty(spark):
    none = spark.createDataFrame([], ITEMS)
    assert decontamination.without_leaks(spark.createDataFrame([], DOCS), items(spark)[1]).collect() == []
    assert decontamination.without_leaks(documents(spark, ["a", None, "a"]), none).count() == 3
