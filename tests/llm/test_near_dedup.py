from __future__ import annotations

import random

import pytest
import xxhash
from helpers import DOCS, documents, prose, rows_of, with_clashing

from loanweave.llm import near_dedup


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [0] * 64
    for shingle in shingles:
        h = xxhash.xxh64_intdigest(shingle, 42)
        for bit in range(64):
            votes[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(shingles))


def components(prints: list[tuple]) -> list[tuple]:
    """Smallest id by following links between all pairs."""
    group = list(range(len(prints)))

    def root(x: int) -> int:
        while group[x] != x:
            x = group[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 4:
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [least.get(root(i)) for i in range(len(prints))]


def corpus() -> list[tuple]:
    rng, rows = random.Random(3), []
    for i in range(40):
        text = prose(i, rng.choice([2, 4, 30, 200]))
        rows.append((1000 - i, text))
        for j in range(rng.choice([0, 0, 2, 6])):
            words = text.split()
            words[rng.randrange(len(words))] = f"new{j}"
            rows.append((2000 + 10 * i + j, " ".join(words)))
    return rows + [(5, None), (9, ""), (7, " \n\t"), (None, "x"), (None, None), (rows[0][0], rows[0][1]), (3, rows[0][1].upper()), (4, "ÄÖ É ñ ß"), (6, "a b"), (8, "wide words " * 20_000)]


@pytest.mark.parametrize("long_list", [1024, 1])
def test_against_all_pairs(spark, long_list):
    """Also with nearly all lists taken as long ones, which links go around pairs."""
    rows = corpus()
    wanted = components([(i, fingerprint(t)) for i, t in rows])
    found = near_dedup.near_duplicates(with_clashing(documents(spark, rows)), long_list)
    assert rows_of(found) == sorted(((i, f"{fingerprint(t):016x}", c) for (i, t), c in zip(rows, wanted, strict=True)), key=repr)


def test_one_of_each_stays(spark):
    """One row of each component; rows that share an id but not a text are apart, rows without an id come last."""
    rows = [*corpus(), (3, "another text under one id with some more words"), (None, "no id here at all but words"), (None, "no id here at all but words"), (None, corpus()[0][1])]
    docs = with_clashing(documents(spark, rows))
    kept = near_dedup.without_copies(docs)
    assert kept.columns == docs.columns
    found = [tuple(r) for r in kept.select("doc_id", "text").collect()]
    place = {g: [] for g in range(len(rows))}
    groups = components([(n, fingerprint(t)) for n, (_, t) in enumerate(rows)])
    for n, g in enumerate(groups):
        place[g].append(rows[n])
    wanted = [g for g in place.values() if g]
    assert len(found) == len(wanted)
    for members in wanted:
        (row,) = [r for r in found if r in members]
        ids = [i for i, _ in members if i is not None]
        assert row[0] == (min(ids) if ids else None)


def test_very_many_wordless_texts(spark):
    docs = documents(spark, ["", None, " \n"] * 2000 + [prose(i, 40) for i in range(50)])
    found = near_dedup.near_duplicates(docs).collect()
    assert len(found) == 6050 and {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {0}
    assert near_dedup.without_copies(docs).count() == len({r["component_id"] for r in found})


def test_empty(spark):
    empty = spark.createDataFrame([], DOCS)
    assert near_dedup.near_duplicates(empty).collect() == [] and near_dedup.without_copies(empty).collect() == []
