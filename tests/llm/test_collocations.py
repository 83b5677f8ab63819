from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from helpers import documents, with_clashing
from loanweave.llm import collocations

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold, best=2000, longest=5):
    """Rows of (lang, text), counted phrase by phrase."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII_LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang or "und"][tuple(words[i : i + size])] += 1
    found = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= threshold}
        n, scored = totals[lang], []
        for p, a in candidates.items():
            inside = any(f2 >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, f2 in candidates.items())
            if not inside:
                score, _, left, right = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        found += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:best])]
    return sorted(found)


def texts(seed, n):
    rng = random.Random(seed)
    phrases = ["New York City", "as\tsoon  as possible", "in the end", "état de l'art", "a a a a"]
    words = "the of in end new york a as état x\x1cy ÀB   ,".split(" ")
    return [" ".join(rng.choice(phrases if rng.random() < 0.3 else words) + rng.choice(["", "", "", ".", ";", "\n", "\x0b"]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize(("threshold", "capacity"), [(12, None), (12, 5), (3, None), (500, None)])
def test_against_counting_every_phrase(spark, threshold, capacity):
    rows = [(random.Random(i).choice(["en", "de", None]), t) for i, t in enumerate(texts(1, 150))] + [("en", None), ("fr", ""), ("fr", "  . ,"), (None, "und und und")]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = sorted(map(tuple, collocations.mine(with_clashing(docs), threshold, best=40, capacity=capacity).collect()))
    assert found == brute(rows, threshold, best=40)


def test_long_text_and_repeated_rows(spark):
    long = "alpha beta gamma " * 200_000 + "Alpha Beta."  # over 3 MB in one piece
    rows = [("en", long), ("en", long)]
    found = sorted(map(tuple, collocations.mine(documents(spark, [long, long])).collect()))
    a = 2 * 200_000
    # 5-word phrases: alpha..beta a times less two, the two others two fewer again but for the end.
    totals = {r[2]: r[3] for r in found}
    assert totals == {"alpha beta gamma alpha beta": a, "beta gamma alpha beta gamma": a - 2, "gamma alpha beta gamma alpha": a - 2} | {k: v for k, v in totals.items() if len(k.split()) < 5}
    assert all(r[6] == 2 * (600_000 + 2) for r in found) and rows


def test_merged_summaries_keep_what_is_frequent():
    import numpy as np

    rng = np.random.default_rng(3)
    keys = np.concatenate([np.repeat(np.arange(20), 150), rng.integers(1000, 9000, 30_000)]).astype(np.uint64)
    rng.shuffle(keys)
    one, subtracted = collocations.Summary(len(keys) // 100 + 1), 0
    for part in np.array_split(keys, 40):
        other = collocations.Summary(len(keys) // 100 + 1)
        other.add(part, np.ones(len(part), np.int64))
        other.settle()
        subtracted += other.subtracted
        one.add(other.keys, other.counts)
        one.settle()
        assert len(one.keys) <= one.capacity
    subtracted += one.subtracted
    assert 0 < subtracted < 100
    assert set(range(20)) <= set(one.keys.tolist())
    true = Counter(keys.tolist())
    assert all(true[k] - subtracted <= c <= true[k] for k, c in zip(one.keys.tolist(), one.counts.tolist(), strict=True))


def test_empty(spark):
    assert collocations.mine(documents(spark, [])).collect() == []
    assert collocations.mine(documents(spark, [None, "", "one two"])).collect() == []
