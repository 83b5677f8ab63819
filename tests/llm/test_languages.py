from __future__ import annotations

import random

import numpy as np
import pytest

from helpers import DOCS, crc_remainder, documents, rows_of, with_clashing
from loanweave.llm import languages

STEMS = {
    "en": "the of and ing tion er ly with house water think through night stone".split(),
    "de": "der und sch ung keit ein zu über straße nicht wasser haus ßen gegen".split(),
    "fr": "le des eau été ment tion qu'il où ça maison être dans sur elle".split(),
}


def text(lang, seed, words=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(STEMS[lang]) + rng.choice(STEMS[lang]) for _ in range(words))


def corpus(spark, n=240):
    rows = [(i, text(lang, i, 4 + i % 90), lang, "s", 0) for i, lang in enumerate(list(STEMS) * (n // 3))]
    return spark.createDataFrame(rows, DOCS), rows


def spectrum(window: bytes) -> set[int]:
    found = set()
    for size in range(1, languages.LONGEST + 1):
        for i in range(len(window) - size + 1):
            key = int.from_bytes(window[i : i + size], "big") + (size << 40)
            found.add((key * 0x9E3779B97F4A7C15) % (1 << 64) >> (64 - languages.FEATURE_BITS))
    return found


def windows(raw: bytes) -> list[bytes]:
    step = languages.WINDOW - languages.LONGEST + 1
    return [raw[a : a + languages.WINDOW] for a in range(0, max(len(raw) - languages.LONGEST + 1, 1), step)] if raw else []


def plain_answers(machine, raw: bytes) -> np.ndarray:
    """Mean over the windows, from sets and sums."""
    landmarks = [set(np.flatnonzero(r).tolist()) for r in np.unpackbits(machine.packed, axis=1)]
    total, weight = np.zeros(len(machine.languages)), 0
    for w in windows(raw):
        own = spectrum(w)
        kernel = [len(own & other) / (len(own) * len(other)) ** 0.5 for other in landmarks]
        total += (np.array(kernel) @ machine.weights + machine.offset) * len(w)
        weight += len(w)
    return total / weight


def test_against_sets_of_sequences(spark):
    docs, rows = corpus(spark)
    rows = rows + [(1000 + i, text(lang, i, 1500) + text("en", i, 300 * i), lang, "s", 0) for i, lang in enumerate(list(STEMS) * 2)]  # several windows
    docs = spark.createDataFrame(rows, DOCS)
    machine = languages.learn(languages.sample(docs))
    found = {r["doc_id"]: r for r in languages.identify(docs).collect()}
    for i, t, *_ in rows[::7] + rows[-6:]:
        answers = plain_answers(machine, t.lower().encode())
        best = int(answers.argmax())
        assert found[i]["lang_pred"] == machine.languages[best]
        assert found[i]["score"] == pytest.approx(min(1, max(0, (answers[best] + 1) / 2)), abs=1e-4)


def test_ridge_regression_is_solved():
    """With all windows as landmarks, Nyström's coordinates are exact and the answers are those of the full kernel's ridge regression."""
    texts = [(text(lang, i, 12), lang) for i, lang in enumerate(["de", "en"] * 12)]
    machine = languages.learn(texts)
    rows = np.concatenate([r for t, _ in texts for _, r in languages.presences(np.frombuffer(t.lower().encode(), np.uint8), *languages._windows(np.array([0, len(t.lower().encode())]))[:2])])
    size = rows.sum(axis=1)
    kernel = rows @ rows.T / np.sqrt(np.outer(size, size))
    n = len(rows)
    wanted = np.array([[1.0, -1.0] if lang == "de" else [-1.0, 1.0] for _, lang in texts])
    middle = np.eye(n) - 1 / n
    dual = np.linalg.solve(middle @ kernel @ middle + languages.RIDGE * (n / 2) * np.eye(n), wanted - wanted.mean(axis=0))
    full = middle @ kernel @ middle @ dual + wanted.mean(axis=0)
    assert machine.answers(rows) == pytest.approx(full, abs=1e-3)


def test_held_out_texts(spark):
    docs, rows = corpus(spark, 600)
    truth = {r[0]: r[2] for r in rows}
    found = languages.identify(docs).collect()
    assert all(r["held_out"] == (crc_remainder(r["doc_id"], 4) == 2) for r in found)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in found if r["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_held_out_languages_are_not_learned(spark):
    docs, rows = corpus(spark)
    other = spark.createDataFrame([(i, t, "xx" if crc_remainder(i, 4) == 2 else lang, s, n) for i, t, lang, s, n in rows], DOCS)
    assert rows_of(languages.identify(docs)) == rows_of(languages.identify(other))


def test_odd_texts(spark):
    docs, rows = corpus(spark)
    odd = documents(spark, [None, "", " ... 12 ###", (None, text("de", 1)), text("fr", 2), text("fr", 2), text("en", 3) * 20_000, "中文"], first=5000)
    found = languages.identify(with_clashing(docs.unionByName(odd.selectExpr("doc_id", "text", "NULL AS lang", "source", "n_chars"))))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], round(r["score"], 9)))
    assert got[5000] == got[5001] == got[5002] == [("und", 0.0)]
    assert got[None][0][0] == "de" and got[5004] == got[5005] and got[5004][0][0] == "fr" and got[5006][0][0] == "en"
    assert got[5007][0][0] in STEMS


def test_nothing_to_learn(spark):
    assert languages.identify(documents(spark, [])).collect() == []
    found = languages.identify(spark.createDataFrame([(1, "some text", None, "s", 9)], DOCS)).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("und", 0.0)]
