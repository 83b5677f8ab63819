from __future__ import annotations

import numpy as np
import pytest
from helpers import DOCS, crc_remainder, documents, prose, with_clashing

from loanweave.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark):
    texts, labels = [], []
    for i in range(320):
        text, good, toxic = prose(i, 30 + i % 200), 1, 0
        if i % 4 == 0:
            text, good = [text + "\n" + " ".join(w.upper() + "!!" for w in text.split()), "same " * 150][i // 4 % 2], 0
        if i % 5 == 1:
            words = text.split()
            for k in range(3):
                words.insert((i * 7 + k * 13) % len(words), ["grobnak", "vilthek"][(i + k) % 2])
            text, toxic = " ".join(words), 1
        texts.append(text)
        labels.append((i, good, toxic))
    return documents(spark, texts), spark.createDataFrame([*labels, (None, 1, 1), (4000, 0, None), (0, 0, 0)], LABELS)


@pytest.mark.parametrize(("module", "column"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy_and_odd_rows(spark, module, column):
    docs, labels = corpus(spark)
    odd = documents(spark, [(900, None), (901, ""), (None, "anden seta oner"), (2, "anden seta"), (2, "anden seta"), (902, "x" * 300_000), (903, prose(1, 150_000) + " " + "same " * 400 + " grobnak vilthek grobnak")])
    rows = module.classify(with_clashing(docs.unionByName(odd)), labels).collect()
    assert len(rows) == 327 and all(0 <= r["score"] <= 1 and r["held_out"] == (crc_remainder(r["doc_id"], 3) == 1) for r in rows)
    truth = {r["doc_id"]: r[column] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 900}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth and not (r["doc_id"] == 2)]
    assert len(held) > 60 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.95
    # What stands at the end of a very long text counts.
    assert next(r["predicted"] for r in rows if r["doc_id"] == 903) == (0 if column == "quality" else 1)
    threshold = 0.5 if column == "quality" else 0.7
    assert all(r["predicted"] == (r["score"] >= threshold) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (900, 901)}) == 1


@pytest.mark.parametrize("module", [quality, toxicity])
def test_empty_tables(spark, module):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert module.classify(docs, labels).collect() == []
    found = module.classify(documents(spark, ["a b", None, "c"]), labels).collect()
    assert len(found) == 3 and len({round(r["score"], 6) for r in found}) == 1


def test_reading_order_and_neighbours_do_not_matter():
    """A text scores the same alone and among others."""
    texts = [prose(i, 20 + 40 * i).encode() for i in range(6)] + [b"", "ñ é ß".encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    samples = [(prose(i, 50).encode() + (b" grobnak" if i % 2 else b""), i % 2) for i in range(60)]
    for logits, model in ((quality.bad_quality_logits, quality.fit(samples, epochs=1)), (toxicity.toxic_logits, toxicity.fit(samples, epochs=1))):
        together = logits(model, data, offsets)
        alone = [logits(model, np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
        assert np.allclose(together, alone, atol=1e-4)


def test_gradients():
    """The recurrent network's gradients against differences of the loss."""
    texts = [prose(3, 12), prose(4, 30)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    text = toxicity.Text(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    rng = np.random.default_rng(0)
    model = {k: v.astype(np.float64) for k, v in toxicity.fit([(prose(i, 20).encode(), i % 2) for i in range(8)], epochs=1).items()}
    some, toxic, weight = np.argsort(text.length, kind="stable"), np.array([1.0, 0.0]), np.array([0.5, 0.7])

    def loss() -> float:
        z = toxicity.window_logits(model, text)[some].astype(np.float64)
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum())

    given = toxicity._learn(model, text, some, toxic, weight)
    for name in ("in", "u0", "u1", "look", "weigh", "out", "shift", "in_shift"):
        at = tuple(rng.integers(0, n) for n in model[name].shape)
        kept = model[name][at]
        model[name][at] = kept + 1e-2
        high = loss()
        model[name][at] = kept - 1e-2
        low = loss()
        model[name][at] = kept
        assert given[name][at] == pytest.approx((high - low) / 2e-2, rel=0.05, abs=2e-3), name


def test_all_of_a_long_word_is_read():
    """A text without spaces or ASCII punctuation is one run; each of its byte sequences is read, and what is toxic amid it is found."""
    rng = np.random.default_rng(1)
    run = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x4E60, n)))
    for word in (run(3000).encode(), run(9).encode() + b"abcd", b"x" * 28 + bytes(range(97, 123))):
        text = toxicity.Text(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        hashes = toxicity.SpanHash(np.frombuffer(word, np.uint8))
        for size, (_, _, rows) in zip(toxicity.GRAMS, text.grams, strict=True):
            at = np.arange(len(word) - size + 1)
            wanted = ((hashes.of(at, at + size) >> np.uint64(40)).astype(np.int64) * 2 + (at == 0)) % toxicity.CHAR_ROWS
            assert set(wanted) == set(rows)
    joined = lambda seed, n, toxic: (prose(seed, n) + (" grobnak" if toxic else "") + " " + prose(seed + 1000, n)).replace(" ", "").encode()
    model = toxicity.fit([(joined(i, 15, i % 2), i % 2) for i in range(120)])
    texts = [joined(5000 + i // 2, 600, i % 2) for i in range(12)]  # each without and with the toxic word
    logits = toxicity.toxic_logits(model, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
    assert np.mean(logits[1::2] > logits[::2]) >= 0.8 and np.mean(logits[1::2] - logits[::2]) > 1
