"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

The network reads words. A word's input joins a vector of the whole word and the mean vector of its character sequences, both found by
hashing. A long run without spaces or ASCII punctuation (a Chinese text, say) is read as overlapping pieces, each a word. Windows of 64 words that overlap by 8 cover the whole text. Two recurrent passes run over a window, attention weighs
their states, and the pooled state gives the window's probability; a document scores its worst window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import SpanHash, chunks, lowered, word_spans
from loanweave.llm.learning import Adam, held_out, labelled_sample, sigmoid

WINDOW, STEP, HIDDEN, DIMS, ATTENTION = 64, 56, 8, 8, 8
WORD_ROWS, CHAR_ROWS, GRAMS = 1 << 15, 1 << 15, (4, 5)
#: Bytes of a piece of a long word at most; pieces overlap, so that each character sequence lies within one.
PIECE, OVERLAP = 27, max(GRAMS) - 1
WINDOWS_AT_A_TIME = 1024
_WORD = np.ones(256, bool)
_WORD[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = False


def _pieces(starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of words with the long ones in pieces, which are pieces, and which of them go on with a word."""
    step = PIECE - OVERLAP
    count = np.maximum(1, -(-(ends - starts - OVERLAP) // step))
    of = np.repeat(np.arange(len(starts)), count)
    number = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    begin = starts[of] + number * step
    return begin, np.minimum(begin + PIECE, ends[of]), text[of], count[of] > 1, number > 0


class Text:
    """Words of several texts: each word's number among the distinct ones, the inputs of those, and the windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = lowered(data)
        starts, ends, text = word_spans(data, offsets, _WORD)
        hashes = SpanHash(data)
        starts, ends, text, piece, goes_on = _pieces(starts, ends, text)
        own = hashes.of(starts, ends) ^ (piece * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (goes_on * np.uint64(0x9E3779B97F4A7C15))
        words, first, self.word = np.unique(own, return_index=True, return_inverse=True)
        # Where a piece is cut says nothing, so all pieces share a row as words and are told by their character sequences.
        self.rows = np.where(piece[first], 0, (words >> np.uint64(40)).astype(np.int64) % WORD_ROWS)
        # Every character sequence of a distinct word, the word's edges counting as characters by marking the sequences there.
        length = ends[first] - starts[first]
        self.grams = []  # of each size: words that have some, how many, and the rows of all
        for size in GRAMS:
            count = np.maximum(length - size + 1, 0)
            some = np.flatnonzero(count)
            count = count[some]
            of = np.repeat(some, count)
            within = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            at = starts[first][of] + within
            rows = (hashes.of(at, at + size) >> np.uint64(40)).astype(np.int64) * 2 + ((within == 0) & ~goes_on[first][of])
            self.grams.append((some, count, rows % CHAR_ROWS))
        total = np.bincount(text, minlength=len(offsets) - 1)
        begin = np.concatenate([[0], np.cumsum(total)])
        count = np.maximum(1, -(-(total - WINDOW) // STEP) + 1)
        self.upto = np.concatenate([[0], np.cumsum(count)])
        self.owner = np.repeat(np.arange(len(total)), count)
        self.start = begin[self.owner] + (np.arange(self.upto[-1]) - self.upto[self.owner]) * STEP
        self.length = np.clip(begin[self.owner + 1] - self.start, 0, WINDOW)

    def inputs(self, model: dict[str, np.ndarray]) -> np.ndarray:
        """A distinct word's vector: the word's own, and the mean and the largest (at least 0) of its character sequences'."""
        chars = np.zeros((len(self.rows), 2 * DIMS), np.float32)
        for some, count, rows in self.grams:
            if len(some):
                at = np.cumsum(count) - count
                vectors = model["chars"].take(rows, axis=0)
                chars[some, :DIMS] += np.add.reduceat(vectors, at, axis=0) / (count[:, None] * len(GRAMS))
                chars[some, DIMS:] = np.maximum(chars[some, DIMS:], np.maximum.reduceat(vectors, at, axis=0))
        return np.concatenate([model["words"].take(self.rows, axis=0), chars], axis=1)

    def window_words(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of the windows by place (words, windows), and which places are filled."""
        place = np.arange(WINDOW)[:, None]
        filled = place < self.length[some]
        at = np.where(filled, self.start[some] + place, 0)
        return (self.word[at] if len(self.word) else at), filled


def _passes(model: dict[str, np.ndarray], gates: np.ndarray, words: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """States of both passes (places, windows, 2 * HIDDEN). Windows come by length, so those that fill a place are the last ones;
    the others' states stay as they are."""
    steps, n = words.shape
    states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
    kept = {}
    for d, order in ((0, range(steps)), (1, range(steps - 1, -1, -1))):
        whole = np.zeros((n, HIDDEN), np.float32)
        u, own = model[f"u{d}"], np.ascontiguousarray(gates[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN])
        for t in order:
            at = int(np.searchsorted(lengths, t, "right"))
            h = whole[at:]
            x = own.take(words[t, at:], axis=0)
            hu = h @ u
            zr = x[:, : 2 * HIDDEN]
            zr += hu[:, : 2 * HIDDEN]
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            c = x[:, 2 * HIDDEN :]
            c += zr[:, HIDDEN:] * hu[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep:
                kept[d, t] = (at, h.copy(), zr[:, :HIDDEN], zr[:, HIDDEN:], c, hu)
            h -= c
            h *= zr[:, :HIDDEN]
            h += c
            states[t, :, d * HIDDEN : (d + 1) * HIDDEN] = whole
    return states, kept


def _attended(model: dict[str, np.ndarray], states: np.ndarray, filled: np.ndarray):
    """The states' mean by attention, its weights, and the hidden layer that they come from."""
    flat = states.reshape(-1, 2 * HIDDEN) @ model["look"]
    flat += model["look_shift"]
    np.tanh(flat, out=flat)
    scores = np.where(filled, (flat @ model["weigh"]).reshape(filled.shape), -1e9)
    scores = np.exp(scores - scores.max(axis=0)) * filled
    weights = (scores / np.maximum(scores.sum(axis=0), 1e-9)).astype(np.float32)
    return (weights[:, :, None] * states).sum(axis=0), weights, flat.reshape(*filled.shape, ATTENTION)


def window_logits(model: dict[str, np.ndarray], text: Text) -> np.ndarray:
    gates = text.inputs(model) @ model["in"] + model["in_shift"] if len(text.rows) else np.zeros((1, 6 * HIDDEN), np.float32)
    found = np.zeros(len(text.start), np.float32)
    order = np.argsort(text.length, kind="stable")  # windows of like length together
    for low in range(0, len(order), WINDOWS_AT_A_TIME):
        some = order[low : low + WINDOWS_AT_A_TIME]
        words, filled = text.window_words(some)
        most = max(1, int(text.length[some].max()))
        states, _ = _passes(model, gates, words[:most], text.length[some])
        pooled, _, _ = _attended(model, states, filled[:most])
        found[some] = pooled @ model["out"] + model["shift"][0]
    return found


def toxic_logits(model: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    text = Text(data, offsets)
    return np.maximum.reduceat(window_logits(model, text), text.upto[:-1])


def _learn(model: dict[str, np.ndarray], text: Text, some: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the windows' cross entropy; the windows come by length."""
    inputs = text.inputs(model)
    gates = inputs @ model["in"] + model["in_shift"]
    words, filled = text.window_words(some)
    states, kept = _passes(model, gates, words, text.length[some], True)
    pooled, weights, hidden = _attended(model, states, filled)
    wrong = ((sigmoid(pooled @ model["out"] + model["shift"][0]) - toxic) * weight).astype(np.float32)
    given = {k: np.zeros_like(v) for k, v in model.items()}
    given["out"], given["shift"] = pooled.T @ wrong, wrong.sum(keepdims=True)
    d_pooled = wrong[:, None] * model["out"]
    d_weights = np.einsum("nd,tnd->tn", d_pooled, states)
    d_states = weights[:, :, None] * d_pooled
    d_scores = weights * (d_weights - (weights * d_weights).sum(axis=0))
    given["weigh"] = np.einsum("tn,tna->a", d_scores, hidden)
    d_hidden = d_scores[:, :, None] * model["weigh"] * (1 - hidden**2)
    given["look"] = np.einsum("tnd,tna->da", states, d_hidden)
    given["look_shift"] = d_hidden.sum(axis=(0, 1))
    d_states += d_hidden @ model["look"].T
    d_gates = np.zeros_like(gates)
    steps = len(words)
    for d, order in ((0, range(steps - 1, -1, -1)), (1, range(steps))):
        u = model[f"u{d}"]
        d_h = np.zeros((len(some), HIDDEN), np.float32)
        for t in order:
            at, h, z, r, c, hu = kept[d, t]
            d_h += d_states[t, :, d * HIDDEN : (d + 1) * HIDDEN]
            g = d_h[at:]
            d_c = g * (1 - z) * (1 - c**2)
            d_z = g * (h - c) * z * (1 - z)
            d_r = d_c * hu[:, 2 * HIDDEN :] * r * (1 - r)
            d_hu = np.concatenate([d_z, d_r, d_c * r], axis=1)
            given[f"u{d}"] += h.T @ d_hu
            np.add.at(d_gates, (words[t, at:], slice(d * 3 * HIDDEN, (d + 1) * 3 * HIDDEN)), np.concatenate([d_z, d_r, d_c], axis=1))
            d_h[at:] = g * z + d_hu @ u.T
    given["in"], given["in_shift"] = inputs.T @ d_gates, d_gates.sum(axis=0)
    d_inputs = d_gates @ model["in"].T
    np.add.at(given["words"], text.rows, d_inputs[:, :DIMS])
    for own, count, rows in text.grams:  # through the means; the maxima follow the same vectors
        mean = d_inputs[own, DIMS : 2 * DIMS] / (count[:, None] * len(GRAMS))
        np.add.at(given["chars"], rows, np.repeat(mean, count, axis=0))
    return given


def _evidence(sample: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray]:
    """How much more often a word row and a character row occur in toxic documents, as a bounded log ratio: where learning starts."""
    seen = {"words": np.ones((2, WORD_ROWS)), "chars": np.ones((2, CHAR_ROWS))}
    documents = np.ones(2)
    for document, label in sample:
        data = np.frombuffer(document, np.uint8)
        text = Text(data, np.array([0, len(data)]))
        documents[label] += 1
        seen["words"][label, np.unique(text.rows)] += 1
        seen["chars"][label, np.unique(np.concatenate([rows for _, _, rows in text.grams]))] += 1
    return tuple(np.clip(np.log(v[1] / documents[1]) - np.log(v[0] / documents[0]), -1, 4).astype(np.float32) for v in (seen["words"], seen["chars"]))


def fit(sample: list[tuple[bytes, int]], epochs: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 6, least_steps: int = 300) -> dict[str, np.ndarray]:
    """Learns from texts labelled 1 (toxic) or 0. Of a toxic document its worst window so far is taught, of a clean one its worst two and another.

    A small sample is gone through more often, until ``least_steps`` steps are made.
    """
    rng = np.random.default_rng(seed)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    model = {
        "words": normal(0.05, WORD_ROWS, DIMS), "chars": normal(0.05, CHAR_ROWS, DIMS), "in": normal(0.3, 3 * DIMS, 6 * HIDDEN), "in_shift": np.zeros(6 * HIDDEN, np.float32),
        "u0": normal(0.3, HIDDEN, 3 * HIDDEN), "u1": normal(0.3, HIDDEN, 3 * HIDDEN), "look": normal(0.3, 2 * HIDDEN, ATTENTION), "look_shift": np.zeros(ATTENTION, np.float32),
        "weigh": normal(0.3, ATTENTION), "out": normal(0.3, 2 * HIDDEN), "shift": np.zeros(1, np.float32),
    }
    kinds = {y for _, y in sample}
    if len(kinds) < 2:  # nothing to tell apart: every text scores what the labels say
        model["out"][:] = 0
        model["shift"][0] = -3 if kinds != {1} else 3
        return model
    model["words"][:, 0], model["chars"][:, 0] = _evidence(sample)
    epochs = max(epochs, -(-least_steps * batch // len(sample)))
    adam = Adam(model, rate)
    share = float(np.mean([y for _, y in sample]))
    for epoch in range(epochs):
        order = rng.permutation(len(sample))
        for number, low in enumerate(range(0, len(order), batch)):
            adam.rate = rate * (1 - (epoch + low / len(order)) / epochs * 0.9)
            documents = [sample[i] for i in order[low : low + batch]]
            data = np.frombuffer(b"".join(t for t, _ in documents), np.uint8)
            text = Text(data, np.concatenate([[0], np.cumsum([len(t) for t, _ in documents])]))
            if not len(text.rows):
                continue
            logits = window_logits(model, text)
            some, toxic, weight = [], [], []
            for k, (_, y) in enumerate(documents):
                a, b = text.upto[k], text.upto[k + 1]
                worst = (a + np.argsort(-logits[a:b])[: 1 if y else 2]).tolist()
                for window in worst if y else {*worst, int(rng.integers(a, b))}:
                    if text.length[window]:
                        some.append(window)
                        toxic.append(y)
                        weight.append(0.5 / share if y else 0.5 / (1 - share))
            if some:
                order_by = np.argsort(text.length[some], kind="stable")
                some, toxic, weight = np.array(some)[order_by], np.array(toxic, np.float32)[order_by], np.array(weight, np.float32)[order_by]
                adam.move(_learn(model, text, some, toxic, weight / len(some)))
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; the score is the probability that the toxicity label is 1.

    Whole texts are read. Null texts score as empty ones. Rows that repeat, and rows with a null id, get a row each; a null id counts
    as empty in the fold and trains nothing. Without labels of both kinds all texts score alike. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, "toxic")))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = np.zeros(len(rows))
            for first, after, data, offsets in chunks(rows["text"]):
                found[first:after] = sigmoid(toxic_logits(sent.value, data, offsets).astype(np.float64))
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["held_out"], pa.array(found)], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(batch, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
