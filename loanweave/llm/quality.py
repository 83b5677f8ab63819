"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters slide over the bytes of a document. Their largest answers in each cell of 64 bytes are averaged over chunks of 16
cells that overlap by half and cover the whole text; the largest average over the chunks is combined into one probability. Besides
its bytes, a position tells the filters whether the next eight bytes stood there a few bytes before, as in endless repetition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import chunks
from loanweave.llm.learning import Adam, held_out, labelled_sample, sigmoid

WIDTH, STRIDE, CELL, CHUNK_CELLS, CHUNK_STEP, FILTERS, LAGS = 8, 4, 64, 16, 8, 16, range(2, 33)
#: Zeros before each text, so that nothing looks into another one.
LEAD = 40
PER_CELL = CELL // STRIDE


def _laid_out(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts in cells of their own, with zeros around them; and each text's first cell (with the total at the end)."""
    cells = -(-(np.diff(offsets) + LEAD) // CELL)
    first = np.concatenate([[0], np.cumsum(cells)])
    out = np.zeros(first[-1] * CELL + WIDTH, np.uint8)
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        at = first[k] * CELL + LEAD
        out[at : at + b - a] = data[a:b]
    return out, first


def _repeats(laid: np.ndarray, low: int, high: int) -> np.ndarray:
    """For each position (every STRIDE bytes) from ``low`` to ``high``: 1 if its eight bytes also stood 2 to 32 bytes before."""
    back = max(0, low - LAGS[-1])
    part = laid[back : high + WIDTH]
    eight = np.lib.stride_tricks.sliding_window_view(part, 8)
    eight = np.ascontiguousarray(eight).view(np.uint64).reshape(-1)
    at = np.arange(low - back, high - back, STRIDE)
    here = eight[at]
    found = np.zeros(len(at), bool)
    for lag in LAGS:
        found |= (here == eight[np.maximum(at - lag, 0)]) & (at >= lag)
    return (found & (here != 0)).astype(np.float32)


def _cell_maxima(laid: np.ndarray, model: dict[str, np.ndarray], want_argmax: bool = False):
    """The largest answer of each filter in each cell, never below 0; and where it was."""
    n_cells = (len(laid) - WIDTH) // CELL
    best = np.zeros((n_cells, FILTERS), np.float32)
    where = np.zeros((n_cells, FILTERS), np.int64) if want_argmax else None
    repeats = []
    step = 512  # cells at a time
    for low in range(0, n_cells, step):
        high = min(n_cells, low + step)
        at = np.arange(low * CELL, high * CELL, STRIDE)
        repeat = _repeats(laid, low * CELL, high * CELL)
        answers = model["bias"] + repeat[:, None] * model["repeat"]
        for k in range(WIDTH):
            answers += model["bytes"][k].take(laid[at + k], axis=0)
        answers = answers.reshape(high - low, PER_CELL, FILTERS)
        best[low:high] = np.maximum(answers.max(axis=1), 0)
        if want_argmax:
            where[low:high] = answers.argmax(axis=1) * STRIDE + np.arange(low, high)[:, None] * CELL
            repeats.append(repeat)
    return best, where, np.concatenate(repeats) if repeats else None


def _chunks_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First cell and cell after the last of each chunk, and the chunks' number up to each text."""
    total = np.diff(first)
    count = np.maximum(1, -(-(total - CHUNK_CELLS) // CHUNK_STEP) + 1)
    upto = np.concatenate([[0], np.cumsum(count)])
    owner = np.repeat(np.arange(len(total)), count)
    start = first[owner] + (np.arange(upto[-1]) - upto[owner]) * CHUNK_STEP
    return start, np.minimum(start + CHUNK_CELLS, first[owner + 1]), upto


def _pooled(best: np.ndarray, first: np.ndarray):
    """Chunk averages of the cell maxima, and their maxima by text."""
    start, after, upto = _chunks_of(first)
    sums = np.concatenate([np.zeros((1, FILTERS)), np.cumsum(best, axis=0, dtype=np.float64)])
    means = ((sums[after] - sums[start]) / (after - start)[:, None]).astype(np.float32)
    return means, np.maximum.reduceat(means, upto[:-1], axis=0), (start, after, upto)


def bad_quality_logits(model: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    laid, first = _laid_out(data, offsets)
    best, _, _ = _cell_maxima(laid, model)
    return _pooled(best, first)[1] @ model["out"] + model["shift"][0]


def fit(sample: list[tuple[bytes, int]], epochs: int = 4, batch: int = 32, rate: float = 0.01, seed: int = 5, least_steps: int = 200) -> dict[str, np.ndarray]:
    """Learns the filters and their combination from texts labelled 1 (good) or 0 by gradients through both maxima.

    A small sample is gone through more often, until ``least_steps`` steps are made.
    """
    rng = np.random.default_rng(seed)
    model = {
        "bytes": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32), "repeat": np.abs(rng.normal(0, 0.5, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.3, FILTERS).astype(np.float32), "shift": np.zeros(1, np.float32),
    }
    model["bytes"][:, 0] = 0
    kinds = {y for _, y in sample}
    if len(kinds) < 2:  # nothing to tell apart: every text scores what the labels say
        model["out"][:] = 0
        model["shift"][0] = 0 if not kinds else -3 if kinds == {1} else 3
        return model
    epochs = max(epochs, -(-least_steps * batch // len(sample)))
    adam = Adam(model, rate)
    share = np.mean([1 - y for _, y in sample])
    for epoch in range(epochs):
        order = rng.permutation(len(sample))
        adam.rate = rate * (1 - epoch / epochs)
        for low in range(0, len(order), batch):
            some = [sample[i] for i in order[low : low + batch]]
            data = np.frombuffer(b"".join(t for t, _ in some), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t, _ in some])])
            laid, first = _laid_out(data, offsets)
            best, where, repeats = _cell_maxima(laid, model, True)
            means, pooled, (start, after, upto) = _pooled(best, first)
            bad = np.array([1 - y for _, y in some], np.float32)
            wrong = (sigmoid(pooled @ model["out"] + model["shift"][0]) - bad) * np.where(bad == 1, 0.5 / share, 0.5 / (1 - share)) / len(some)
            slope = wrong[:, None] * model["out"]
            given = {k: np.zeros_like(v) for k, v in model.items()}
            given["out"], given["shift"] = pooled.T @ wrong, wrong.sum(keepdims=True)
            for i in range(len(some)):
                chosen = means[upto[i] : upto[i + 1]].argmax(axis=0) + upto[i]
                for f in range(FILTERS):
                    cells = np.arange(start[chosen[f]], after[chosen[f]])
                    cells = cells[best[cells, f] > 0]
                    if len(cells):
                        g = slope[i, f] / (after[chosen[f]] - start[chosen[f]])
                        at = where[cells, f]
                        given["bias"][f] += g * len(cells)
                        given["repeat"][f] += g * repeats[at // STRIDE].sum()
                        for k in range(WIDTH):
                            given["bytes"][k, :, f] += g * np.bincount(laid[at + k], minlength=256)
            given["bytes"][:, 0] = 0
            adam.move({k: g.astype(np.float32) for k, g in given.items()})
    return model


def scorer(spark, model: dict[str, np.ndarray]):
    """A function of Arrow batches that returns each text's probability of good quality."""
    sent = spark.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> np.ndarray:
        found = np.zeros(len(texts))
        for first, after, data, offsets in chunks(texts):
            found[first:after] = 1 - sigmoid(bad_quality_logits(sent.value, data, offsets).astype(np.float64))
        return found

    return scores


def fitted(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    return fit(labelled_sample(docs, labels, "quality"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of each row; the score is the probability that the quality label is 1.

    Whole texts are read. Null texts score as empty ones. Rows that repeat, and rows with a null id, get a row each; a null id counts
    as empty in the fold and trains nothing. Without labels of both kinds all texts score alike. Other columns are ignored.
    """
    scores = scorer(docs.sparkSession, fitted(docs, labels))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows["doc_id"], rows["held_out"], pa.array(scores(rows["text"]))], names=["doc_id", "held_out", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(batch, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows, all columns, whose text scores at least ``threshold``."""
    scores = scorer(docs.sparkSession, fitted(docs, labels))

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array(scores(rows["text"]) >= threshold))

    return docs.mapInArrow(batch, docs.schema)
