"""Language identification with a string kernel.

A text is read in windows. The blended spectrum of a window is the set of all its byte sequences of 1 to 4 bytes (in lower case), each as one of
many hashed features; the presence kernel of two windows is the number of features that both hold, over the root of the product of their
numbers. A few windows of the learned texts are landmarks, evenly from each language: by Nyström's method the kernel to all of them, times the inverse root of the
kernel among them, gives each window coordinates, on which ridge regression learns one language against the rest. A text's answer is the mean
over all its windows; both the kernels and the answers of many windows are matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import chunks, id_remainder

FOLDS, HELD_OUT = 4, 2
#: Longest byte sequences, features as a power of two, bytes of a window and by how much windows overlap (so that no sequence is lost).
LONGEST, FEATURE_BITS, WINDOW = 4, 15, 4096
#: Texts that train, about (evenly from each language), characters that are read of each, landmarks, and the ridge.
SAMPLE_ROWS, SAMPLE_CHARS, LANDMARKS, RIDGE = 2400, 8192, 128, 1e-2
#: Windows whose kernels are one matrix product.
BATCH = 64
UNKNOWN = "und"


def lowered_text(text: str) -> bytes:
    return text.lower().encode()


def _windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte after the last and text number of each window; windows overlap by ``LONGEST - 1`` bytes."""
    lengths = np.diff(offsets)
    step = WINDOW - (LONGEST - 1)
    n = np.where(lengths > 0, np.maximum(1, -(-(lengths - (LONGEST - 1)) // step)), 0)
    text = np.repeat(np.arange(len(lengths)), n)
    within = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[text] + within * step
    return starts, np.minimum(starts + WINDOW, offsets[text + 1]), text


def _features(data: np.ndarray) -> list[np.ndarray]:
    """Feature of the sequence of each size that begins at each byte."""
    found, value = [], np.zeros(len(data), np.uint64)
    for size in range(1, LONGEST + 1):
        if len(data) < size:
            break
        value = (value[: len(data) - size + 1] << np.uint64(8)) | data[size - 1 :]
        key = value + np.uint64(size << 40)
        found.append(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32))
    return found


def presences(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Which features each window holds, as rows of 0 and 1, some windows at a time."""
    features = _features(data)
    for a in range(0, len(starts), BATCH):
        some = slice(a, min(a + BATCH, len(starts)))
        rows = np.zeros((some.stop - a, 1 << FEATURE_BITS), np.float32)
        for row, start, end in zip(rows, starts[some].tolist(), ends[some].tolist(), strict=True):
            for size, codes in enumerate(features, 1):
                row[codes[start : max(start, end - size + 1)]] = 1
        yield some, rows


class Machine:
    """Landmarks and, for each language, weights of the kernels to them."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, offset: np.ndarray):
        self.languages, self.packed, self.weights, self.offset = languages, np.packbits(landmarks.astype(bool), axis=1), weights, offset

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_held"):
            landmarks = np.unpackbits(self.packed, axis=1)[:, : 1 << FEATURE_BITS].astype(np.float32)
            self._held = landmarks.T.copy(), np.sqrt(np.maximum(landmarks.sum(axis=1), 1))
        return self._held

    def kernels(self, rows: np.ndarray) -> np.ndarray:
        landmarks, roots = self.held()
        return (rows @ landmarks) / roots / np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None]

    def answers(self, rows: np.ndarray) -> np.ndarray:
        """About 1 for the window's language and -1 for the others."""
        return self.kernels(rows) @ self.weights + self.offset


def learn(texts: list[tuple[str, str]]) -> Machine | None:
    """From pairs of text and language; None without a text."""
    texts = [(lowered_text(t), lang) for t, lang in texts if t]
    if not texts:
        return None
    data = np.frombuffer(b"".join(t for t, _ in texts), np.uint8)
    starts, ends, text = _windows(np.concatenate([[0], np.cumsum([len(t) for t, _ in texts])]))
    languages = sorted({lang for _, lang in texts})
    of = np.array([languages.index(lang) for _, lang in texts])[text]
    each = max(1, LANDMARKS // len(languages))
    chosen = np.sort(np.concatenate([np.flatnonzero(of == k)[:: max(1, int((of == k).sum()) // each)][:each] for k in range(len(languages))]))
    landmarks = np.concatenate([rows.astype(np.uint8) for _, rows in presences(data, starts[chosen], ends[chosen])])
    machine = Machine(languages, landmarks, np.zeros((len(chosen), len(languages))), np.zeros(len(languages)))
    among = machine.kernels(landmarks.astype(np.float32)).astype(float)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])  # kernels times this are Nyström's coordinates
    points = np.concatenate([machine.kernels(rows) for _, rows in presences(data, starts, ends)]).astype(float) @ root
    wanted = np.where(of[:, None] == np.arange(len(languages)), 1.0, -1.0)
    weight = (1 / np.bincount(of, minlength=len(languages)))[of]  # languages weigh the same
    middle = np.average(points, axis=0, weights=weight)
    mean = np.average(wanted, axis=0, weights=weight)
    centred = (points - middle) * weight[:, None]
    solved = np.linalg.solve(centred.T @ (points - middle) + RIDGE * np.eye(points.shape[1]), centred.T @ (wanted - mean))
    return Machine(languages, landmarks, root @ solved, mean - middle @ solved)


def sample(docs: DataFrame, folds: int = FOLDS, remainder: int = HELD_OUT, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """About ``rows`` texts with a letter and their languages, evenly from the languages, without the held-out ones, by a hash of id and text.

    The first ``SAMPLE_CHARS`` characters of each train.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (id_remainder(F.col("doc_id"), folds) != remainder))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit(5), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    each = max(1, rows // len(counts))
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in counts.items()], "of string, share double")
    found = known.join(F.broadcast(shares), F.col("lang") == F.col("of")).filter((draw <= F.col("share")))
    found = found.select("lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"), draw.alias("draw")).orderBy("draw", "lang", "text").limit(2 * max(rows, len(counts)))
    return [(r["text"], r["lang"]) for r in found.collect()]


def identify(docs: DataFrame, folds: int = FOLDS, remainder: int = HELD_OUT) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row.

    The classifier learns from a bounded sample (`sample`) of the rows with a language whose crc32(doc_id) has another remainder; a null id
    counts as empty. Whole texts are answered, however long, from all their windows; equal answers go to the first language by name. ``score`` is
    the answer brought from -1..1 to 0..1. Texts that are null or without a letter, and all texts if there is nothing to learn from, are
    ``und`` with score 0. Rows that repeat get a row each. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(learn(sample(docs.select("doc_id", "text", "lang"), folds, remainder)))
    kind = dict(docs.dtypes)["doc_id"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            names, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            lettered = np.asarray(batch["lettered"].fill_null(False))
            if machine is not None:
                lower = pa.array([t.lower() if good else None for t, good in zip(batch["text"].to_pylist(), lettered, strict=True)], pa.large_string())
                for first, after, data, offsets in chunks(lower):
                    starts, ends, text = _windows(offsets)
                    total = np.zeros((after - first, len(machine.languages)))
                    for some, rows in presences(data, starts, ends):
                        np.add.at(total, text[some], machine.answers(rows) * (ends[some] - starts[some])[:, None])
                    weight = np.bincount(text, ends - starts, after - first)
                    best = total.argmax(axis=1)
                    for k in np.flatnonzero((weight > 0) & lettered[first:after]).tolist():
                        names[first + k] = machine.languages[best[k]]
                        scores[first + k] = min(1.0, max(0.0, (total[k, best[k]] / weight[k] + 1) / 2))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(names), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (id_remainder(F.col("doc_id"), folds) == remainder).alias("held_out"), "text", F.col("text").rlike(r"\p{L}").alias("lettered"))
    return rows.mapInArrow(answer, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
