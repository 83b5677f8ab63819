"""What the classifiers share: labelled samples, and a step of Adam."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import id_remainder

#: At most so many rows of each label train a classifier, and texts of at most so many characters; scoring reads all texts.
SAMPLE_ROWS, SAMPLE_CHARS = 1500, 20_000
FOLDS, HELD_OUT = 3, 1


def held_out(folds: int = FOLDS, remainder: int = HELD_OUT):
    return id_remainder(F.col("doc_id"), folds) == remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[bytes, int]]:
    """Texts and labels (0 or 1) of a bounded sample of the rows that aren't held out, the same for the same tables.

    The rows come in the order of a hash of their id. Rows without id, label or text are passed over.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("label"))
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "text")
    chosen = []
    for value in (0, 1):
        some = known.filter(F.col("label") == value).orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(rows)
        chosen.append(some)
    ids = [tuple(r) for some in chosen for r in some.collect()]  # at most twice ``rows``
    if not ids:
        return []
    picked = docs.sparkSession.createDataFrame(ids, "doc_id long, label int")
    found = texts.filter(F.length("text") <= chars).join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64(F.lit(11), "doc_id"), "text").limit(2 * rows)
    return [(r["text"].encode(), int(r["label"])) for r in found.select("text", "label").collect()]


class Adam:
    def __init__(self, values: dict[str, np.ndarray], rate: float):
        self.values, self.rate, self.step = values, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in values.items()}
        self.second = {k: np.zeros_like(v) for k, v in values.items()}

    def move(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.001 * (g * g - self.second[k])
            size = np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8
            self.values[k] -= (self.rate * self.first[k] / (1 - 0.9**self.step) / size).astype(self.values[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5
