"""Hard negatives through rotated one-bit codes with deterministic intervals.

A vector, less the centre of all, is rotated by a fixed orthogonal matrix, and the signs of its components are its one-bit code. The code stands for
a unit vector; how far the vector reaches along it, the alignment, is stored. What is left lies at right angles to the code vector and is rotated and
coded in the same way again, a few times; the length of what each code leaves is stored too. An anchor's components are quantised to a few bits, so that its
product with a code vector comes from counting common bits of words, plane by plane. Sum of alignments times these products is the estimate; by
Cauchy-Schwarz the rest adds at most the length of the last residual times that of the anchor beside the last code vector. These intervals are
certain. Vectors whose interval cannot matter are dropped code by code, the others are scored with whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.nearest import whole_numbers
from loanweave.session import scratch_folder

#: Codes of a vector, bits of an anchor's components, anchors that pass over the vectors together, and components that a task looks at together.
CODES, PLANES, ANCHOR_BLOCK, PAGE_VALUES = 5, 8, 2048, 1 << 19
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LEAST, MOST = 30, 90


@lru_cache(maxsize=16)
def rotation(size: int, code: int) -> np.ndarray:
    """A fixed random orthogonal matrix for each code."""
    return np.linalg.qr(np.random.default_rng((size, code)).normal(size=(size, size)))[0]


def _words(signs: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(signs, axis=1, bitorder="little")
    room = np.zeros((len(packed), -(-max(packed.shape[1], 1) // 8) * 8), np.uint8)
    room[:, : packed.shape[1]] = packed
    return room.view(np.uint64)


@dataclass
class Codes:
    """Of each vector: words and alignment for each code, and the length of what is left after it."""

    words: np.ndarray  # codes, rows, words
    alignment: np.ndarray  # codes, rows
    rest: np.ndarray  # codes, rows


def encode(vectors: np.ndarray, centre: np.ndarray, codes: int = CODES) -> Codes:
    size = vectors.shape[1]
    left, root = vectors - centre, max(size, 1) ** 0.5
    words, alignment, rest = [], [], []
    for code in range(codes):
        left = left @ rotation(size, code).T
        signs = left > 0
        reach = np.abs(left).sum(axis=1) / root
        left = left - np.where(signs, 1.0, -1.0) * (reach / root)[:, None]
        words.append(_words(signs))
        alignment.append(reach)
        rest.append(np.sqrt((left * left).sum(axis=1)))
    return Codes(np.array(words), np.array(alignment), np.array(rest))


class Question:
    """An anchor's rotated vectors in bit planes, one for each code."""

    def __init__(self, vector: np.ndarray, centre: np.ndarray, codes: int = CODES):
        turned, self.parts = vector.astype(float), []
        self.root, self.at_centre = max(len(vector), 1) ** 0.5, float(vector @ centre)
        self.square = float((turned * turned).sum()) * (1 + 1e-9)
        for code in range(codes):
            turned = rotation(len(vector), code) @ turned
            low, high = (turned.min(), turned.max()) if len(turned) else (0.0, 0.0)
            step = max((high - low) / ((1 << PLANES) - 1), 1e-12)
            level = np.clip(np.rint((turned - low) / step), 0, (1 << PLANES) - 1).astype(np.int64)
            about = low + level * step
            planes = [_words(((level >> p) & 1)[None, :].astype(np.uint8))[0] for p in range(PLANES)]
            off = float(np.sqrt(((turned - about) ** 2).sum())) + 1e-9 * (1 + self.square**0.5)
            self.parts.append((low, step, planes, about.sum(), off))

    def along(self, code: int, words: np.ndarray) -> np.ndarray:
        """Product with each code vector, from common bits; off by the quantisation's error at most."""
        low, step, planes, total, _ = self.parts[code]
        common = low * np.bitwise_count(words).sum(axis=1, dtype=np.int64)
        for p, plane in enumerate(planes):
            common = common + (step * (1 << p)) * np.bitwise_count(words & plane).sum(axis=1, dtype=np.int64)
        return (2 * common - total) / self.root

    def intervals(self, codes: Codes, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers, lower and upper bounds of the rows that are still asked for, code by code; send back which of them stay."""
        estimate, error = np.full(len(at), self.at_centre), np.full(len(at), 1e-6 + 1e-9 * abs(self.at_centre))
        for code, (words, alignment, rest) in enumerate(zip(codes.words, codes.alignment, codes.rest, strict=True)):
            along, off = self.along(code, words[at]), self.parts[code][4]
            estimate, error = estimate + alignment[at] * along, error + alignment[at] * off
            beside = np.sqrt(np.maximum(self.square - np.maximum(np.abs(along) - off, 0.0) ** 2, 0.0))
            half = rest[at] * (1 + 1e-9) * beside + error
            stay = yield at, estimate - half, estimate + half
            at, estimate, error = at[stay], estimate[stay], error[stay]
        yield at, None, None


def _sifted(question: Question, codes: Codes, at: np.ndarray, wanted) -> np.ndarray:
    """Those numbers among ``at`` that ``wanted(low, high)`` keeps at every code."""
    steps = question.intervals(codes, at)
    at, low, high = next(steps)
    while low is not None:
        at, low, high = steps.send(wanted(low, high))
    return at


def _scores(vectors: np.ndarray, plain: np.ndarray | None, vector: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers; through floating point where that is exact."""
    return vectors @ vector if plain is None else np.rint(plain @ vector.astype(float)).astype(np.int64)


class _Best:
    """The first k rows by score, then id, and the score that another must reach."""

    def __init__(self, k: int, least: int | None = None):
        self.k, self.rows, self.least = k, [], least

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k:
            enough = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= enough], ids[scores >= enough]
            order = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[order], ids[order]
        self.rows = sorted([*self.rows, *zip((-scores).tolist(), ids.tolist(), strict=True)])[: self.k]
        if len(self.rows) == self.k:
            self.least = -self.rows[-1][0] if self.least is None else max(self.least, -self.rows[-1][0])

    def sure(self, low: np.ndarray) -> float:
        """What a score must reach, given lower bounds of some rows that count."""
        bound = -np.inf if self.least is None else float(self.least)
        if len(low) >= self.k:
            bound = max(bound, float(np.partition(low, len(low) - self.k)[len(low) - self.k]))
        return bound


def _pages(batch: pa.RecordBatch, size: int, codes: int, values: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, Codes]]:
    """Ids, labels, whole numbers (also as floats, if products stay exact) and codes of the rows with so many components, some at a time."""
    some = batch.filter(pa.array(np.asarray(batch["vector"].value_lengths(), np.int64) == size))
    rows = max(values // max(size, 1), 1)
    for at in range(0, len(some), rows):
        page = some.slice(at, rows)
        n = len(page)
        vectors = np.asarray(page["vector"].flatten(), np.int64).reshape(n, size)
        most = np.abs(vectors).max(initial=0).astype(float)
        plain = vectors.astype(float) if most * most * max(size, 1) < 2.0**52 else None
        words = np.asarray(page["words"].flatten(), np.int64).view(np.uint64).reshape(n, codes, -1).transpose(1, 0, 2)
        floats = [np.asarray(page[x].flatten(), float).reshape(n, -1).T for x in ("alignment", "rest")]
        yield (np.asarray(page["vec_id"], np.int64), np.asarray(page["label"], np.int64), vectors, plain,
               Codes(np.ascontiguousarray(words), *floats))


def _coded(vectors: DataFrame, codes: int, path: str) -> DataFrame:
    """Writes each vector with its codes: centres (one for each number of components) come from one aggregate."""
    spark = vectors.sparkSession
    sizes = vectors.select(F.size("vector").alias("size"), F.posexplode("vector").alias("i", "x")).groupBy("size", "i").agg(F.avg("x").alias("mean"))
    centres: dict[int, np.ndarray] = {}
    for r in sizes.collect():  # as many rows as the lengths that occur have components
        centres.setdefault(r["size"], np.zeros(r["size"]))[r["i"]] = r["mean"]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch["vector"].value_lengths(), np.int64)
            for size in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == size))
                exact = np.asarray(some["vector"].flatten(), np.int64).reshape(len(some), size)
                c = encode(exact, centres.get(size, np.zeros(size)), codes)

                def lists(values: np.ndarray, n: int = len(some)) -> pa.Array:
                    flat = np.moveaxis(values, 1, 0).reshape(n, -1)
                    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1)))

                yield pa.RecordBatch.from_arrays([some["vec_id"], some["label"], some["vector"], lists(c.words.view(np.int64)), lists(c.alignment), lists(c.rest)], names=["vec_id", "label", "vector", "words", "alignment", "rest"])

    schema = "vec_id long, label long, vector array<long>, words array<long>, alignment array<double>, rest array<double>"
    vectors.mapInArrow(encoded, schema).write.parquet(path)
    return spark.read.parquet(path), centres


def _batch(rows: list[tuple], names: list[str]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)


def _best_of_label(coded: DataFrame, anchors: list, centres: dict, codes: int, k: int) -> DataFrame:
    """``place, vec_id, score``: the first k other rows of each anchor's label."""
    sent, page = coded.sparkSession.sparkContext.broadcast([tuple(a) for a in anchors]), PAGE_VALUES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for place, vec_id, label, vector in sent.value:
            vector = np.array(vector, np.int64)
            asked.setdefault(len(vector), []).append((place, vec_id, label, vector, Question(vector, centres.get(len(vector), np.zeros(len(vector))), codes), _Best(k)))
        for batch in batches:
            for size, anchors_of in asked.items():
                for ids, labels, vectors, plain, coded_page in _pages(batch, size, codes, page):
                    for _, vec_id, label, vector, question, best in anchors_of:

                        def wanted(low, high, best=best):
                            return high >= best.sure(low)

                        at = _sifted(question, coded_page, np.flatnonzero((labels == label) & (ids != vec_id)), wanted)
                        if len(at):
                            best.add(_scores(vectors[at], None if plain is None else plain[at], vector), ids[at])
        rows = [(a[0], i, -s) for some in asked.values() for a in some for s, i in a[5].rows]
        yield from _batch(rows, ["place", "vec_id", "score"])

    found = coded.mapInArrow(search, "place long, vec_id long, score long")
    order = Window.partitionBy("place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= k), sent


def _best_between(coded: DataFrame, anchors: list, positives: dict, centres: dict, codes: int, k: int) -> DataFrame:
    """``place, number, vec_id, score``: the first k rows of other labels in the range of each positive's score."""
    sent, page = coded.sparkSession.sparkContext.broadcast([(*a, positives.get(a["place"], [])) for a in anchors]), PAGE_VALUES

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, list] = {}
        for place, vec_id, label, vector, scores in sent.value:
            # 30 p <= 100 s <= 90 p for whole numbers
            ranges = [(number, -((-LEAST * p) // 100), (MOST * p) // 100, _Best(k, -((-LEAST * p) // 100))) for number, p in scores if LEAST * p <= MOST * p]
            if ranges:
                vector = np.array(vector, np.int64)
                asked.setdefault(len(vector), []).append((place, label, vector, Question(vector, centres.get(len(vector), np.zeros(len(vector))), codes), ranges))
        for batch in batches:
            for size, anchors_of in asked.items():
                for ids, labels, vectors, plain, coded_page in _pages(batch, size, codes, page):
                    for _, label, vector, question, ranges in anchors_of:

                        def wanted(low, high, ranges=ranges):
                            stay = np.zeros(len(low), bool)
                            for _, least, most, best in ranges:
                                certain = low[(low >= least) & (high <= most)]
                                stay |= (high >= best.sure(certain)) & (low <= most)
                            return stay

                        at = _sifted(question, coded_page, np.flatnonzero(labels != label), wanted)
                        if not len(at):
                            continue
                        scores = _scores(vectors[at], None if plain is None else plain[at], vector)
                        for _, least, most, best in ranges:
                            inside = (scores >= least) & (scores <= most)
                            best.add(scores[inside], ids[at[inside]])
        rows = [(a[0], number, i, -s) for some in asked.values() for a in some for number, _, _, best in a[4] for s, i in best.rows]
        yield from _batch(rows, ["place", "number", "vec_id", "score"])

    found = coded.mapInArrow(search, "place long, number long, vec_id long, score long")
    order = Window.partitionBy("place", "number").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), sent


def mine(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = 256, codes: int = CODES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are the rows whose id is divisible by ``every``, positives their best rows of the same label, negatives the best of other labels
    whose score lies between 0.3 and 0.9 of the positive's. Where an id is divisible by 7, the label is first moved on by one, modulo 10.
    Scores are inner products of floor(``scale`` x); equal ones rank by smaller id. Only rows with as many components as the anchor meet it.

    Rows with a null id, label or vector, or with null or non-finite components, take no part. A row with an anchor's own id is not its positive.
    Rows that repeat are candidates as often as they occur; an anchor that repeats is asked once. Other columns are ignored; an empty table, or
    one without anchors, gives no rows. Anchors pass over all vectors in blocks of bounded size, each a job whose results are written.
    """
    spark = embeddings.sparkSession
    folder = scratch_folder(spark, "hard_negatives")
    label, vec_id = F.col("label").cast("long"), F.col("vec_id").cast("long")
    rows = embeddings.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole_numbers(F.col("embedding"), scale).alias("vector")).dropna()
    coded, centres = _coded(rows, codes, f"{folder}/codes")
    anchors = coded.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "vector").distinct()
    anchors.withColumn("place", F.xxhash64("vec_id", "label", "vector")).write.parquet(f"{folder}/anchors")
    anchors = spark.read.parquet(f"{folder}/anchors")
    blocks = max(1, -(-anchors.count() // (ANCHOR_BLOCK // 2)))
    for block in range(blocks):
        some = anchors.filter(F.pmod("place", F.lit(blocks)) == block).select("place", "vec_id", "label", "vector").collect()
        found, sent = _best_of_label(coded, some, centres, codes, positives)
        found.write.parquet(f"{folder}/positives/block={block}")
        sent.destroy()
        mine_of: dict[int, list] = {}
        for r in spark.read.parquet(f"{folder}/positives/block={block}").select("place", "number", "score").collect():  # five for each anchor of the block
            mine_of.setdefault(r["place"], []).append((r["number"], r["score"]))
        found, sent = _best_between(coded, some, mine_of, centres, codes, negatives)
        found.write.parquet(f"{folder}/negatives/block={block}")
        sent.destroy()
    pos = spark.read.schema("place long, vec_id long, score long, number int").parquet(f"{folder}/positives")
    neg = spark.read.schema("place long, number long, vec_id long, score long, rank int").parquet(f"{folder}/negatives")
    neg = neg.select("place", F.col("number").cast("int").alias("number"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pos = pos.select("place", "number", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("place", F.col("vec_id").alias("anchor_id"))
    found = pos.join(neg, ["place", "number"]).join(named, "place")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


HARD_NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.e) = len(a.e) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), negatives AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""
