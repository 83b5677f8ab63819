"""Benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact shingle similarity.

For each size of benchmark item, windows of as many words slide over a document. A window that could be similar enough (it must
hold enough shingles that occur in items) gets a SimHash. Fingerprints within 20 of 64 bits have a byte of 8 that differs in at most
2 bits, so the index of item bytes, asked for all bytes within 2 bits, finds every item within the radius. The weighted similarity of
the shingles of window and item then decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanweave.llm.common import SpanHash, chunks, combined, lowered, saved, word_spans

WORDS, SIMILARITY, RADIUS = 5, 0.8, 20
#: Items, and bytes of their texts, that a pass over the documents looks for; more items take more passes.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20
_WORD = np.ones(256, bool)
_WORD[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = False
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_FILTER_BITS = 22


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word: letters, digits and all beyond ASCII, A-Z in lower case."""
    data = lowered(data)
    starts, ends, text = word_spans(data, offsets, _WORD)
    return SpanHash(data).of(starts, ends), text


def _votes(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(2 * bits - 1, axis=0, dtype=np.int32)])


def _prints(votes: np.ndarray, start: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints, as rows of 8 bytes, of ``count`` shingles from each start."""
    return np.packbits(votes[start + count] > votes[start], axis=1, bitorder="little")


def _shingles(words: np.ndarray, width: int) -> np.ndarray:
    return combined([words[k : len(words) - width + 1 + k] for k in range(width)]) if len(words) >= width else np.zeros(0, np.uint64)


class Items:
    """A block of benchmark items by their number of words, with the index of their fingerprints' bytes."""

    def __init__(self, rows: list[tuple], words: int, similarity: float, radius: int):
        self.words, self.similarity, self.radius = words, similarity, radius
        self.ids = [i for i, _ in rows]
        texts = [(t or "").encode() for _, t in rows]
        hashes, owner = _word_hashes(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))
        self.by_size: dict[int, list[int]] = {}
        self.shingles: dict[int, Counter] = {}
        known: dict[int, list[np.ndarray]] = {}
        prints: dict[int, list[np.ndarray]] = {}
        for k, own in enumerate(np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts)))) if texts else []):
            if not len(own):
                continue
            width = min(words, len(own))
            shingles = _shingles(own, width)
            self.by_size.setdefault(len(own), []).append(k)
            self.shingles[k] = Counter(shingles.tolist())
            known.setdefault(width, []).append(shingles)
            prints.setdefault(len(own), []).append(_prints(_votes(shingles), np.zeros(1, np.int64), len(shingles))[0])
        self.known = {w: np.unique(np.concatenate(x)) for w, x in known.items()}
        self.filters = {}
        for w, x in self.known.items():
            self.filters[w] = np.zeros(1 << _FILTER_BITS, bool)
            self.filters[w][x >> np.uint64(64 - _FILTER_BITS)] = True
        self.prints = {n: np.array(x) for n, x in prints.items()}
        # For each size and byte position: which items have a byte there within radius // 8 bits of a given byte.
        near = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= radius // 8
        self.index = {n: [near[:, x[:, p]] for p in range(8)] for n, x in self.prints.items()}

    def hits(self, words: np.ndarray, text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of the width, and which of them occur in items and lie in one text."""
        shingles = _shingles(words, width)
        maybe = np.flatnonzero(self.filters[width][shingles >> np.uint64(64 - _FILTER_BITS)])
        known = self.known[width]
        at = np.minimum(np.searchsorted(known, shingles[maybe]), len(known) - 1)
        maybe = maybe[(known[at] == shingles[maybe]) & (text[maybe] == text[maybe + width - 1])]
        return shingles, maybe

    def found(self, words: np.ndarray, text: np.ndarray) -> dict[int, dict[int, float]]:
        """By text: the items in it and the similarity of the best window."""
        result: dict[int, dict[int, float]] = {}
        for width in self.known:
            shingles, hits = self.hits(words, text, width)
            sizes = [n for n in self.by_size if min(n, self.words) == width]
            if not len(hits):
                continue
            reach = max(sizes)
            cuts = np.flatnonzero((np.diff(hits) > reach) | (text[hits[1:]] != text[hits[:-1]])) + 1
            for region in np.split(hits, cuts):
                self._region(words, text, shingles, region, width, sizes, result)
        return result

    def _region(self, words, text, shingles, region, width, sizes, result) -> None:
        number = text[region[0]]
        begin, after = np.searchsorted(text, [number, number + 1])
        low, high = max(begin, region[0] - max(sizes)), min(after, region[-1] + width + max(sizes))
        own = shingles[low : high - width + 1]
        hit = np.zeros(len(own) + 1, np.int64)
        hit[region - low + 1] = 1
        hit = np.cumsum(hit)
        votes = None
        for n in sizes:
            count = n - width + 1  # shingles of a window
            start = np.arange(len(own) - count + 1)
            # Equal totals: shared / (2 * total - shared) >= similarity
            start = start[hit[start + count] - hit[start] >= 2 * self.similarity / (1 + self.similarity) * count - 1e-9]
            if not len(start):
                continue
            votes = _votes(own) if votes is None else votes
            prints = _prints(votes, start, count)
            near = self.index[n][0][prints[:, 0]]
            for p in range(1, 8):
                near = near | self.index[n][p][prints[:, p]]
            window, item = np.nonzero(near)
            close = _ONES[prints[window] ^ self.prints[n][item]].sum(axis=1) <= self.radius
            for w, i in zip(window[close].tolist(), item[close].tolist(), strict=True):
                k = self.by_size[n][i]
                there = Counter(own[start[w] : start[w] + count].tolist())
                shared = sum((there & self.shingles[k]).values())
                similarity = shared / (2 * count - shared)
                if similarity >= self.similarity - 1e-12:
                    best = result.setdefault(int(number), {})
                    best[k] = max(best.get(k, 0.0), similarity)


def _blocks(benchmark: DataFrame, most_items: int) -> Iterator[list[tuple]]:
    """The distinct items in blocks of bounded size."""
    items = saved(benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct())
    total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-2 * total["n"] // most_items), -(-2 * (total["b"] or 0) // BLOCK_BYTES)) if total["n"] > most_items or (total["b"] or 0) > BLOCK_BYTES else 1
    for block in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield [tuple(r) for r in some.orderBy("item_id", "text").collect()]


def with_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "leaks", words: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents with an array of ``item_id, similarity``: the benchmark items that a window of theirs repeats.

    Words are letters, digits and all beyond ASCII, compared without regard to A-Z's case. A shingle weighs as often as it occurs in a window;
    similarity is the shared weight over the weight of both together. An item of fewer words than a shingle is one shingle. Null
    texts, and items that are null or have no words, match nothing; items that repeat count once. A column of the given name is replaced.
    """
    spark = docs.sparkSession
    id_type = benchmark.schema["item_id"].dataType
    kind = T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("similarity", T.DoubleType())]))
    found = docs.drop(column).withColumn(column, F.array().cast(kind))
    schema = found.schema
    for rows in _blocks(benchmark, block_items):
        sent = spark.sparkContext.broadcast(rows)

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = Items(sent.value, words, similarity, radius)
            for batch in batches:
                at = batch.schema.get_field_index(column)
                leaks = batch.column(at).to_pylist()
                for first, _, data, offsets in chunks(batch["text"]):
                    hashes, text = _word_hashes(data, offsets)
                    for number, matches in items.found(hashes, text).items():
                        leaks[first + number] = leaks[first + number] + [{"item_id": items.ids[k], "similarity": s} for k, s in sorted(matches.items())]
                yield batch.set_column(at, batch.schema.field(at), pa.array(leaks, batch.schema.field(at).type))

        found = found.mapInArrow(look, schema)
    return found


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id, contaminated, n_items, items (comma-joined ids in order), similarity`` (the best; 0 without items) of each row."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, **options)
    leaks = F.col("leaks")
    ids = F.array_sort(F.array_distinct(leaks["item_id"]))
    return found.select(
        "doc_id", (F.size(leaks) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("items"),
        F.coalesce(F.array_max(leaks["similarity"]), F.lit(0.0)).alias("similarity"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows, all columns, in which no benchmark item was found."""
    column = "leaks"
    while column in docs.columns:
        column += "_"
    return with_leaks(docs, benchmark, column, **options).filter(F.size(column) == 0).drop(column)
