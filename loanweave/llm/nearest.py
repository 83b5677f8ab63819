"""Exact top-k search by inner product with vector-approximation files.

Each partition of the vectors keeps a quantised copy: one byte a component, the number of its cell between the partition's
smallest and largest value of that component. A scan of the cells bounds each score from both sides; the exact vectors are
then read in the order of the better bound until no unread vector can enter the best k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.common import saved

CELLS = 64
#: Rows of a query block, the vectors that a task quantises together, and the rows read first in the order of their bounds (then twice as many each time).
QUERY_BLOCK, PAGE_ROWS, READ_ROWS = 2048, 8192, 16


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component; null where a component, or the vector, is null, NaN or infinite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _page_best(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """Query number, id and score of the k best of one page for each query, through the page's approximation."""
    low, high = vectors.min(axis=0).astype(float), vectors.max(axis=0).astype(float)
    width = np.maximum((high - low) / CELLS, 1e-9)
    cells = np.clip(((vectors - low) / width), 0, CELLS - 1).astype(np.uint8)
    half = np.maximum(width / 2, np.abs(vectors - (low + (cells + 0.5) * width)).max(axis=0)) if len(vectors) else width
    middle = low + (cells + 0.5) * width  # what the approximation file alone tells of the vectors
    about = queries @ middle.T
    slack = (np.abs(queries) @ half) * (1 + 1e-9) + np.abs(about).max(axis=1, initial=0) * 1e-9 + 1e-6
    number = np.arange(len(ids))
    for q in range(len(queries)):
        allowed = number[ids != own[q]]
        if not len(allowed):
            continue
        bound = about[q, allowed]
        if len(allowed) > k:  # at least k scores reach this; vectors that cannot are never read
            sure = np.partition(bound, len(bound) - k)[len(bound) - k] - slack[q]
            near = bound + slack[q] >= sure
            allowed, bound = allowed[near], bound[near]
        order = np.argsort(-bound, kind="stable")
        allowed, bound = allowed[order], bound[order] + slack[q]
        best: list[tuple[int, int]] = []
        at, n = 0, READ_ROWS
        while at < len(allowed) and not (len(best) >= k and -best[k - 1][0] > bound[at]):
            read = allowed[at : at + n]
            best += zip((-(vectors[read] @ queries[q])).tolist(), ids[read].tolist(), strict=True)
            best = sorted(best)[:k]
            at, n = at + n, 2 * n
        for score, vec_id in best:
            yield q, vec_id, -score


def _block(vectors: DataFrame, rows: list, k: int) -> DataFrame:
    """The best k of all vectors for the queries of one block."""
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast([(r["vec_id"], list(r["vector"])) for r in rows])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, list[int]] = {}
        for number, (_, vector) in enumerate(sent.value):
            groups.setdefault(len(vector), []).append(number)
        for batch in batches:
            lengths = np.asarray(batch["vector"].value_lengths(), np.int64)
            for size, numbers in groups.items():
                some = batch.filter(pa.array(lengths == size))
                queries = np.array([sent.value[n][1] for n in numbers], np.int64).reshape(len(numbers), size)
                own = np.array([sent.value[n][0] for n in numbers], np.int64)
                for at in range(0, len(some), PAGE_ROWS):
                    page = some.slice(at, PAGE_ROWS)
                    exact = np.asarray(page["vector"].flatten(), np.int64).reshape(len(page), size)
                    found = [(numbers[q], *rest) for q, *rest in _page_best(queries, own, np.asarray(page["vec_id"], np.int64), exact, k)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["q", "vec_id", "score"])

    found = vectors.mapInArrow(search, "q long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(n, r["vec_id"], r["times"]) for n, r in enumerate(rows)], "q long, query_id long, times long")
    found = found.join(names, "q").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return found.select("query_id", "rank", "vec_id", "score")


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k highest inner products of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``every``; they pass over all vectors in blocks of bounded size. Candidates
    are all rows of another id and the query's number of components; equal scores rank by smaller id. Rows that repeat
    count as often as they occur, queries too. Rows with a null id, or vectors that are null or hold null or non-finite
    components, take no part. Other columns are ignored. An empty table, or one without queries, gives no rows.
    """
    vectors = saved(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("vector")).dropna())
    queries = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "vector").agg(F.count(F.lit(1)).alias("times"))
    queries = saved(queries.withColumn("place", F.xxhash64("vec_id", "vector")))
    blocks = max(1, -(-queries.count() // (QUERY_BLOCK // 2)))
    found = None
    for block in range(blocks):
        rows = queries.filter(F.pmod("place", F.lit(blocks)) == block).orderBy("vec_id", "place").collect()
        part = _block(vectors, rows, k)
        found = part if found is None else found.unionByName(part)
    return found
