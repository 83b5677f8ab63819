"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Fingerprints within 4 of 64 bits differ in at most 4 of their 8 bytes, so they share at least 4 positional bytes. Single bytes have
endless posting lists; the index therefore files a fingerprint under each choice of 4 positional bytes (70 lists), whose number
shared by a pair tells its tally of shared bytes: 1, 5, 15, 35 or 70 lists for 4 to 8 bytes. Two fingerprints of one list reach
the guaranteed minimum; they are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave.llm.common import chunks, joined_apart, lowered, saved, word_spans
from loanweave.llm.components import connected

WORDS, SEED, RADIUS, BYTES = 4, 42, 4, 8


def simhashes(column: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each whole text: a bit is set if more than half of the shingles' XXH64 have it; 0 for texts without words."""
    found = np.zeros(len(column), np.uint64)
    for first, after, data, offsets in chunks(column):
        data = lowered(data)
        starts, ends, text = word_spans(data, offsets)
        if not len(starts):
            continue
        lengths = ends - starts
        at = np.concatenate([[0], np.cumsum(lengths + 1)])  # where each word stands in the texts with single blanks
        joined = np.full(at[-1], 32, np.uint8)
        number = np.repeat(np.arange(len(starts)), lengths)
        within = np.arange(len(number)) - np.repeat(at[:-1] - np.arange(len(starts)), lengths)
        joined[at[number] + within] = data[starts[number] + within]
        total = np.bincount(text, minlength=after - first)
        begin = np.concatenate([[0], np.cumsum(total)])
        shingles = np.where(total > 0, np.maximum(1, total - words + 1), 0)
        owner = np.repeat(np.arange(len(total)), shingles)
        bounds = np.concatenate([[0], np.cumsum(shingles)])
        left = np.arange(bounds[-1]) - bounds[owner] + begin[owner]
        right = np.minimum(left + words, begin[owner + 1]) - 1
        plain, digest = joined.tobytes(), xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(plain[a:b], seed) for a, b in zip(at[left].tolist(), (at[right] + lengths[right]).tolist(), strict=True)), np.uint64, len(left))
        votes = np.zeros((len(total), 64), np.int64)
        some = np.flatnonzero(shingles)
        for low in range(0, len(some), 64):  # few texts at a time: a shingle takes 64 bytes here
            part = some[low : low + 64]
            for k, a, b in zip(part, bounds[part], bounds[part + 1], strict=True):
                for c in range(a, b, 1 << 15):
                    votes[k] += np.unpackbits(hashes[c : min(b, c + (1 << 15))].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = (2 * votes > shingles[:, None]).astype(np.uint8)
        found[first:after] = np.packbits(bits, axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return found


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED, more: list[Column] | None = None) -> DataFrame:
    """``doc_id, fingerprint`` (signed long) of each row, and what ``more`` asks for."""
    rows = docs.select("doc_id", "text", *(more or []))
    others = [c for c in rows.columns if c != "text"]

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            prints = pa.array(simhashes(some["text"], words, seed).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(some[c] for c in others), prints], names=[*others, "fingerprint"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(batch, ", ".join([*(f"{c} {kinds[c]}" for c in others), "fingerprint long"]))


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


#: The positions of each list, in the order of the lists' numbers.
LISTS = list(combinations(range(BYTES), BYTES - RADIUS))


def _filed(prints: DataFrame) -> DataFrame:
    """Each fingerprint in its 70 lists; ``key`` is the list's number over its four bytes."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1 << 14):
                some = batch["fingerprint"].slice(at, 1 << 14).to_numpy()
                parts = some.view(np.uint8).reshape(len(some), BYTES).astype(np.int64)  # the lowest byte first
                keys = np.empty((len(some), len(LISTS)), np.int64)
                for number, chosen in enumerate(LISTS):
                    key = np.full(len(some), number, np.int64)
                    for position in chosen:
                        key = (key << 8) | parts[:, position]
                    keys[:, number] = key
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(some, len(LISTS)))], names=["key", "fingerprint"])

    return prints.select("fingerprint").mapInArrow(file, "key long, fingerprint long")


def _close_pairs(members: DataFrame) -> DataFrame:
    """Verified pairs of fingerprints in one list, each pair in the first list that it shares."""
    lower = F.array(*(F.lit(sum(1 << p for p in range(c[-1]) if p not in c)) for c in LISTS))  # positions that a list leaves out, as bits
    a = members.select("key", lower[F.shiftright("key", 32).cast("int")].alias("skipped"), F.col("fingerprint").alias("a"))
    b = members.select(F.col("key").alias("other"), F.col("fingerprint").alias("b"))
    unlike = F.col("a").bitwiseXOR(F.col("b"))
    shared = [_byte(unlike, p) == 0 for p in range(BYTES)]
    tally = sum((s.cast("int") for s in shared[1:]), shared[0].cast("int"))
    first = F.lit(True)
    for p, s in enumerate(shared):
        first = first & ((F.col("skipped").bitwiseAND(F.lit(1 << p)) == 0) | ~s)
    near = (F.col("a") < F.col("b")) & (tally >= BYTES - RADIUS) & first & (F.bit_count(unlike) <= RADIUS)
    return a.join(b, (F.col("key") == F.col("other")) & near).select("a", "b")


def _through_midpoints(prints: DataFrame) -> DataFrame:
    """Links that join all fingerprints within the radius, without their pairs: two lie within 4 bits just if some value
    lies within 2 bits of both, and all fingerprints around a value are linked to the smallest of them."""
    around = prints.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(64)))).withColumn("j", F.explode(F.sequence(F.col("i"), F.lit(64))))
    around = around.filter("i < j OR i = 64")  # bit 64 is none
    flips = "(CASE WHEN i < 64 THEN shiftleft(1L, i) ELSE 0L END) ^ (CASE WHEN j < 64 THEN shiftleft(1L, j) ELSE 0L END)"
    around = around.select("fingerprint", F.col("fingerprint").bitwiseXOR(F.expr(flips)).alias("value"))
    least = around.groupBy("value").agg(F.min("fingerprint").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = around.join(least, "value").filter(F.col("fingerprint") != F.col("b"))
    return found.select(F.col("b").alias("a"), F.col("fingerprint").alias("b")).distinct()


def links(prints: DataFrame, long_list: int = 1024) -> DataFrame:
    """Edges ``a, b`` that connect distinct fingerprints exactly as all pairs within the radius do.

    Lists of up to ``long_list`` fingerprints yield their verified pairs, so a fingerprint meets a bounded number of others.
    The members of longer lists are connected exactly by what lies midway instead of pairwise.
    """
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = _filed(prints.repartition(tasks, "fingerprint"))  # the points are few bytes but 70 lists each
    filed = filed.repartition(tasks, "key")  # moved once: counted and joined where they lie; lists of one end here
    counts = filed.groupBy("key").agg(F.count("fingerprint").alias("n")).filter("n > 1")  # of the column, so that both read one exchange
    members = saved(filed.join(counts.hint("merge"), "key"))
    found = _close_pairs(members.filter(F.col("n") <= long_list))
    crowded = members.filter(F.col("n") > long_list).select("fingerprint").distinct()
    return saved(found.unionByName(_through_midpoints(crowded)))


def _rooted(prints: DataFrame, long_list: int, **facts: Column) -> DataFrame:
    """Each distinct fingerprint with its component's ``root``, its number of rows (``times``) and aggregates over its rows."""
    points = saved(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("times"), *(fact.alias(name) for name, fact in facts.items())))
    stars = connected(links(points.select("fingerprint"), long_list))
    rooted = points.join(stars.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    return saved(rooted.select("fingerprint", "times", *facts, F.coalesce("root", "fingerprint").alias("root")))


def near_duplicates(docs: DataFrame, long_list: int = 1024) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of each row: 16 hexadecimal digits, and the smallest id that links lead to.

    Null and wordless texts have fingerprint zero and link like others. Equal fingerprints are one point of the graph, so copies
    make no pairs. Null ids take part but are nobody's smallest id; without any other the component is null. Rows that repeat
    stay. Very long texts are read whole, one at a time. Other columns are ignored; an empty table gives no rows.
    """
    prints = saved(fingerprints(docs))
    rooted = _rooted(prints, long_list, least=F.min("doc_id"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"), F.sum("times").alias("docs"))
    smallest = saved(smallest)
    total = smallest.agg(F.sum("members").alias("points"), F.sum("docs").alias("docs")).first()
    named = saved(joined_apart(rooted, smallest.drop("docs"), "root", "members", total["points"] or 0).select("fingerprint", "times", "component_id"))
    found = joined_apart(prints, named, "fingerprint", "times", total["docs"] or 0)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def without_copies(docs: DataFrame, long_list: int = 1024) -> DataFrame:
    """One document of each component: the one with the smallest id, of several under that id the one with the smallest hash of its text.

    Rows without an id come after all others and stay only where their component has no row with one. A row that repeats stays once.
    """
    names = [F.xxhash64(F.lit(seed), "doc_id", "text").alias(name) for seed, name in ((1, "row_name"), (2, "row_check"))]
    named = docs.select("*", *names)
    prints = saved(fingerprints(docs, more=names))
    rooted = _rooted(prints, long_list, best=F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_name", "row_check")))
    keep = rooted.groupBy("root").agg(F.min("best").alias("best")).select(*(F.col(f"best.{c}").alias(f"kept_{c}") for c in ("row_name", "row_check")))
    same = (F.col("row_name") == F.col("kept_row_name")) & (F.col("row_check") == F.col("kept_row_check"))
    return named.join(keep, same, "left_semi").dropDuplicates(["row_name", "row_check"]).select(*docs.columns)
