"""Phrase collocations from mergeable Misra-Gries summaries and a second pass that counts exactly.

A phrase can be frequent only if its parts are, so frequent words are found first, then pairs of them, then longer phrases. Each time every
task sums up the sequences it meets and hands its summary to the hash partitions of the sequences. A hash partition merges what it receives
into one Misra-Gries summary: if there are more counters than its capacity, the largest counter beyond it is subtracted from all. The capacity
exceeds the partition's mass divided by the threshold, so that less than the threshold is subtracted in all, which is checked; every frequent
sequence survives. The survivors, as bits of a filter of bounded size, tell a second pass what to count exactly, by the phrase itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanweave.llm.common import BitFilter, SpanHash, bit_filter, chunks, lowered, mixed, word_spans
from loanweave.session import scratch_folder

THRESHOLD, LONGEST, BEST = 100, 5, 2000
#: Counters of a task that are handed over together, and occurrences (at most) that one hash partition is made for.
FLUSH, PARTITION_MASS = 1 << 20, 1 << 25
#: Values of a summary in one row; tasks hand each other thousands of rows at once.
LIST = 256
#: Parts into which the phrases of a language, and those that share a first or last part, are split.
SALTS = 16

_WORD, _SPLITS = np.ones(256, bool), np.zeros(256, bool)
_SPLITS[list(b".,;:!?\n\x0b\x0c\r")] = True
_WORD[_SPLITS] = False
_WORD[[9, 32]] = False


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counters, and what has been subtracted from each sequence at most."""

    def __init__(self, capacity: int):
        self.capacity, self.subtracted = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.n_waiting += len(keys)
        if self.n_waiting >= max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.counts), *self.waiting]
        self.waiting, self.n_waiting = [], 0
        self.keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([c for _, c in parts]), len(self.keys)).astype(np.int64)
        if len(self.keys) > self.capacity:
            beyond = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            left = self.counts > beyond
            self.keys, self.counts = self.keys[left], self.counts[left] - beyond
            self.subtracted += beyond


def _partitions(spark: SparkSession, mass: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-mass // PARTITION_MASS))


def _packed(of: np.ndarray, columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Values in the order of their hash partitions ``of`` as rows of lists."""
    for a in range(0, len(of), 1 << 18):
        some = of[a : a + (1 << 18)]
        first = np.unique(some, return_index=True)[1]
        first = np.unique(np.concatenate([first, np.arange(0, len(some), LIST)]))
        bounds = pa.array(np.append(first, len(some)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(bounds, c.slice(a, len(some))) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(some[first]), *lists], names=["part", *names])


def _seeds(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    found = np.zeros(len(langs), np.uint64)
    for first, after, data, offsets in chunks(langs):
        found[first:after] = SpanHash(data).of(offsets[:-1], offsets[1:])
    return found


class _Places:
    """The words of a slice of texts, and the keys of the sequences that begin at each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        self.data = lowered(data)
        self.starts, self.ends, self.text = word_spans(self.data, offsets, _WORD)
        self.words = SpanHash(self.data).of(self.starts, self.ends)
        splits = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(_SPLITS[self.data], out=splits[1:])
        piece = splits[self.starts] + self.text  # grows with each split and with each text
        self.last = np.searchsorted(piece, piece, "right")  # number of the first word after the piece
        self.seeds = seeds

    def sequences(self, known: BitFilter | None, known_size: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, first word and key of all sequences without a shorter part that ``known`` (up to ``known_size`` words) rules out."""
        keys = mixed(self.words ^ self.seeds[self.text])
        at = np.arange(len(keys))
        for size in range(1, longest + 1):
            if size > 1:
                good = np.zeros(len(self.words) + 1, bool)
                good[at] = known.has(keys) if size - 1 <= known_size else True
                fits = good[at] & good[at + 1] & (at + size <= self.last[at])
                at, keys = at[fits], keys[fits]
                keys = mixed(keys * np.uint64(0x9FB21C651E98DF25) + self.words[at + size - 1])
            yield size, at, keys


def _survivors(docs: DataFrame, known: BitFilter | None, known_size: int, sizes: range, threshold: int, mass: int, capacity: int | None, folder: str) -> DataFrame:
    """``key`` of every sequence of the given sizes that occurs ``threshold`` times or more, and of some others."""
    spark = docs.sparkSession
    sent = None if known is None else spark.sparkContext.broadcast(known)
    partitions = _partitions(spark, mass)
    room = capacity or 2 * (mass // (threshold * partitions) + 1) + (1 << 12)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = None if sent is None else sent.value, Summary(1 << 62)

        def handed_over() -> Iterator[pa.RecordBatch]:
            held.settle()
            of = (held.keys % np.uint64(partitions)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            yield from _packed(of[order], [pa.array(held.keys[order].view(np.int64)), pa.array(held.counts[order])], ["keys", "counts"])

        for batch in batches:
            seeds = _seeds(batch["lang"])
            for first, after, data, offsets in chunks(batch["text"]):
                for size, _, keys in _Places(data, offsets, seeds[first:after]).sequences(table, known_size, sizes[-1]):
                    if size in sizes and len(keys):
                        held.waiting.append((keys, np.ones(len(keys), np.int64)))
                        held.n_waiting += len(keys)
                if held.n_waiting >= FLUSH:
                    held.settle()
                    if len(held.keys) >= FLUSH:
                        yield from handed_over()
                        held = Summary(1 << 62)
        yield from handed_over()

    handed = docs.select("lang", "text").mapInArrow(summed, "part long, keys array<long>, counts array<long>").repartition(partitions, "part")
    while True:

        def merged(batches: Iterator[pa.RecordBatch], room: int = room) -> Iterator[pa.RecordBatch]:
            summaries: dict[int, Summary] = {}  # a task may get several hash partitions
            for batch in batches:
                for row, part in enumerate(batch["part"].to_pylist()):
                    keys, counts = (batch[x][row].values.to_numpy() for x in ("keys", "counts"))
                    summaries.setdefault(part, Summary(room)).add(keys.view(np.uint64), counts)
            for summary in summaries.values():
                summary.settle()
                left = summary.counts + summary.subtracted >= threshold  # the others cannot be frequent
                keys = pa.array(np.append(summary.keys[left].view(np.int64), 0), mask=np.append(np.zeros(left.sum(), bool), True))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), summary.subtracted))], names=["key", "subtracted"])

        path = f"{folder}/survivors/{sizes[0]}-{room}"
        handed.mapInArrow(merged, "key long, subtracted long").write.parquet(path)
        found = spark.read.parquet(path)
        if (found.agg(F.max("subtracted")).first()[0] or 0) < threshold:
            break
        room *= 4  # a partition had more mass than its share
    if sent is not None:
        sent.destroy()
    return found.select("key").dropna()


KINDS, NAMES = (pa.large_string(), pa.large_string(), pa.int32(), pa.int64()), ["lang", "phrase", "size", "f"]


def _summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(NAMES[:3]).aggregate([("f", "sum")]).rename_columns(NAMES)


def _exact(docs: DataFrame, known: BitFilter, longest: int, threshold: int, partitions: int, path: str) -> DataFrame:
    """``lang, phrase, size, f`` of the sequences that are frequent, counted over all texts; size 0 is a language's number of words."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        held: dict[int, list] = {}  # key: language, phrase, size and count
        words: dict[str, int] = {}

        def handed_over() -> Iterator[pa.RecordBatch]:
            rows = [*((zlib.crc32(lang.encode()), lang, "", 0, n) for lang, n in words.items()), *((key, *row) for key, row in held.items())]
            rows = sorted((key % partitions, *row) for key, *row in rows)
            if rows:
                of, *columns = zip(*rows, strict=True)
                columns = [pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)]
                yield from _packed(np.array(of, np.int64), columns, ["langs", "phrases", "sizes", "counts"])
            held.clear()
            words.clear()

        for batch in batches:
            seeds, names = _seeds(batch["lang"]), batch["lang"].to_pylist()
            for first, after, data, offsets in chunks(batch["text"]):
                places = _Places(data, offsets, seeds[first:after])
                for text, n in enumerate(np.bincount(places.text, minlength=after - first).tolist()):
                    words[names[first + text]] = words.get(names[first + text], 0) + n
                plain = places.data.tobytes()
                for size, at, keys in places.sequences(table, longest, longest):
                    good = table.has(keys)
                    unique, where, times = np.unique(keys[good], return_index=True, return_counts=True)
                    for key, i, n in zip(unique.tolist(), at[good][where].tolist(), times.tolist(), strict=True):
                        row = held.get(key)
                        if row is None:
                            spans = zip(places.starts[i : i + size].tolist(), places.ends[i : i + size].tolist(), strict=True)
                            phrase = b" ".join(plain[a:b] for a, b in spans).decode()
                            held[key] = [names[first + int(places.text[i])], phrase, size, n]
                        else:
                            row[3] += n
                if len(held) >= FLUSH // 4:
                    yield from handed_over()
        yield from handed_over()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            columns = [batch[x].flatten() for x in ("langs", "phrases", "sizes", "counts")]
            waiting.append(pa.table([c.cast(t) for c, t in zip(columns, KINDS, strict=True)], names=NAMES))
            if sum(map(len, waiting)) >= FLUSH and len(waiting) > 1:
                waiting = [_summed(waiting)]
        if waiting:
            yield from _summed(waiting).to_batches(max_chunksize=1 << 16)

    rows = docs.select("lang", "text").mapInArrow(count, "part long, langs array<string>, phrases array<string>, sizes array<int>, counts array<long>")
    counts = rows.repartition(partitions, "part").mapInArrow(added, "lang string, phrase string, size int, f long")
    counts.filter((F.col("f") >= threshold) | (F.col("size") == 0)).write.parquet(path)
    sent.destroy()
    return docs.sparkSession.read.parquet(path)


def _cuts(found: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, n, k, l, r, score`` of each candidate's lowest-scoring cut."""
    whole = found.filter("size = 0").select(F.col("lang").alias("of"), F.col("f").alias("n"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cuts = found.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), salt.alias("salt"), F.split("phrase", " ").alias("words"))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    for side, part in (("l", F.expr("array_join(slice(words, 1, k), ' ')")), ("r", F.expr("array_join(slice(words, k + 1, size - k), ' ')"))):
        # Very many phrases may share a part, so each part stands there once for each salt.
        parts = found.filter("size >= 1").select(F.col("lang").alias("of"), F.col("phrase").alias("other"), F.col("f").alias(side))
        parts = parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        cuts = cuts.withColumn("part", part)
        cuts = cuts.join(parts, (F.col("lang") == F.col("of")) & (F.col("part") == F.col("other")) & (F.col("salt") == F.col("at"))).drop("of", "other", "at", "part")
    whole = whole.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a language may hold most phrases
    cuts = cuts.drop("words").join(whole, (F.col("lang") == F.col("of")) & (F.col("salt") == F.col("at"))).drop("of", "at")
    wide = {x: F.col(x).cast("decimal(38,0)") for x in "anlr"}
    cuts = cuts.withColumns({"top": wide["a"] * wide["n"] * F.lit(1000).cast("decimal(38,0)"), "bottom": wide["l"] * wide["r"]})
    cuts = cuts.withColumn("score", F.expr("top div bottom"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "size", "a", "n").agg(best).select("lang", "phrase", "size", "a", "n", "best.*")


def _inner(found: DataFrame) -> DataFrame:
    """``lang, phrase, longer``: the phrases that stand inside longer candidates, with the frequency of the most frequent one."""
    longer = found.filter("size >= 3").select("lang", "size", "f", F.split("phrase", " ").alias("words"))
    longer = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    longer = longer.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    part = F.expr("array_join(slice(words, i, m), ' ')").alias("phrase")
    return longer.select("lang", part, "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def _best(rows: DataFrame, best: int) -> DataFrame:
    """The first ``best`` phrases of each language with their rank; a language's phrases are ranked in parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part: Column = F.pmod(F.xxhash64("phrase"), F.lit(4 * SALTS))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)


def mine(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, best: int = BEST, capacity: int | None = None) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of 2 to ``longest`` words.

    Texts, A-Z in lower case, are split at ``. , ; : ! ?`` and line ends into pieces, these at blanks and tabs into words. A phrase that
    occurs ``threshold`` times or more (its own copies overlapping or not) scores what its worst cut into two parts scores, floor(1000 a n / (l r));
    one that stands inside a longer candidate as frequent as itself is dropped. Equal scores rank by frequency, then by the phrase's bytes.

    Null texts are empty, rows without a language are of language ``und``. Rows that repeat count as often as they occur. Very long texts
    are read whole, one at a time. Other columns are ignored; an empty table gives no rows. ``capacity`` sets the counters of each summary
    (by default what the mass of the table asks for); too small a one is raised until every frequent phrase is sure to survive.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    mass = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 + 1  # a word and what ends it have two bytes or more
    folder, survivors, known = scratch_folder(spark, "collocations"), None, None
    for sizes in (range(1, 2), range(2, 3), range(3, longest + 1)):
        if len(sizes):
            more = _survivors(docs, known, sizes[0] - 1, sizes, threshold, len(sizes) * mass, capacity, folder)
            survivors = more if survivors is None else survivors.unionByName(more)
            known = bit_filter(survivors)
    found = _exact(docs, known, longest, threshold, _partitions(spark, mass), f"{folder}/counts")
    chosen = _cuts(found).join(_inner(found), ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer"), F.lit(0)) < F.col("a"))
    return _best(chosen, best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), sizes AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS size
), places AS (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, sizes WHERE len(w) >= size
), f AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE size >= 2
), k AS (
  SELECT *, unnest(range(1, size)) AS k FROM c
), scored AS (
  SELECT k.lang, k.size, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n.n,
         CAST((1000 * CAST(k.a AS HUGEINT) * CAST(n.n AS HUGEINT)) // (CAST(x.f AS HUGEINT) * CAST(y.f AS HUGEINT)) AS BIGINT) AS score
  FROM k JOIN n ON n.lang = k.lang
  JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 : k.size], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), kept AS (
  SELECT * FROM lowest x WHERE NOT EXISTS (
    SELECT 1 FROM c y WHERE y.lang = x.lang AND y.size > x.size AND 100 * y.a >= 100 * x.a AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
