"""Mixing sources to target weights by pivotal dependent rounding.

Each document has a rate, its source's target over its source's size. Its whole part is a number of sure copies; its
fraction is a probability of one more. Pairs of fractional documents exchange mass (words) in a fair random direction until
one of the two holds none or a whole copy, so a source's expected words never change and at most one document of a group
stays fractional. Groups are small leaves of a tree per source; what stays fractional climbs to the next level, where groups
join 64 leaves, until one document per source is left, which is drawn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
LEAF_ROWS, FAN_IN_BITS, SALTS = 128, 6, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Adds running sums of ``values`` (before each row) in a global order: sums within range partitions plus the sums of earlier partitions."""
    ranged = saved(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    parts = ranged.groupBy("part").agg(*(F.sum(v).alias(f"all_{k}") for k, v in values.items()))
    parts = parts.select("part", *(F.coalesce(F.sum(f"all_{k}").over(earlier), F.lit(0)).alias(f"all_{k}") for k in values))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = ranged.join(parts, "part")
    for k, v in values.items():
        found = found.withColumn(k, F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"all_{k}"))
    return found.drop("part", *(f"all_{k}" for k in values))


def source_targets(sources: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """Adds ``target`` to sources (``source``, ``source_size``).

    Sources weigh ``weights`` in turn, by code point with null last. Together they get ``share`` of all sizes, each at most
    ``most`` times its own; the excess goes to the others by weight. So a level exists up to which each source is filled:
    target = least(level * weight, most * size). It is found in one pass over the sources in the order in which they fill up.
    """
    ranked = _running(sources, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    full = _running(ranked, [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()], caps=F.col("cap"), used=F.col("weight"))
    totals = sources.agg(F.sum("source_size").alias("size")).first()
    budget = share * (totals["size"] or 0)
    weighed = full.agg(F.sum("weight").alias("w")).first()["w"] or 1.0
    reach = (F.lit(budget) - F.col("caps")) / (F.lit(weighed) - F.col("used"))
    level = full.filter(reach * F.col("weight") <= F.col("cap")).agg(F.min_by(reach, F.col("cap") / F.col("weight")).alias("level")).first()["level"]
    if level is None:  # more is asked for than there is
        return ranked.select("source", "source_size", F.col("cap").alias("target"))
    return ranked.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), F.col("cap")).alias("target"))


def _settle(rows: pa.Table) -> pa.Table:
    """Exchanges mass between the fractional documents of one group until at most one is fractional.

    Large documents meet first, so that what stays open at last is small more often.
    """
    rows = rows.sort_by([("size", "descending"), ("row", "ascending"), ("doc_id", "ascending")])
    chance, size = rows["chance"].to_numpy().copy(), rows["size"].to_numpy().astype(float)
    draws = np.random.default_rng(rows["dice"][0].as_py() & (2**63 - 1)).random(len(rows) + 1)
    held = None
    for j in range(len(rows)):
        if not 0 < chance[j] < 1:
            continue
        if held is None:
            held = j
            continue
        to_held = min(size[held] * (1 - chance[held]), size[j] * chance[j])
        to_j = min(size[held] * chance[held], size[j] * (1 - chance[j]))
        up = draws[j] * (to_held + to_j) < to_j  # fair: neither document's chance changes in expectation
        moved = to_held if up else -to_j
        ends, other_ends = (1.0, 0.0) if up else (0.0, 1.0)
        missing = size[held] * abs(ends - chance[held]), size[j] * abs(other_ends - chance[j])
        chance[held] = ends if missing[0] <= missing[1] else chance[held] + moved / size[held]
        chance[j] = other_ends if missing[1] <= missing[0] else chance[j] - moved / size[j]
        held = next((x for x in (held, j) if 0 < chance[x] < 1), None)
    if held is not None and rows["last"][0].as_py():
        chance[held] = float(draws[-1] < chance[held])
    return rows.set_column(rows.column_names.index("chance"), "chance", pa.array(chance)).drop_columns(["last", "dice"])


def mix_to_weights(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, seed: int = 20) -> DataFrame:
    """How often a mix takes each document: ``doc_id, source, size, source_size, target, copies, taken``, one row for each row.

    A null text has size 0; documents of size 0 are taken 0 times; null sources are a source; rows that repeat each get a
    decision of their own. Other columns are ignored. The same rows give the same decisions in any layout. An empty table gives no rows.
    """
    rows = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("rows")).otherwise(0)).alias("n"))
    sources = saved(sources)
    targets = source_targets(sources.select("source", "source_size"), share, weights, most)
    known = sources.join(targets.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)) / LEAF_ROWS))).cast("int")
    known = known.select(F.col("source").alias("s"), "source_size", "target", bits.alias("bits"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("z"))
    units = rows.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).withColumn("row", F.xxhash64(F.lit(seed), "doc_id", "size", "at"))
    units = units.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    units = units.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("salt") == F.col("z")))
    rate = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = units.withColumn("whole", F.floor(rate).cast("long")).withColumn("chance", rate - F.floor(rate))
    units = units.withColumn("leaf", F.shiftrightunsigned(F.col("row"), 1) % F.expr("shiftleft(1L, bits)"))
    units = units.select("doc_id", "source", "size", "source_size", "target", "row", "bits", "whole", "chance", "leaf")
    deepest = sources.agg(F.max("n").alias("n")).first()["n"] or 0
    fractional = (F.col("chance") > 0) & (F.col("chance") < 1)
    units = saved(units)
    open_rows, closed = units.filter(fractional), [units.filter(~fractional)]  # empty documents and whole rates have nothing to exchange
    levels = max(0, int(np.ceil(np.ceil(np.log2(max(deepest, 1) / LEAF_ROWS)) / FAN_IN_BITS))) + 1
    schema = f"{', '.join(f'{c} {t}' for c, t in units.dtypes)}"
    for level in range(levels):
        here = open_rows.withColumn("last", F.col("bits") <= level * FAN_IN_BITS)
        here = here.withColumn("dice", F.xxhash64(F.lit(seed), F.lit(level), "source", "leaf"))
        settled = here.groupBy("source", "leaf").applyInArrow(_settle, schema)
        settled = saved(settled)
        closed.append(settled.filter(~fractional))
        open_rows = settled.filter(fractional).withColumn("leaf", F.shiftright(F.col("leaf"), FAN_IN_BITS))
    found = closed[0]
    for more in closed[1:]:
        found = found.unionByName(more)
    copies = F.col("whole") + F.col("chance").cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
