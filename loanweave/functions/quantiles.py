"""Exact medians that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanweave.session import cut_lineage

# Rank error of the bracketing sketch is at most one part in this many.
SKETCH_ACCURACY = 10_000
# Values that may be put in order in one task; brackets with more are narrowed further.
ORDERED = 1 << 16


def _lower() -> Column:
    return F.floor((F.col("n") + 1) / 2)


def _upper() -> Column:
    return F.floor((F.col("n") + 2) / 2)


def _placed(values: DataFrame, edges: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Values with what is known of their group."""
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"edge_{g}"))
    return values.join(edges.withColumnsRenamed({g: f"edge_{g}" for g in groups}), same).drop(*(f"edge_{g}" for g in groups))


def exact_median(df: DataFrame, groups: Sequence[str], value: str, accuracy: int = SKETCH_ACCURACY, margin: float | None = None, ordered: int = ORDERED) -> DataFrame:
    """``groups..., median`` over the non-null values; groups without any are absent.

    A mergeable sketch brackets the median. One pass then counts the values
    below the bracket and inside it, which shows whether the middle ranks are
    inside. If not, or if more than ``ordered`` values are, the part that holds
    them is bracketed again, group by group, until they are. Only the
    counts inside are ordered. The sketch (``accuracy``, and a ``margin`` of
    ranks on both sides) decides how often that takes, not the result.
    """
    groups, margin = list(groups), 2.0 / accuracy if margin is None else margin
    values = df.select(*groups, F.col(value).alias("v")).filter(F.col("v").isNotNull())
    # Of each group: its number of values, and a range that surely holds the middle ranks, with the values before and in it.
    state = values.groupBy(*groups).agg(F.percentile_approx("v", [0.5 - margin, 0.5 + margin], accuracy).alias("edges"), F.count(F.lit(1)).alias("n"))
    state = state.withColumns({"start": F.lit(None), "stop": F.lit(None), "before": F.lit(0), "inside": F.col("n")})
    while True:
        state = cut_lineage(_narrowed(values, state, groups))
        open_groups = (F.col("inside") > ordered) & (F.col("start") < F.col("stop")) & F.col("is_narrower")
        if state.filter(open_groups).isEmpty():
            break
        within = _placed(values, state, groups).filter(F.col("v").between(F.col("start"), F.col("stop")))
        ranks = [(rank - F.col("before")) / F.col("inside") + side * margin for rank, side in ((_lower(), -1), (_upper(), 1))]
        ranks = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), r)) for r in ranks]
        # The sketch takes fixed ranks; a grid of them around is enough to find the two that are needed.
        grid = [i / 64 for i in range(65)]
        sketch = within.groupBy(*groups).agg(F.percentile_approx("v", grid, accuracy).alias("grid"))
        low = F.element_at("grid", (F.floor(ranks[0] * 64) + 1).cast("int"))
        high = F.element_at("grid", (F.ceil(ranks[1] * 64) + 1).cast("int"))
        found = _placed(sketch, state, groups).withColumn("edges", F.array(low, high))
        state = found.select(*groups, "edges", "n", "start", "stop", "before", "inside")
    inside = _placed(values, state, groups).filter(F.col("v").between(F.col("start"), F.col("stop")))
    counted = inside.groupBy(*groups, "n", "before", "v").agg(F.count(F.lit(1)).alias("times"))
    upward = Window.partitionBy(*groups).orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("last_rank", F.col("before") + F.sum("times").over(upward))
    middle = [F.min(F.when(F.col("last_rank") >= rank, F.col("v"))) for rank in (_lower(), _upper())]
    return ranked.groupBy(*groups).agg(((middle[0] + middle[1]) / 2).alias("median"))


def _narrowed(values: DataFrame, state: DataFrame, groups: list[str]) -> DataFrame:
    """The range of each group cut to its bracket, or to the side of it that exact counts show to hold the middle ranks."""
    low, high = F.col("edges")[0], F.col("edges")[1]
    v = F.col("v")
    usable = F.col("start").isNull() | v.between(F.col("start"), F.col("stop"))
    counts = _placed(values, state, groups).filter(usable).groupBy(*groups, "edges", "n", "start", "stop", "before", "inside").agg(
        F.count_if(v < low).alias("under"), F.count_if(v.between(low, high)).alias("within"), F.count_if(v <= low).alias("up_to_low"),
        F.count_if(v >= high).alias("from_high"), F.count_if(v < high).alias("under_high"), F.min("v").alias("least"), F.max("v").alias("most"),
    )
    too_high = F.col("before") + F.col("under") >= _lower()  # the lower middle rank lies below the bracket
    too_low = F.col("before") + F.col("under") + F.col("within") < _upper()
    both = too_high & too_low
    pick = lambda whole, below, above, fits: F.when(both, whole).when(too_high, below).when(too_low, above).otherwise(fits)
    before, inside = F.col("before"), F.col("inside")
    return counts.select(
        *groups, "n",
        pick(F.col("least"), F.col("least"), high, low).alias("start"), pick(F.col("most"), low, F.col("most"), high).alias("stop"),
        pick(before, before, before + F.col("under_high"), before + F.col("under")).alias("before"),
        pick(inside, F.col("up_to_low"), F.col("from_high"), F.col("within")).alias("inside"),
        (pick(inside, F.col("up_to_low"), F.col("from_high"), F.col("within")) < inside).alias("is_narrower"),
    )
