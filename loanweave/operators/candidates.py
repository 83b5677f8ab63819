"""From loan tables to candidate pairs: splitting, excluding, blocking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions.logic import all_of, is_true
from loanweave.operators.cleaning import amount_bin, suffix_columns
from loanweave.session import cut_lineage

# A block that could form more pairs than this is laid out in pieces before it is
# joined. That decides which tasks form its pairs, never which pairs there are.
MAX_BLOCK_PAIRS = 2_000_000
# The same for blocks that `banded_join` subdivides where their loans are.
MAX_BANDED_PAIRS = 50 * MAX_BLOCK_PAIRS


def keep_potential_matches(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loans whose key group holds both an origination and a purchase.

    The group test is a partially aggregated list of keys, so a key that holds
    much of the table is never gathered in one task.
    """
    action = F.col("action_taken")
    both = (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(
            F.max(is_true(action == schema.PURCHASED)).alias("has_purchase"),
            F.max(is_true(action == schema.ORIGINATED)).alias("has_sale"),
        )
        .filter("has_purchase AND has_sale")
        .select(*keys)
    )
    return df.join(both, list(keys), "left_semi")


def without_linked(df: DataFrame, crosswalk: DataFrame, id_columns: Sequence[str] = (schema.LOAN_ID,)) -> DataFrame:
    """Loans that a crosswalk uses neither as sale nor as purchase.

    Missing parts of a composite id match each other.
    """
    sold = crosswalk.select([F.col(f"{c}_s").alias(f"used_{c}") for c in id_columns])
    bought = crosswalk.select([F.col(f"{c}_p").alias(f"used_{c}") for c in id_columns])
    same = all_of(F.col(c).eqNullSafe(F.col(f"used_{c}")) for c in id_columns)
    if len(id_columns) == 1:
        same = F.col(id_columns[0]) == F.col(f"used_{id_columns[0]}")
    return df.join(sold.unionByName(bought), same, "left_anti")


def unlinked(pairs: DataFrame, crosswalk: DataFrame, id_columns: Sequence[str] = (schema.LOAN_ID,)) -> DataFrame:
    """Pairs of which the crosswalk links neither record.

    For narrow pairs this moves less than `without_linked` does for loans, and
    leaves them laid out as the contests between rivals need them.
    """
    for side in ("p", "s"):
        used = crosswalk.select([F.col(f"{c}_{side}").alias(f"used_{c}") for c in id_columns])
        same = all_of(F.col(f"{c}_{side}").eqNullSafe(F.col(f"used_{c}")) for c in id_columns)
        if len(id_columns) == 1:
            same = F.col(f"{id_columns[0]}_{side}") == F.col(f"used_{id_columns[0]}")
        pairs = pairs.join(used, same, "left_anti")
    return pairs


def split_sides(df: DataFrame, crosswalk: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sellers' and purchasers' records, less those already linked."""
    if crosswalk is not None:
        df = without_linked(df, crosswalk)
    return df.filter(F.col("action_taken") == schema.ORIGINATED), df.filter(F.col("action_taken") == schema.PURCHASED)


def anti_matched_composite(df: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """`without_linked` for the 2007-2017 composite id, on the columns that exist."""
    return without_linked(df, crosswalk, [c for c in schema.PRE2018_ID_COLUMNS if c in df.columns])


@dataclass(frozen=True)
class LoanLayout:
    """Loans set apart by whether their block, by ``keys``, is crowded.

    Ideally ``calm`` is bucketed by the keys, so that joins on them and more
    move none of its rows.
    """

    calm: DataFrame
    crowded: DataFrame | None = None
    keys: tuple[str, ...] = ()

    def serves(self, keys: Sequence[str]) -> bool:
        return bool(self.keys) and set(self.keys) <= set(keys)

    def everything(self) -> DataFrame:
        return self.calm if self.crowded is None else self.calm.unionByName(self.crowded)


@dataclass(frozen=True)
class Blocking:
    """How candidate pairs are formed.

    ``keys``      columns that both records must share.
    ``spread``    key columns for which a seller tries several values
                  (an array column replaces the key on the seller's side).
    ``bands``     numeric tolerances that later filters enforce; a crowded
                  block is subdivided by them.
    ``ids``       columns that identify a loan.
    ``max_block_pairs``  blocks that could form more pairs are crowded; None
                  means that none is.
    ``max_piece_pairs``  a cell of a crowded block that could form more pairs
                  is cut. Each cut moves its loans once more, so this does
                  not follow a low ``max_block_pairs``.
    """

    keys: tuple[str, ...]
    spread: Mapping[str, Column] = field(default_factory=dict)
    bands: Mapping[str, float] = field(default_factory=dict)
    ids: tuple[str, ...] = (schema.LOAN_ID,)
    max_block_pairs: int | None = MAX_BLOCK_PAIRS
    max_piece_pairs: int = MAX_BLOCK_PAIRS

    @property
    def fixed_keys(self) -> list[str]:
        return [k for k in self.keys if k not in self.spread]


def block_join(sellers: DataFrame, purchasers: DataFrame, blocking: Blocking) -> DataFrame:
    """All pairs that share the blocking key; other columns get ``_s`` / ``_p``.

    Row-local filters on the result are pushed into the join condition.
    """
    return _join(_spread(sellers, blocking), purchasers, blocking.keys)


def banded_join(sellers: DataFrame, purchasers: DataFrame, blocking: Blocking) -> DataFrame:
    """`block_join` for loans that are laid out by a blocking key.

    Subdivides the blocks by the first band. A loan gets its cells where it is, so
    none is moved for them. Leaves out only pairs that the tolerance would drop.
    """
    if not blocking.bands:
        return block_join(sellers, purchasers, blocking)
    column, tolerance = next(iter(blocking.bands.items()))
    sellers = _spread(sellers, blocking).withColumn("band", F.explode(seller_bands(F.col(column), tolerance)))
    purchasers = purchasers.withColumn("band", F.explode(purchaser_bands(F.col(column), tolerance)))
    return _join(sellers, purchasers, [*blocking.keys, "band"]).drop("band")


def blocked_pairs(sellers: DataFrame, purchasers: DataFrame, blocking: Blocking) -> DataFrame:
    """`block_join`, with `crowded_join` for the blocks that could form too many pairs."""
    crowded = crowded_blocks(sellers, purchasers, blocking)
    if crowded is None:
        return block_join(sellers, purchasers, blocking)
    calm, hot = zip(*(split_crowded(side, crowded) for side in (sellers, purchasers)))
    return block_join(*calm, blocking).unionByName(crowded_join(*hot, blocking))


def split_crowded(loans: DataFrame, crowded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loans outside and inside the listed blocks.

    Spark broadcasts the list if its measured size allows it. If not, both joins
    are of the kind whose larger side adaptive execution splits.
    """
    return loans.join(crowded, crowded.columns, "left_anti"), loans.join(crowded, crowded.columns, "left_semi")


def crowded_blocks(sellers: DataFrame, purchasers: DataFrame, blocking: Blocking) -> DataFrame | None:
    """Keys of the blocks that could form too many pairs, or None if there are none.

    Runs a job: one partially aggregated count per block, of which the crowded
    keys are kept, all of them. Tables that are larger than the ones joined
    later are fine, as that can only list more blocks.
    """
    if blocking.max_block_pairs is None:
        return None
    keys = blocking.fixed_keys
    sizes = block_sizes(sellers, purchasers, keys).withColumn("block_pairs", _pairs())
    crowded = sizes.filter(F.col("block_pairs") > blocking.max_block_pairs)
    found = cut_lineage(crowded.select(*keys))
    return None if found.isEmpty() else found


def block_sizes(sellers: DataFrame, purchasers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Loans per block on either side, for blocks that have both."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    s = sellers.select(*keys, one.alias("sold"), none.alias("bought"))
    p = purchasers.select(*keys, none.alias("sold"), one.alias("bought"))
    counts = s.unionByName(p).groupBy(*keys).agg(
        F.sum("sold").alias("block_sellers"), F.sum("bought").alias("block_purchasers")
    )
    return counts.filter("block_sellers > 0 AND block_purchasers > 0")


def lonely_blocks(sellers: DataFrame, purchasers: DataFrame, key: str, more_than: int) -> DataFrame:
    """Blocks of one side only with more than so many loans; no pair comes from them."""
    counts = [side.groupBy(key).agg(F.count(F.lit(1)).alias("loans")) for side in (sellers, purchasers)]
    alone = [a.join(b, key, "left_anti").filter(F.col("loans") > more_than).select(key) for a, b in (counts, counts[::-1])]
    return alone[0].unionByName(alone[1])


def spread_block(loans: DataFrame, key: str, lonely: DataFrame) -> DataFrame:
    """Loans that cannot meet another by their block get a block of their own, so no bucket gathers them.

    These are the loans without a block and those of the listed blocks.
    """
    listed = lonely.select(F.col(key).alias("lonely_block"))
    found = loans.join(listed, F.col(key) == F.col("lonely_block"), "left")
    own = F.concat(F.lit("alone|"), F.col(schema.LOAN_ID))
    apart = F.col(key).isNull() | F.col("lonely_block").isNotNull()
    return found.withColumn(key, F.when(apart, own).otherwise(F.col(key))).drop("lonely_block")


def _pairs() -> Column:
    return F.col("block_sellers").cast("double") * F.col("block_purchasers")


def _join(sellers: DataFrame, purchasers: DataFrame, keys: Sequence[str]) -> DataFrame:
    left, right = suffix_columns(sellers, "_s", keys), suffix_columns(purchasers, "_p", keys)
    return left.join(right, list(keys), "inner")


def _spread(sellers: DataFrame, blocking: Blocking) -> DataFrame:
    for key, values in blocking.spread.items():
        sellers = sellers.withColumn(key, F.explode(values))
    return sellers


def crowded_join(sellers: DataFrame, purchasers: DataFrame, blocking: Blocking) -> DataFrame:
    """`block_join` for blocks with very many loans.

    Subdivides the block by band, then cuts every cell that is still crowded
    into a grid of pieces. Leaves out only pairs that the declared tolerances
    would drop, and no loan.
    """
    sellers = _spread(sellers, blocking)
    cell_keys = list(blocking.keys)
    for n, (column, tolerance) in enumerate(blocking.bands.items()):
        sellers = sellers.withColumn(f"band_{n}", F.explode(seller_bands(F.col(column), tolerance)))
        purchasers = purchasers.withColumn(f"band_{n}", F.explode(purchaser_bands(F.col(column), tolerance)))
        cell_keys.append(f"band_{n}")
    pieces = F.ceil(F.sqrt(_pairs() / F.lit(blocking.max_piece_pairs))).cast("bigint").alias("pieces")
    grid = block_sizes(sellers, purchasers, cell_keys).select(*cell_keys, pieces)

    def piece() -> Column:
        return F.pmod(F.xxhash64(*blocking.ids), F.col("pieces"))

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1))
    sellers = sellers.join(grid, cell_keys).withColumn("piece_row", piece()).withColumn("piece_column", every)
    purchasers = purchasers.join(grid, cell_keys).withColumn("piece_column", piece()).withColumn("piece_row", every)
    # Laid out by piece on purpose: being laid out by cell would do for the join,
    # but would leave all pieces of a cell to one task.
    piece_keys = [*cell_keys, "piece_row", "piece_column"]
    sellers, purchasers = (side.drop("pieces").repartition(*piece_keys) for side in (sellers, purchasers))
    pairs = _join(sellers, purchasers, piece_keys)
    return pairs.drop("piece_row", "piece_column", *(k for k in cell_keys if k.startswith("band_")))


# Cells that stand for a missing value: a seller without one meets every
# purchaser, a purchaser without one meets every seller that has one.
_ANY_CELL = -(2**62)
_MISSING_CELL = _ANY_CELL + 1


def _cell(value: Column, tolerance: float) -> Column:
    return F.floor(value / F.lit(4.0 * tolerance if tolerance else 1.0)).cast("bigint")


def seller_bands(column: Column, tolerance: float) -> Column:
    """Cells in which a seller can find purchasers within the tolerance."""
    slack = tolerance * 1.001
    cells = F.array(_cell(column - slack, tolerance), _cell(column + slack, tolerance), F.lit(_MISSING_CELL))
    return F.when(column.isNull(), F.array(F.lit(_ANY_CELL).cast("bigint"))).otherwise(F.array_distinct(cells))


def purchaser_bands(column: Column, tolerance: float) -> Column:
    """Cells in which a purchaser can be found; each pair meets exactly once."""
    own = F.coalesce(_cell(column, tolerance), F.lit(_MISSING_CELL).cast("bigint"))
    return F.array(own, F.lit(_ANY_CELL).cast("bigint"))


def amount_steps(step: float = 10000) -> dict[str, Column]:
    """Sellers also try the amounts one step below and above their own."""
    amount = F.col("LoanAmountMatch")
    return {"LoanAmountMatch": F.array(amount - step, amount, amount + step)}


def overlapping_bins() -> dict[str, Column]:
    """Sellers in the lower half of a ten-wide bin also try the bin below."""
    amount = F.col("loan_amount")
    own = amount_bin(amount)
    lower_half = F.pmod(amount, F.lit(10)) < 5
    return {"LoanAmountBin": F.when(lower_half, F.array(own, own - 10)).otherwise(F.array(own))}


def band_join_amount(sellers: DataFrame, purchasers: DataFrame, keys: Sequence[str], step: float = 10000) -> DataFrame:
    """Block join that lets the amounts differ by exactly one step."""
    sellers, purchasers = (d.withColumn("LoanAmountMatch", F.col("loan_amount")) for d in (sellers, purchasers))
    blocking = Blocking((*keys, "LoanAmountMatch"), spread=amount_steps(step))
    return blocked_pairs(sellers, purchasers, blocking)


def bin_overlap_join(sellers: DataFrame, purchasers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Block join on ten-wide amount bins that overlap downwards."""
    sellers, purchasers = (d.withColumn("LoanAmountBin", amount_bin(F.col("loan_amount"))) for d in (sellers, purchasers))
    blocking = Blocking((*keys, "LoanAmountBin"), spread=overlapping_bins())
    return blocked_pairs(sellers, purchasers, blocking)


def affiliate_restrict(pairs: DataFrame, affiliates: DataFrame) -> DataFrame:
    """Pairs between lenders that are listed as affiliates.

    Spark broadcasts the list when its measured size allows it.
    """
    return pairs.join(affiliates.select("lei_s", "lei_p"), ["lei_s", "lei_p"], "left_semi")


def purchaser_type_check(pairs: DataFrame, relationships: DataFrame) -> DataFrame:
    """Pairs whose sale type is the known one between the two lenders, or is unknown."""
    keys = ["lei_s", "lei_p", "activity_year_s", "purchaser_type_s"]
    known = relationships.select(*keys).dropDuplicates().withColumn("is_known", F.lit(True))
    hit = pairs.join(known, keys, "left")
    return hit.filter(F.col("is_known") | is_true(F.col("purchaser_type_s") == 0)).drop("is_known")


def year_window(pairs: DataFrame, max_gap: int | None = None) -> DataFrame:
    """The purchase is not reported before the sale, nor ``max_gap`` years later."""
    s, p = F.col("activity_year_s"), F.col("activity_year_p")
    pairs = pairs.filter(s <= p)
    return pairs if max_gap is None else pairs.filter(s + max_gap >= p)


def different_lenders(pairs: DataFrame, columns: Sequence[str] = ("respondent_id", "agency_code")) -> DataFrame:
    """Some id part differs; a missing part counts as different."""
    return pairs.filter(~reduce(lambda a, b: a & b, (is_true(F.col(f"{c}_s") == F.col(f"{c}_p")) for c in columns)))
