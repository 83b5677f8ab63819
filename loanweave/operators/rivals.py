"""What the rivals of a record amount to, without gathering them.

The pairs of one sale (or purchase) are rivals. What decides among them, a
minimum, a maximum, whether any is so, or whether there is one, two or more,
is merged from partial aggregates; no task ever sees all rivals of a record.
What is found is joined back, only to the pairs that it can change.

The pairs are read more than once: hand over a written table of narrow pairs,
or the join that forms them. Tests by the id of one record alone are anti and
semi joins, which Spark moves below that join, to the loans; so pairs that
are not written are never moved by their records.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALE, PURCHASE = "HMDAIndex_s", "HMDAIndex_p"
Ids = Mapping[str, Sequence[str]]
#: Which pairs stand on their own in a contest and which of them win it.
Rule = tuple[Column, Column]
BY_ID: Ids = {"s": [SALE], "p": [PURCHASE]}

#: Parts into which the pairs of one record are spread when something about it is joined back.
PARTS = 16


def same_ids(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equality of ids; missing parts of a composite id match each other."""
    if set(left) <= {SALE, PURCHASE}:
        return reduce(lambda a, b: a & b, (F.col(x) == F.col(y) for x, y in zip(left, right, strict=True)))
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def _renamed(facts: DataFrame, ids: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = [f"rival_{c}" for c in ids]
    return facts.withColumnsRenamed(dict(zip(ids, names, strict=True))), names


def _spread(pairs: DataFrame, facts: DataFrame, side: str, ids: Ids) -> DataFrame:
    """Join ``facts``, one row a record of the side, to the pairs of the record."""
    (other,) = [columns for name, columns in ids.items() if name != side]
    facts, names = _renamed(facts, ids[side])
    facts = facts.withColumn("rival_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # Moved by part, as otherwise the pairs would be laid out by the record alone, and all
    # parts would be broadcast where the facts before they are spread seem small enough.
    facts = facts.repartition(*names, "rival_part")
    pairs = pairs.withColumn("pair_part", F.pmod(F.xxhash64(*other), F.lit(PARTS)).cast("int"))
    joined = pairs.join(facts, same_ids(ids[side], names) & (F.col("pair_part") == F.col("rival_part")))
    return joined.drop("pair_part", "rival_part", *names)


def _without(pairs: DataFrame, records: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The pairs of other records than the listed ones."""
    records, names = _renamed(records, ids)
    return pairs.join(records, same_ids(ids, names), "left_anti")


def with_facts(pairs: DataFrame, facts: Mapping[str, Column], side: str, ids: Ids = BY_ID) -> DataFrame:
    """Each pair with aggregates over all pairs of its sale or purchase."""
    found = pairs.groupBy(*ids[side]).agg(*(fact.alias(name) for name, fact in facts.items()))
    return _spread(pairs, found, side, ids)


def without_records(pairs: DataFrame, marked: Column, side: str, ids: Ids = BY_ID) -> DataFrame:
    """Drop every pair of a sale or purchase that has one marked pair."""
    return _without(pairs, pairs.filter(marked).select(*ids[side]).distinct(), ids[side])


def contest(pairs: DataFrame, stands: Column, wins: Column, ids: Ids = BY_ID) -> DataFrame:
    """Drop pairs that do not stand on their own where a rival of either record wins.

    Only those pairs are compared, with the records that have a winner; the
    others stay where they are.
    """
    won, weak = pairs.filter(wins), pairs.filter(~stands)
    for columns in ids.values():
        weak = _without(weak, won.select(*columns).distinct(), columns)
    return pairs.filter(stands).unionByName(weak)


def only_pairs(pairs: DataFrame, counted: Column, ids: Sequence[str], formed: bool = False) -> DataFrame:
    """The pairs of records with exactly one counted pair; of rows that are not counted, one.

    One row passes on for each record and stands for its pair if there is just
    one, so no list of rivals is needed. Pairs that are ``formed`` by a join
    and not written are counted first, as rows would be sorted for this: the
    records with one pair are then few enough, and are picked below the join.
    """
    if formed:
        single = pairs.groupBy(*ids).agg(F.count(counted).alias("n_rivals")).filter("n_rivals = 1").select(*ids)
        single, names = _renamed(single, ids)
        same = reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(ids, names, strict=True)))
        pairs = pairs.join(single, same, "left_semi")
    kept = [c for c in pairs.columns if c not in ids]
    row = F.any_value(F.struct(*kept)).alias("only")
    singles = pairs.groupBy(*ids).agg(F.count(counted).alias("n_rivals"), row).filter("n_rivals = 1")
    return singles.select(*[F.col(c) if c in ids else F.col(f"only.{c}").alias(c) for c in pairs.columns])


def up_to(
    most: int, pairs: DataFrame, counted: Mapping[str, Column], allows_two: Column | None = None, ids: Ids = BY_ID, formed: bool = False
) -> DataFrame:
    """The pairs that are the only one of their purchase, of sales with one pair.

    With ``most`` two, a sale may have two pairs if one that is kept ``allows_two``.
    """
    sale, purchase = ids["s"], F.struct(*ids["p"])
    single = only_pairs(pairs, counted["p"], ids["p"], formed)
    sales = pairs.groupBy(*sale).agg(F.count(counted["s"]).alias("n_rivals")).filter(F.col("n_rivals") <= most)
    return _of_sales(most, single, sales, allows_two, sale, purchase)


def _of_sales(most: int, single: DataFrame, sales: DataFrame, allows_two: Column | None, sale: Sequence[str], purchase: Column) -> DataFrame:
    """The only pairs of their purchases, of ``sales`` with so few rivals."""
    whole = F.struct(*single.columns)
    allowed = F.lit(False) if allows_two is None else F.max(allows_two)
    few = single.groupBy(*sale).agg(
        F.count(F.lit(1)).alias("n_kept"), allowed.alias("is_allowed"),
        F.min_by(whole, purchase).alias("first"), F.max_by(whole, purchase).alias("last"),
    ).filter(F.col("n_kept") <= most)
    sales, names = _renamed(sales, sale)
    fits = (F.col("n_rivals") == 1) | ((F.col("n_rivals") == 2) & F.col("is_allowed"))
    found = few.join(sales, same_ids(sale, names)).filter(fits)
    return found.select(F.inline(F.expr("IF(n_kept = 1, array(first), array(first, last))")))


# --- pairs that are formed anew on each reading -----------------------------------
def marks_of(parts: Sequence[DataFrame], place: str, rule: Rule, counts: Column, earlier: int) -> DataFrame:
    """What a contest says of each record, by ``place`` and id, from pairs that are formed part by part.

    ``won_<n>`` says that the record has a winner, ``standing`` how many of its pairs stand on
    their own and count; marks of the ``earlier`` contests, which the pairs carry, are kept. A
    record has its marks at each place where it has pairs. What is gathered has one row a record
    and place; the pairs themselves are neither moved nor written.
    """
    stands, wins = rule
    known = [f"won_{n}" for n in range(earlier)]

    def of(side: str, column: str) -> Column:
        return F.struct(F.lit(side).alias("side"), F.col(column).alias("record"), *[F.col(f"{c}_{side}").alias(c) for c in known])

    found = [*known, "won", "standing"]
    local = []
    for pairs in parts:
        sided = pairs.select(place, wins.alias("won"), (stands & counts).alias("stands"), F.inline(F.array(of("s", SALE), of("p", PURCHASE))))
        facts = [*(F.max(c).alias(c) for c in [*known, "won"]), F.count_if("stands").alias("standing")]
        local.append(sided.groupBy(place, "side", "record").agg(*facts))
    every = reduce(DataFrame.unionByName, local)
    merged = [*(F.max(c).alias(c) for c in [*known, "won"]), F.sum("standing").alias("standing")]
    by_record = every.groupBy("side", "record").agg(*merged, F.collect_set(place).alias("places"))
    # Records without an id are counted as one, but are no rivals of each other.
    won = (F.col("won") & F.col("record").isNotNull()).alias(f"won_{earlier}")
    return by_record.select("side", "record", F.explode("places").alias(place), *(won if c == "won" else F.col(c) for c in found))


def marked(loans: DataFrame, marks: DataFrame, side: str, place: str, record: str) -> DataFrame:
    """Loans with the marks of their records; loans without any, which have no pair left, are dropped."""
    of_side = marks.filter(F.col("side") == side).drop("side").withColumnsRenamed({"record": "marked_record", place: "marked_place"})
    same = (F.col(place) == F.col("marked_place")) & F.col(record).eqNullSafe(F.col("marked_record"))
    return loans.join(of_side, same).drop("marked_record", "marked_place")


def up_to_marked(most: int, rows: DataFrame, allows_two: Column | None = None) -> DataFrame:
    """`up_to` on pairs of which those that stand on their own are counted by ``standing`` marks.

    ``rows`` holds every pair with a ``weak`` one, and of the others those of which both
    records have no more standing pairs than a link may have.
    """
    weak = F.count_if("weak")
    kept = [c for c in rows.columns if c not in (PURCHASE, "weak", "standing_s", "standing_p")]
    single = (
        rows.groupBy(PURCHASE)
        .agg((weak + F.max("standing_p")).alias("n_rivals"), F.any_value(F.struct(*kept)).alias("only"))
        .filter("n_rivals = 1")
        .select(PURCHASE, "only.*")
    )
    sales = rows.groupBy(SALE).agg((weak + F.max("standing_s")).alias("n_rivals")).filter(F.col("n_rivals") <= most)
    return _of_sales(most, single, sales, allows_two, [SALE], F.struct(PURCHASE))
