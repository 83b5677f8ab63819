"""The lenders that each lender deals with most."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CounterpartyConfig:
    seller_id: str = "lei_s"
    purchaser_id: str = "lei_p"
    seller_name: str | None = "respondent_name_s"
    purchaser_name: str | None = "respondent_name_p"
    top_n: int = 5
    include_names: bool = False


def _check(matches: DataFrame, config: CounterpartyConfig) -> None:
    if config.top_n < 1:
        raise ValueError("top_n must be at least 1")
    names = [n for n in (config.seller_name, config.purchaser_name) if config.include_names and n]
    absent = sorted({config.seller_id, config.purchaser_id, *names} - set(matches.columns))
    if absent:
        raise KeyError(f"the matches lack the columns {', '.join(absent)}")
    if config.include_names and not (config.seller_name and config.purchaser_name):
        raise ValueError("include_names needs both name columns")


def pair_counts(matches: DataFrame, config: CounterpartyConfig) -> DataFrame:
    """Links per pair of lenders; links without one of the ids are left out."""
    ids = [config.seller_id, config.purchaser_id]
    return matches.dropna(subset=ids).groupBy(*ids).agg(F.count(F.lit(1)).alias("match_count"))


def _top(counts: DataFrame, own: str, partner: str, top_n: int) -> DataFrame:
    """Best partners per lender. Works on pair counts, one row per partner."""
    order = Window.partitionBy(own).orderBy(F.desc("match_count"), F.asc(partner))
    ranked = counts.withColumn("counterparty_rank", F.row_number().over(order))
    return ranked.filter(F.col("counterparty_rank") <= top_n).select(own, partner, "match_count", "counterparty_rank")


def attach_names(table: DataFrame, matches: DataFrame, config: CounterpartyConfig) -> DataFrame:
    """Add both lenders' names; an id with several names gets a row for each."""
    sides = ((config.seller_id, config.seller_name, "seller_name"), (config.purchaser_id, config.purchaser_name, "purchaser_name"))
    for id_column, name_column, new_name in sides:
        if not name_column:
            raise ValueError("include_names needs both name columns")
        names = matches.select(id_column, F.col(name_column).alias(new_name)).dropDuplicates()
        table = table.join(names, id_column, "left")
    return table


def _counterparties(matches: DataFrame, config: CounterpartyConfig, own: str, partner: str) -> DataFrame:
    _check(matches, config)
    top = _top(pair_counts(matches, config), own, partner, config.top_n)
    if config.include_names:
        named = attach_names(top, matches, config)
        top = named.select(own, partner, "match_count", "counterparty_rank", "seller_name", "purchaser_name")
    return top.orderBy(own, "counterparty_rank")


def top_counterparties_by_seller(matches: DataFrame, config: CounterpartyConfig | None = None) -> DataFrame:
    config = config or CounterpartyConfig()
    return _counterparties(matches, config, config.seller_id, config.purchaser_id)


def top_counterparties_by_purchaser(matches: DataFrame, config: CounterpartyConfig | None = None) -> DataFrame:
    config = config or CounterpartyConfig()
    return _counterparties(matches, config, config.purchaser_id, config.seller_id)


def summarize_top_counterparties(
    matches: DataFrame, config: CounterpartyConfig | None = None
) -> tuple[DataFrame, DataFrame]:
    """Top purchasers per seller and top sellers per purchaser."""
    return top_counterparties_by_seller(matches, config), top_counterparties_by_purchaser(matches, config)
