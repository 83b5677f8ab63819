"""Registered queries against their SQL on the smallest tables.

A sample by default; ``ALL_QUERIES=1`` runs every one.
"""

from __future__ import annotations

import os

import pytest
from compare import checking_engine, differences

import __spark_entry__ as entry_points
from registry.oracle import ORACLE
from registry.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = """resolve_deliveries load_linkage_input convert_numerics null_sentinels block_join block_join_crowded
band_join_amount bin_overlap_join weak_numeric_matches fee_dominance income_dominance match_race match_ethnicity
keep_uniques_secondary unique_links overall_match_rates unmatched_overall compare_numeric compare_mix
top_counterparties_named affiliates typed_relationships post_r1 post_r2 post_r3 post_r4 post_r5 post_r6 post_r7_after_r2
post_r8 post_r5_crowded pre_r1 pre_r2""".split()
CHOSEN = list(ORACLE) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def engine():
    return checking_engine(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, engine, name):
    sql = entry_points.oracle_sql()[name]
    assert differences(spark, engine, name, entry_points.queries()[name], sql, SF_DIR) is None


@pytest.mark.parametrize(
    ("all_pairs", "rules"),
    [
        ("block_join", ["property_type_equal", "match_race", "match_race_strict", "match_ethnicity", "match_ethnicity_strict"]),
        ("purpose_pairs", ["purpose_compat_either", "purpose_compat_both"]),
        ("legacy_pairs", ["different_lenders"]),
    ],
)
def test_rules_bite(spark, all_pairs, rules):
    """Every rule drops some pairs and keeps some, and the stricter form of a rule drops more."""
    from registry import queries as registered

    inputs = registered.Inputs(spark, "/root/testdata/sf0.01")
    given = {"block_join": lambda: inputs.pairs, "purpose_pairs": lambda: registered._purchase_flag_pairs(inputs), "legacy_pairs": lambda: inputs.legacy_pairs}
    total = given[all_pairs]().count()
    kept = {name: entry_points.queries()[name](spark, "/root/testdata/sf0.01").count() for name in rules}
    assert all(0 < n < total for n in kept.values()), (total, kept)
    for loose, strict in (("match_race", "match_race_strict"), ("match_ethnicity", "match_ethnicity_strict"), ("purpose_compat_either", "purpose_compat_both")):
        assert loose not in kept or kept[strict] < kept[loose], kept


@pytest.mark.parametrize("name", ["match_sex", "fee_filter_strict", "different_lenders", "numeric_matches"])
def test_pairs_are_not_written(spark, tmp_path, name):
    """A query on candidate pairs forms them from the columns it reads."""
    plan = entry_points.queries()[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "debt_to_income_ratio" not in plan
