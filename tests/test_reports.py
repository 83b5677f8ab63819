from __future__ import annotations

import random
import statistics as exact

import pytest
from rows import ids
from pyspark.sql import functions as F

from loanweave.functions.quantiles import exact_median
from loanweave.plans import relations
from loanweave.reports import counterparties, statistics, unmatched
from loanweave.reports.counterparties import CounterpartyConfig


def test_exact_median_small_groups_and_nulls(table):
    groups = {"one": [5.0], "two": [1.0, 2.0], "three": [9.0, 1.0, 4.0], "ties": [2.0] * 5 + [7.0], "none": [None], None: [3.0, None, 8.0]}
    df = table([dict(g=g, v=v) for g, vs in groups.items() for v in vs], "g string, v double")
    found = {r.g: r.median for r in exact_median(df, ["g"], "v").collect()}
    assert found == {"one": 5.0, "two": 1.5, "three": 4.0, "ties": 2.0, None: 5.5}


@pytest.mark.parametrize("count", [4, 10_001, 50_000, 200_000])
def test_exact_median_where_the_sketch_is_not_exact(spark, count):
    """Random, skewed and distinct values beyond the size the sketch keeps whole."""
    df = spark.range(count, numPartitions=7).select(
        (F.col("id") % 2).alias("g"), (F.xxhash64("id") % 1_000_003).cast("double").alias("v"),
        F.floor(F.log1p(F.col("id").cast("double")) * 3).cast("double").alias("tied"),
    )
    for value in ("v", "tied"):
        expected = {r.g: r.m for r in df.groupBy("g").agg(F.median(value).alias("m")).collect()}
        assert {r.g: r.median for r in exact_median(df, ["g"], value).collect()} == expected
    whole = [r.v for r in df.select("v").collect()] if count <= 50_000 else None
    if whole:
        assert exact_median(df, [], "v").first().median == exact.median(whole)


def matches(table, rows):
    return table([dict(origination_id=o, purchase_id=p, match_score=s) for o, p, s in rows], "origination_id string, purchase_id string, match_score double")


def test_unique_links(table):
    df = matches(table, [("a", "2", 0.5), ("a", "1", 0.5), ("a", "3", 0.4), ("b", "4", None), ("b", "5", 0.1), ("c", "6", None), ("c", "6", None)])
    assert ids(statistics.unique_links(df), "origination_id", "purchase_id") == [("a", "1"), ("b", "5"), ("c", "6")]
    assert statistics.unique_links(df, keep_top_purchase=False).count() == 6
    assert statistics.unique_links(df.drop("match_score")).count() == 6


def test_match_rates(table):
    originations = table(
        [dict(origination_id=o, activity_year=y, lei=lei, loan_type=1.0) for o, y, lei in (("a", 1, "L"), ("b", 1, "L"), ("c", 2, None), ("d", 2, "M"))],
        "origination_id string, activity_year int, lei string, loan_type double",
    )
    purchases = table([dict(purchase_id=p, activity_year=9, purchaser_type=1.0) for p in "12"], "purchase_id string, activity_year int, purchaser_type double")
    links = matches(table, [("a", "1", 1.0), ("a", "2", 0.5), ("c", "2", 1.0), ("elsewhere", "9", 1.0)])
    report = statistics.global_match_rates(originations, purchases, links)
    overall = {r.metric: r.value for r in report["overall"].collect()}
    assert overall["links_total"] == 3 and overall["originations_matched"] == 3 and overall["match_rate_purchases"] == 1.5
    assert [tuple(r) for r in report["by_year"].collect()] == [(1, 2, 1, 0.5), (2, 2, 1, 0.5)]
    assert {tuple(r) for r in report["by_lei"].collect()} == {("L", 2, 1, 0.5), (None, 1, 0, 0.0), ("M", 1, 0, 0.0)}
    nothing = statistics.global_match_rates(originations, purchases.limit(0).drop("purchaser_type"), links.limit(0))
    assert {r.metric: r.value for r in nothing["overall"].collect()}["match_rate_purchases"] is None
    assert nothing["by_purchaser_type"] is None


def test_unmatched_profile(table):
    values = {"a": 1.0, "b": 2.0, "c": float("nan"), "d": 4.0, "e": None}
    originations = table([dict(HMDAIndex=n, activity_year=1, loan_type=1.0, loan_amount=v) for n, v in values.items()], "HMDAIndex string, activity_year int, loan_type double, loan_amount double")
    crosswalk = table([dict(HMDAIndex_s="a", HMDAIndex_p="1"), dict(HMDAIndex_s="d", HMDAIndex_p="2"), dict(HMDAIndex_s="x", HMDAIndex_p="3")], "HMDAIndex_s string, HMDAIndex_p string")
    report = unmatched.profile_unmatched_originations(originations, crosswalk)
    assert {r.metric: r.value for r in report["summary_unmatched_overall"].collect()} == {"N_unmatched": 3.0, "loan_amount_mean": 2.0, "loan_amount_median": 2.0}
    row = report["compare_numeric_matched_vs_unmatched"].first()
    # One unmatched value has no variance, so there is no standardised difference.
    assert (row.matched_mean, row.unmatched_median, row.std_mean_diff) == (2.5, 2.0, None)
    assert [tuple(r) for r in report["compare_mix_rural"].collect()] == [(None, 2, 1.0, 3, 1.0)]
    assert ids(report["unmatched_originations"], "HMDAIndex") == ["b", "c", "e"]
    flat = originations.withColumn("loan_amount", F.lit(3.0))
    same = unmatched.profile_unmatched_originations(flat, crosswalk)["compare_numeric_matched_vs_unmatched"].first()
    assert same.std_mean_diff is None
    assert unmatched.profile_unmatched_originations(originations, crosswalk, ["absent"])["compare_numeric_matched_vs_unmatched"] is None


def test_unmatched_purchases(table):
    purchases = table([dict(HMDAIndex=str(n), activity_year=1, respondent_name=name) for n, name in enumerate(["B", "A", "A", "C", None])], "HMDAIndex string, activity_year int, respondent_name string")
    crosswalk = table([dict(HMDAIndex_s="s", HMDAIndex_p="3")], "HMDAIndex_s string, HMDAIndex_p string")
    report = unmatched.profile_unmatched_purchases(purchases, crosswalk, top_n=2)
    assert [tuple(r) for r in report["unmatched_purchases_by_inst_top"].collect()] == [("A", 2, 0.5), ("B", 1, 0.25)]
    assert report["unmatched_purchases_by_type"] is None


def test_counterparties(table):
    rows = [("a", "x"), ("a", "x"), ("a", "z"), ("a", "y"), ("b", "x"), (None, "x"), ("b", None)]
    df = table([dict(lei_s=s, lei_p=p, respondent_name_s=f"n{s}", respondent_name_p=f"{p}{i % 2}") for i, (s, p) in enumerate(rows)], "lei_s string, lei_p string, respondent_name_s string, respondent_name_p string")
    by_seller, by_purchaser = counterparties.summarize_top_counterparties(df, CounterpartyConfig(top_n=2))
    assert [tuple(r) for r in by_seller.collect()] == [("a", "x", 2, 1), ("a", "y", 1, 2), ("b", "x", 1, 1)]
    assert [tuple(r) for r in by_purchaser.collect()][:2] == [("x", "a", 2, 1), ("x", "b", 1, 2)]
    named = counterparties.top_counterparties_by_seller(df, CounterpartyConfig(top_n=1, include_names=True))
    assert ids(named, "lei_s", "purchaser_name") == [("a", "x0"), ("a", "x1"), ("b", "x0"), ("b", "x1")]
    for config, error in ((CounterpartyConfig(top_n=0), ValueError), (CounterpartyConfig(seller_id="no"), KeyError), (CounterpartyConfig(include_names=True, seller_name=None), ValueError)):
        with pytest.raises(error):
            counterparties.summarize_top_counterparties(df, config)


def matched(table, rows):
    return table(
        [dict(HMDAIndex_s=s, HMDAIndex_p=p, lei_s=a, lei_p=b, activity_year_s=1, purchaser_type_s=t) for s, p, a, b, t in rows],
        "HMDAIndex_s string, HMDAIndex_p string, lei_s string, lei_p string, activity_year_s int, purchaser_type_s double",
    )


def test_relationships(table):
    rows = [(f"s{n}", f"p{n}", "A", "B", 8.0) for n in range(19)] + [("s19", "p19", "A", "B", 6.0)]
    rows += [("twice", "q1", "A", "B", 6.0), ("twice", "q2", "A", "B", 6.0), ("kept", "q3", "A", "B", 0.0), ("null", "q4", "C", "D", None)]
    df = matched(table, rows)
    assert relations.single_sale_links(df).count() == 22
    assert ids(relations.affiliate_candidates(df), "lei_s", "lei_p") == [("A", "B")]
    assert relations.affiliate_candidates(df, min_share=0.96).count() == 0
    assert relations.typed_relationships(df).count() == 0
    assert [tuple(r) for r in relations.typed_relationships(df, min_share=0.9, min_links=19).collect()] == [("A", "B", 8.0, 1, 20, 19)]
    names = table([dict(lei="A")], "lei string")
    assert relations.affiliates(df, names).count() == 0
    assert ids(relations.large_relationships(df, min_links=21), "lei_s", "lei_p") == [("A", "B")]
    assert relations.large_relationships(df, min_links=22).count() == 0


@pytest.mark.parametrize(("accuracy", "margin", "ordered"), [(10, 0.0, 1), (7, 0.0, 50), (100, None, 5), (10_000, None, 1)])
def test_median_when_the_first_bracket_misses(spark, accuracy, margin, ordered):
    """A coarse sketch without a margin brackets other values than the middle ones; exact counts show it, and the rest is bracketed again."""
    df = spark.range(4000).selectExpr("CAST(id % 3 AS INT) AS g", "CAST(pow(id * 7919 % 4001, 2) AS DOUBLE) AS v").unionByName(spark.range(50).selectExpr("CAST(NULL AS INT) AS g", "5.0 AS v"))
    wanted = {r.g: r.m for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    found = exact_median(df, ["g"], "v", accuracy, margin, ordered)
    assert {r.g: r.median for r in found.collect()} == wanted
