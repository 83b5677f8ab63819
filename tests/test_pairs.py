from __future__ import annotations

import itertools
import uuid

import pytest
from rows import ids
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions import people
from loanweave.functions.logic import within_or_unknown
from loanweave.operators import pair_filters as pf
from loanweave.operators import candidates, rivals, uniqueness
from loanweave.operators.candidates import Blocking
from registry import oracle

BASE = "HMDAIndex_s string, HMDAIndex_p string"


def pair(s, p, **values):
    return {"HMDAIndex_s": s, "HMDAIndex_p": p, **values}


def rates(table, rows):
    return table([pair(s, p, interest_rate_s=a, interest_rate_p=b) for s, p, a, b in rows], BASE + ", interest_rate_s double, interest_rate_p double")


def test_numeric_matches_boundaries_and_missing_columns(table):
    df = rates(table, [("at", "1", 4.0, 4.0625), ("over", "2", 4.0, 4.07), ("null", "3", None, 4.0), ("both", "4", None, None)])
    kept = pf.numeric_matches(df, {"interest_rate": 0.0625, "income": 1})
    assert ids(kept, "HMDAIndex_s") == ["at", "both", "null"]
    assert kept.columns == df.columns
    assert "interest_rate_difference" in pf.numeric_matches(df, {"interest_rate": 1}, drop_differences=False).columns


def test_weak_numeric_matches(table):
    rows = [
        ("a", "1", 4.0, 4.0), ("a", "2", 4.0, 4.05),  # exact rival of the sale
        ("b", "3", 4.0, 4.05), ("c", "3", 4.05, 4.05),  # exact rival of the purchase
        ("d", "4", 4.0, 4.02), ("d", "5", 4.0, 4.05),  # best rival is not exact
        ("e", "6", None, 4.0), ("e", "7", None, 4.0),  # all unknown
        ("f", "8", 4.0, 4.0), ("f", "9", 4.0, None),  # unknown beside exact
        ("g", "10", 4.0, 4.0), ("g", "11", 4.0, 4.01),  # at the tolerance (in floats just below it)
    ]
    kept = ids(pf.weak_numeric_matches(rates(table, rows), {"interest_rate": 0.02}))
    assert ("a", "2") not in kept and ("b", "3") not in kept
    assert len(kept) == len(rows) - 2
    shown = pf.weak_numeric_matches(rates(table, rows), {"interest_rate": 0.02}, drop_differences=False)
    assert ids(shown) == kept and "min_interest_rate_difference_s" in shown.columns


def test_post_unique_drops_the_whole_sale(table):
    rows = [("a", "1", 4.0, 4.0), ("a", "2", 4.0, 5.0), ("b", "3", None, 5.0), ("c", "4", 4.0, 4.0)]
    kept = pf.numeric_matches_post_unique(rates(table, rows), {"interest_rate": 0.01})
    assert ids(kept) == [("b", "3"), ("c", "4")]


def test_fees(table):
    names = [f"{f}_{x}" for f in schema.FEE_COLUMNS for x in ("s", "p")]
    schema_text = BASE + ", " + ", ".join(f"{n} double" for n in names)
    rows = [
        pair("same", "1", total_loan_costs_s=5.0, total_loan_costs_p=5.0, origination_charges_s=7.0, origination_charges_p=7.0),
        pair("cross", "2", total_loan_costs_s=5.0, lender_credits_p=5.0),
        pair("none_s", "3", total_loan_costs_p=5.0),
        pair("differ", "4", total_loan_costs_s=5.0, total_loan_costs_p=6.0),
        pair("empty", "5"),
    ]
    df = table(rows, schema_text)
    counted = {r.HMDAIndex_s: (r.NumberFeeMatches, r.NumberNonmissingFees_s, r.NumberNonmissingFees_p, r.i_GenerousFeeMatch) for r in pf.fee_match_counts(df).collect()}
    assert counted == {"same": (2, 2, 2, 1), "cross": (0, 1, 1, 1), "none_s": (0, 0, 1, 0), "differ": (0, 1, 1, 0), "empty": (0, 0, 0, 0)}
    assert ids(pf.fee_filter_strict(df), "HMDAIndex_s") == ["empty", "none_s", "same"]
    assert ids(pf.fee_filter_generous(df), "HMDAIndex_s") == ["cross", "empty", "none_s", "same"]


def test_dominance(table):
    incomes = [("a", "1", 50.0, 50.0), ("a", "2", 50.0, None), ("a", "3", 50.0, 51.0), ("a", "4", 50.0, 52.0), ("b", "5", 50.0, None), ("c", "6", 9.0, 8.0), ("d", "6", 8.0, 8.0), ("e", "6", None, 8.0)]
    df = table([pair(s, p, income_s=a, income_p=b) for s, p, a, b in incomes], BASE + ", income_s double, income_p double")
    assert ids(pf.income_dominance(df)) == [("a", "1"), ("a", "3"), ("b", "5"), ("c", "6"), ("d", "6")]
    kept = pf.rate_dominance(rates(table, [("a", "1", 4.0, 4.0), ("a", "2", 4.0, 4.01), ("a", "3", 4.0, None), ("b", "4", 4.0, 4.01)]))
    assert ids(kept) == [("a", "1"), ("b", "4")]
    fee_rows = [("a", "1", 2, 1), ("a", "2", 0, 0), ("b", "2", 1, 1), ("c", "3", 0, 0)]
    fees = table([pair(s, p, NumberFeeMatches=n, i_GenerousFeeMatch=g) for s, p, n, g in fee_rows], BASE + ", NumberFeeMatches int, i_GenerousFeeMatch int")
    assert ids(pf.fee_dominance(fees)) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_seller_cleanup(table):
    columns = BASE + ", " + ", ".join(f"{c} double" for c in ("income_s", "interest_rate_s", "interest_rate_p", "property_value_s"))
    good = dict(income_s=5.0, interest_rate_s=4.0, interest_rate_p=4.0, property_value_s=9.0)
    rows = [
        pair("ok", "1", **good), pair("no_rate_p", "2", **{**good, "interest_rate_p": None}),
        pair("off", "3", **{**good, "interest_rate_p": 4.01}), pair("off", "4", **good), pair("no_value", "5", **{**good, "property_value_s": None}),
    ]
    assert ids(pf.seller_cleanup(table(rows, columns)), "HMDAIndex_s") == ["no_rate_p", "ok"]


def test_purposes_and_types(table):
    codes = [1.0, 2.0, 31.0, 32.0, None]
    rows = [pair(str(a), str(b), loan_purpose_s=a, loan_purpose_p=b) for a, b in itertools.product(codes, codes)]
    df = table(rows, BASE + ", loan_purpose_s double, loan_purpose_p double")
    refi = ("31.0", "32.0")
    expected = lambda either: sorted(
        (s, p) for s, p in ((str(a), str(b)) for a, b in itertools.product(codes, codes))
        if (s == p and s != "None") or ((s in refi or p in refi) if either else (s in refi and p in refi))
    )
    assert ids(pf.purpose_compat(df, "either")) == expected(True)
    assert ids(pf.purpose_compat(df, "both")) == expected(False)
    with pytest.raises(ValueError):
        pf.purpose_compat(df, "neither")
    rows = [pair(f"{a}{b}{t}", "p", activity_year_s=a, activity_year_p=b, purchaser_type_s=t) for a, b, t in itertools.product((1,), (1, 2), (0.0, 6.0, None))]
    df = table(rows, BASE + ", activity_year_s int, activity_year_p int, purchaser_type_s double")
    assert ids(pf.year_type_consistency(df), "HMDAIndex_s") == ["116.0", "11None", "120.0"]


CODES = {
    "sex": ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None], pf.match_sex, oracle.sex()),
    "sex_pre2018": ([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, None], pf.match_sex_pre2018, oracle.sex_pre2018()),
    "age": ([1.0, 2.0, 8888.0, 9999.0, None], pf.match_age, oracle.age()),
    "ethnicity_pre2018": ([1.0, 2.0, 3.0, 4.0, 5.0, None], pf.match_ethnicity_pre2018, oracle.ethnicity_pre2018()),
}


@pytest.mark.parametrize("rule", list(CODES))
def test_borrower_rules_against_one_test_per_code(spark, rule):
    """Every combination of codes of both people on both records."""
    codes, operator, test = CODES[rule]
    stem = rule.split("_")[0]
    names = [f"{who}_{stem}_{side}" for who in schema.PEOPLE for side in ("s", "p")]
    rows = [(str(n), *c) for n, c in enumerate(itertools.product(codes, repeat=4))]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} double" for n in names))
    assert ids(operator(df), "id") == ids(df.filter(test), "id")


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("trait", ["race", "ethnicity"])
def test_traits_against_one_test_per_code(spark, trait, strict):
    """All primary codes, subcategories and matches through a later slot."""
    codes = {"race": [1.0, 2.0, 6.0, 7.0, 8.0, 21.0, 44.0, None], "ethnicity": [1.0, 2.0, 3.0, 4.0, 5.0, 12.0, None]}[trait]
    slots = [f"{who}_{trait}_{n}_{side}" for who in schema.PEOPLE for n in range(1, 6) for side in ("s", "p")]
    rows = []
    for who in schema.PEOPLE:
        for a, b, later in itertools.product(codes, codes, (None, 1.0, 22.0, 11.0)):
            for slot in (2, 5):
                given = {f"{who}_{trait}_1_s": a, f"{who}_{trait}_1_p": b, f"{who}_{trait}_{slot}_p": later}
                other = "applicant" if who == "co_applicant" else "co_applicant"
                given |= {f"{other}_{trait}_1_s": 2.0, f"{other}_{trait}_1_p": 2.0}
                rows.append((str(len(rows)), *[given.get(s) for s in slots]))
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{s} double" for s in slots))
    operator = pf.match_race if trait == "race" else pf.match_ethnicity
    test = (oracle.race if trait == "race" else oracle.ethnicity)(strict)
    recoded = spark.sql(oracle.main_codes("{df}", (trait,)).replace("SELECT * REPLACE (", "SELECT id, ").replace(") FROM", " FROM"), df=df)
    assert ids(operator(df, strict), "id") == ids(recoded.filter(test), "id")


def links(table, rows):
    return table([pair(s, p, purchaser_type_p=t) for s, p, t in rows], BASE + ", purchaser_type_p double")


def test_keep_uniques(table):
    rows = [
        ("one", "1", 1.0), ("x", "2", 1.0), ("y", "2", 1.0),  # one purchase, two sales
        ("two", "3", 1.0), ("two", "4", 6.0), ("plain", "5", 1.0), ("plain", "6", 2.0),
        # falls from two purchases to one; the one left is (not) a secondary purchase
        ("left", "7", 6.0), ("left", "2", 1.0), ("lost", "8", 1.0), ("lost", "2", 6.0),
        ("three", "9", 6.0), ("three", "10", 6.0), ("three", "11", 1.0), ("unknown", "12", None), ("unknown", "13", None),
    ]
    df = links(table, rows)
    assert ids(uniqueness.keep_uniques(df)) == [("one", "1")]
    assert ids(uniqueness.keep_uniques(df, one_to_one=False)) == [("left", "7"), ("one", "1"), ("two", "3"), ("two", "4")]
    counts = {(r.count_index_s, r.count_index_p): r.pairs for r in uniqueness.match_cardinality(df).collect()}
    assert counts[(1, 1)] == 1 and sum(counts.values()) == len(rows)


def test_keep_uniques_pre2018_groups_missing_id_parts(table):
    columns = "activity_year_s int, respondent_id_s string, activity_year_p int, respondent_id_p string, purchaser_type_p double"
    rows = [
        dict(activity_year_s=1, respondent_id_s=None, activity_year_p=1, respondent_id_p="a"),
        dict(activity_year_s=1, respondent_id_s=None, activity_year_p=1, respondent_id_p="b"),
        dict(activity_year_s=1, respondent_id_s="z", activity_year_p=1, respondent_id_p="c"),
        dict(activity_year_s=None, respondent_id_s="q", activity_year_p=1, respondent_id_p="d"),
    ]
    kept = uniqueness.keep_uniques_pre2018(table(rows, columns))
    assert ids(kept, "respondent_id_p") == ["c"]


def test_attrition(table):
    df = rates(table, [("a", "1", 4.0, 4.0), ("b", "2", 4.0, 5.0), ("c", "3", None, 5.0)])
    assert ids(uniqueness.filter_attrition(df, {"interest_rate": 0.1}), "column", "dropped") == [("interest_rate", 1)]
    seen = Observation()
    kept = uniqueness.observe_attrition(df, {"rate": within_or_unknown(pf.difference("interest_rate"), 0.1), "known": F.col("interest_rate_s").isNotNull()}, seen)
    assert kept.count() == 1 and seen.get == {"rate": 1, "known": 1}


def test_a_sale_with_very_many_rivals(spark):
    """Contests and uniqueness agree with plain rules where one sale has most pairs, and no task holds its rivals."""
    n = 20_000
    rows = [("hot", str(i), 4.0, 4.0 if i == 7 else 4.05) for i in range(n)] + [(f"s{i}", f"q{i % 300}", 4.0, 4.0 + 0.03 * (i % 3)) for i in range(600)]
    rows += [("lone", "x", 4.0, 4.0), ("pair", "y", 4.0, 4.0), ("pair", "z", 4.0, 4.0)]
    df = spark.createDataFrame(rows, BASE + ", interest_rate_s double, interest_rate_p double").withColumn("purchaser_type_p", F.lit(8.0)).repartition(8)
    best = {}
    for s, p, a, b in rows:
        for key in (("s", s), ("p", p)):
            best[key] = min(best.get(key, 9.0), abs(a - b))
    kept = {(s, p) for s, p, a, b in rows if abs(a - b) <= 0.01 or (best["s", s] > 0 and best["p", p] > 0)}
    contested = pf.closest(df, F.abs(pf.difference("interest_rate")), 0.01)
    assert set(map(tuple, contested.select("HMDAIndex_s", "HMDAIndex_p").collect())) == kept
    unique = uniqueness.keep_uniques(df)
    sales, purchases = {}, {}
    for s, p, *_ in rows:
        sales[s], purchases[p] = sales.get(s, 0) + 1, purchases.get(p, 0) + 1
    assert ids(unique) == sorted((s, p) for s, p, *_ in rows if sales[s] == 1 and purchases[p] == 1)
    assert ids(uniqueness.keep_uniques(df, one_to_one=False)) == sorted((s, p) for s, p, *_ in rows if sales[s] <= 2 and purchases[p] == 1)
    for plan in (contested, unique):
        assert "Window" not in plan._jdf.queryExecution().toString()
    # What is joined back to the pairs of one sale is spread over the parts of its other sides.
    counted = pf.over_sides(df, {"pairs": F.count(F.lit(1))}, ("s",)).filter("HMDAIndex_s = 'hot'")
    assert counted.select("pairs_s").distinct().collect()[0][0] == n
    spread = [r["count"] for r in df.filter("HMDAIndex_s = 'hot'").groupBy(F.pmod(F.xxhash64("HMDAIndex_p"), F.lit(rivals.PARTS))).count().collect()]
    assert len(spread) == rivals.PARTS and max(spread) < 2 * n / rivals.PARTS


def formed(spark, loans):
    """Pairs that are formed by a join of files and not written."""
    blocking = Blocking(("block",))
    return candidates.block_join(*candidates.split_sides(loans), blocking)


def loans_of_blocks(spark, tmp_path):
    rows = [(f"S{b}-{i}", 1.0, f"b{b}", 4.0 + 0.01 * i, "wide") for b in range(20) for i in range(4)]
    rows += [(f"P{b}-{i}", 6.0, f"b{b}", 4.0 + 0.01 * i * (b % 3), "wide") for b in range(20) for i in range(3)]
    rows += [(None, 1.0, "b1", 4.0, "wide"), ("S2-0", 1.0, "b2", 4.01, "twice"), ("S3-0", 1.0, "b3", None, "wide")]
    path = str(tmp_path / "loans")
    spark.createDataFrame(rows, "HMDAIndex string, action_taken double, block string, interest_rate double, wide string").write.parquet(path)
    return spark.read.parquet(path)


def joins_above(plan: str, kind: str, pairs_key: str = "block"):
    """Depths of the joins of a kind and of those that form pairs, in the optimized plan."""
    lines = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    return [depth(x) for x in lines if f"Join {kind}" in x], [depth(x) for x in lines if "Join Inner" in x and f"{pairs_key}#" in x]


def test_contests_on_pairs_that_are_not_written_move_no_pairs(spark, tmp_path):
    """The test whether a rival won is made on the loans, below the join that forms the pairs, and nothing is multiplied for it."""
    loans = loans_of_blocks(spark, tmp_path)
    gap = F.abs(pf.difference("interest_rate"))
    for contest in (lambda d: pf.rate_dominance(d), lambda d: pf.closest(d, gap, 0.01), lambda d: pf.drop_sales_where(d, gap > 0.015)):
        found = contest(formed(spark, loans))
        plan = found._jdf.queryExecution().toString()
        optimized = plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        assert "Generate" not in optimized and "explode" not in optimized
        anti, forming = joins_above(plan, "LeftAnti")
        assert anti and min(forming) < min(anti)
        written = str(tmp_path / uuid.uuid4().hex)
        formed(spark, loans).write.parquet(written)
        assert ids(found) == ids(contest(spark.read.parquet(written)))


def test_uniqueness_on_pairs_that_are_not_written_moves_no_pairs(spark, tmp_path):
    pairs = formed(spark, loans_of_blocks(spark, tmp_path)).filter(F.abs(pf.difference("interest_rate")) < 0.005)
    found = uniqueness.keep_uniques(pairs)
    semi, forming = joins_above(found._jdf.queryExecution().toString(), "LeftSemi")
    assert semi and min(forming) < min(semi)
    rows = ids(pairs)
    alone = [r for r in rows if None not in r and sum(r[0] == x[0] for x in rows) == 1 and sum(r[1] == x[1] for x in rows) == 1]
    assert ids(found) == alone and alone


def test_small_files_of_many_records_are_not_broadcast_unmeasured(spark, tmp_path):
    """Compressed files say little about the size in memory; lists measured at run time may be broadcast."""
    path = str(tmp_path / "written")
    spark.range(1_500_000).selectExpr("id", "repeat('x', 200) AS text").coalesce(1).write.parquet(path)
    table = spark.read.parquet(path)
    plan = table.join(table.withColumnRenamed("text", "other"), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_lists_of_a_contest_are_not_broadcast_though_measured(spark):
    """Some megabytes of ids, four lists at once, would fill the driver."""
    name = F.concat(F.lit("loan of a contest "), F.col("id").cast("string"))
    pairs = spark.range(150_000).select(name.alias("HMDAIndex_s"), name.alias("HMDAIndex_p"), (F.col("id") % 2).alias("gap"))
    found = rivals.contest(pairs, F.col("gap") < 0, F.col("gap") == 0)
    assert len(found.collect()) == 75_000
    final = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "isFinalPlan=true" in final and "Broadcast" not in final


def test_cardinality_of_pairs_that_are_not_written_moves_no_pairs(spark, tmp_path):
    def form(sellers, purchasers):
        pairs = candidates.block_join(sellers, purchasers, Blocking(("block",)))
        return pairs.filter(F.abs(pf.difference("interest_rate")) < 0.015)

    loans = loans_of_blocks(spark, tmp_path)
    sides = candidates.split_sides(loans.unionByName(loans.limit(1).withColumns({"HMDAIndex": F.lit(None).cast("string"), "action_taken": F.lit(6.0)})))
    found = uniqueness.match_cardinality(form(*sides), formed=(*sides, form))
    assert sorted(found.collect()) == sorted(uniqueness.match_cardinality(form(*sides)).collect())
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    depths = [len(x) - len(x.lstrip(" :+-")) for x in joins]
    assert "block#" in joins[0] and depths.count(min(depths)) == 1


@pytest.mark.parametrize("traits, test", [
    (people.TRAITS, pf.match_race), (people.TRAITS, pf.match_ethnicity), (people.TRAITS, pf.match_sex),
    (people.TRAITS_PRE2018, pf.match_race_pre2018), (people.TRAITS_PRE2018, pf.match_ethnicity_pre2018), (people.TRAITS_PRE2018, pf.match_sex_pre2018),
])
def test_traits_that_loans_carry_are_not_read_per_pair(spark, tmp_path, traits, test):
    columns = list(dict.fromkeys(c for reports in traits.values() for report in reports for c in report.columns))
    codes = [F.lit(None), *(F.lit(float(c)) for c in (1, 2, 3, 4, 5, 6, 7, 8, 11, 14, 21, 27, 44))]
    ids_and_side = [F.concat(F.lit("L"), "id").alias("HMDAIndex"), (F.col("id") % 2 * 5 + 1).cast("double").alias("action_taken"), (F.col("id") % 3).alias("block")]
    slots = [F.get(F.array(*codes), F.pmod(F.xxhash64("id", F.lit(c)), F.lit(len(codes))).cast("int")).cast("double").alias(c) for c in columns]
    spark.range(120).select(*ids_and_side, *slots).write.parquet(str(tmp_path / "loans"))
    loans = spark.read.parquet(str(tmp_path / "loans"))
    carried = test(formed(spark, loans.withColumns(people.trait_bits(traits)))).select("HMDAIndex_s", "HMDAIndex_p")
    assert ids(carried) == ids(test(formed(spark, loans))) and not carried.isEmpty()
    (join,) = [x for x in carried._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert not any(f"{c}_s#" in join for c in columns)


def test_attrition_tests_a_pair_once_per_tolerance(table):
    tolerances = {c: 1.0 for c in ("a", "b", "c", "d")}
    schema_of = BASE + "".join(f", {c}_{side} double" for c in tolerances for side in ("s", "p"))
    values = [(0, 0, 0, 0), (2, 2, 0, 0), (0, 2, 0, 2), (None, 2, 2, 2), (0, 0, 0, 9)]
    rows = [pair(str(n), str(n), **{f"{c}_s": v for c, v in zip(tolerances, found)}, **{f"{c}_p": 0 for c in tolerances}) for n, found in enumerate(values)]
    rows = [{k: float(v) if isinstance(v, int) else v for k, v in row.items()} for row in rows]
    attrition = uniqueness.filter_attrition(table(rows, schema_of), tolerances)
    assert {r["column"]: r["dropped"] for r in attrition.collect()} == {"a": 1, "b": 2, "c": 0, "d": 1}
    assert attrition._jdf.queryExecution().optimizedPlan().toString().count("abs(") == len(tolerances)
