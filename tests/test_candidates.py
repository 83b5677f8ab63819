from __future__ import annotations

import random

import pytest
from rows import ids
from pyspark.sql import functions as F

from loanweave import schema, session
from loanweave.operators import candidates, rivals, uniqueness
from loanweave.operators import pair_filters as pf
from loanweave.operators.candidates import Blocking, LoanLayout
from loanweave.plans import post2018, pre2018

LOAN = "HMDAIndex string, action_taken double"


def loan(name, action, **values):
    return {"HMDAIndex": name, "action_taken": float(action), **values}


def test_keep_potential_matches(table):
    rows = [loan("a", 1, k="x"), loan("b", 6, k="x"), loan("c", 1, k="y"), loan("d", 1, k=None), loan("e", 6, k=None), loan("f", 3, k="x")]
    assert ids(candidates.keep_potential_matches(table(rows, LOAN + ", k string"), ["k"]), "HMDAIndex") == ["a", "b", "f"]


def test_exclusion_of_linked_loans(table):
    loans = table([loan(n, a) for n, a in (("s1", 1), ("s2", 1), ("p1", 6), ("p2", 6), ("x", 3))], LOAN)
    crosswalk = table([{"HMDAIndex_s": "s1", "HMDAIndex_p": "p1"}], "HMDAIndex_s string, HMDAIndex_p string")
    sellers, purchasers = candidates.split_sides(loans, crosswalk)
    assert (ids(sellers, "HMDAIndex"), ids(purchasers, "HMDAIndex")) == (["s2"], ["p2"])
    pairs = candidates.block_join(*(d.withColumn("k", F.lit(1)) for d in candidates.split_sides(loans)), Blocking(("k",)))
    assert ids(candidates.unlinked(pairs, crosswalk)) == [("s2", "p2")]


def test_composite_exclusion_matches_missing_parts(table):
    columns = "activity_year int, respondent_id string"
    loans = table([dict(activity_year=1, respondent_id=r) for r in ("a", "b", None)], columns)
    crosswalk = table(
        [dict(activity_year_s=1, respondent_id_s=None, activity_year_p=1, respondent_id_p="a")],
        "activity_year_s int, respondent_id_s string, activity_year_p int, respondent_id_p string",
    )
    assert ids(candidates.anti_matched_composite(loans, crosswalk), "respondent_id") == ["b"]


def test_band_join_amount(table):
    amounts = {"p0": 105000.0, "p+": 115000.0, "p-": 95000.0, "far": 125000.0, "near": 105001.0, "none": None}
    rows = [loan("s", 1, k=1, loan_amount=105000.0)] + [loan(n, 6, k=1, loan_amount=a) for n, a in amounts.items()]
    sides = candidates.split_sides(table(rows, LOAN + ", k int, loan_amount double"))
    joined = candidates.band_join_amount(*sides, ["k"])
    assert ids(joined, "HMDAIndex_p") == ["p+", "p-", "p0"]
    assert ids(pf.amount_direction(joined), "HMDAIndex_p") == ["p-", "p0"]


def test_bin_overlap_join(table):
    sales = {"s0": 100.0, "s4": 104.0, "s5": 105.0, "s9": 109.0}
    purchases = {"p99": 99.0, "p100": 100.0, "p109": 109.0, "p110": 110.0}
    rows = [loan(n, 1, k=1, loan_amount=a) for n, a in sales.items()] + [loan(n, 6, k=1, loan_amount=a) for n, a in purchases.items()]
    joined = candidates.bin_overlap_join(*candidates.split_sides(table(rows, LOAN + ", k int, loan_amount double")), ["k"])
    same_bin = [(s, p) for s in sales for p in ("p100", "p109")]
    assert ids(joined) == sorted(same_bin + [("s0", "p99"), ("s4", "p99")])


def test_purchaser_types_years_and_lenders(table):
    pairs = table(
        [dict(HMDAIndex_s=n, lei_s="a", lei_p=p, activity_year_s=1, purchaser_type_s=t) for n, p, t in (("hit", "b", 6.0), ("zero", "z", 0.0), ("miss", "b", 8.0), ("null", "b", None))],
        "HMDAIndex_s string, lei_s string, lei_p string, activity_year_s int, purchaser_type_s double",
    )
    known = table([dict(lei_s="a", lei_p="b", activity_year_s=1, purchaser_type_s=6.0)] * 2, "lei_s string, lei_p string, activity_year_s int, purchaser_type_s double")
    assert ids(candidates.purchaser_type_check(pairs, known), "HMDAIndex_s") == ["hit", "zero"]
    years = table([dict(activity_year_s=a, activity_year_p=b) for a, b in ((1, 0), (1, 1), (1, 2), (1, 3))], "activity_year_s int, activity_year_p int")
    assert ids(candidates.year_window(years), "activity_year_p") == [1, 2, 3]
    assert ids(candidates.year_window(years, 1), "activity_year_p") == [1, 2]
    lenders = [("same", "a", "a", 1, 1), ("id", "a", "b", 1, 1), ("agency", "a", "a", 1, 2), ("null", None, None, 1, 1)]
    df = table(
        [dict(n=n, respondent_id_s=a, respondent_id_p=b, agency_code_s=c, agency_code_p=d) for n, a, b, c, d in lenders],
        "n string, respondent_id_s string, respondent_id_p string, agency_code_s int, agency_code_p int",
    )
    assert ids(candidates.different_lenders(df), "n") == ["agency", "id", "null"]


@pytest.mark.parametrize("tolerance", [0, 1, 0.0625])
def test_bands_meet_once_and_lose_no_pair(spark, tolerance):
    chance = random.Random(7)
    grid = [None] + [tolerance * n / 4 for n in range(-9, 40)] + [chance.uniform(-3, 9) for _ in range(30)]
    values = spark.createDataFrame([(n, v) for n, v in enumerate(grid)], "n int, v double")
    s = values.select(F.col("n").alias("s"), F.col("v").alias("a"), F.explode(candidates.seller_bands(F.col("v"), tolerance)).alias("cell"))
    p = values.select(F.col("n").alias("p"), F.col("v").alias("b"), F.explode(candidates.purchaser_bands(F.col("v"), tolerance)).alias("cell"))
    met = [(r.s, r.p) for r in s.join(p, "cell").collect()]
    assert len(met) == len(set(met))
    wanted = {(i, j) for i, a in enumerate(grid) for j, b in enumerate(grid) if a is None or b is None or abs(a - b) <= tolerance}
    assert wanted <= set(met)


def random_loans(spark, seed: int, count: int = 400):
    """Prepared loans of which a third are in one block, many of them copies."""
    chance = random.Random(seed)
    names = [c for c in dict.fromkeys(post2018.PREPARED_COLUMNS)]
    texts = {schema.LOAN_ID, post2018.BLOCK, "census_tract", "lei"}
    rows, template = [], None
    for n in range(count):
        bought = chance.random() < 0.5
        if template is None or chance.random() < 0.6:
            hot = chance.random() < 0.4
            block = "hot" if hot else f"b{chance.randrange(6)}"
            amount = 5000.0 + 10000 * (0 if hot else chance.randrange(3))
            template = {c: 1.0 for c in names} | {
                "loan_type": 1.0, "loan_amount": amount, "LoanAmountMatch": amount, "census_tract": block, "county_code": 1.0,
                "block": f"{block}{amount}", "loan_purpose": chance.choice([1.0, 31.0, 32.0]), "i_Purchase": 1,
                "income": chance.choice([None, 50.0, 51.0, 53.0]), "interest_rate": chance.choice([None, 4.0, 4.005, 4.05, 4.5]),
                "total_loan_costs": chance.choice([None, 10.0, 11.0]), "discount_points": chance.choice([None, 10.0, 3.0]),
                "origination_charges": chance.choice([None, 3.0]), "total_points_and_fees": None, "lender_credits": None,
                "property_value": chance.choice([90000.0, 95000.0, 200000.0]), "loan_term": chance.choice([360.0, 180.0]),
                "lei": chance.choice("AB"), "people_needs": chance.choice([0, 1, 2]), "people_offers": chance.choice([3, 3, 1]),
            }
            template["fees_reported"] = sum(template[f] is not None for f in schema.FEE_COLUMNS)
            template["i_Purchase"] = int(template["loan_purpose"] == 1.0)
        row = dict(template)
        row |= {schema.LOAN_ID: f"{'P' if bought else 'S'}{n}", "action_taken": 6.0 if bought else 1.0}
        row["activity_year"] = chance.choice([2018, 2018, 2018, 2019])
        row["purchaser_type"] = chance.choice([0.0, 1.0, 6.0]) if bought else chance.choice([0.0, 6.0, 8.0])
        rows.append(row)
    whole = {"activity_year", "i_Purchase", "fees_reported"}
    longs = {"people_needs", "people_offers"}
    kind = lambda c: "string" if c in texts else "int" if c in whole else "bigint" if c in longs else "double"
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} {kind(c)}" for c in names))


@pytest.mark.parametrize("number", range(1, 9))
def test_crowded_blocks_give_the_same_pairs_and_links(spark, table, number):
    """Banding and cutting into pieces changes neither facts nor links, also
    when copies of a loan were linked before."""
    loans = random_loans(spark, 100 + number).cache()
    linked = [r[0] for r in loans.select(schema.LOAN_ID).collect()][::9]
    crosswalk = spark.createDataFrame([(n, n) for n in linked], "HMDAIndex_s string, HMDAIndex_p string")
    types = table([dict(lei_s="A", lei_p="B", activity_year_s=2018, purchaser_type_s=6.0)], "lei_s string, lei_p string, activity_year_s int, purchaser_type_s double")
    affiliates = table([dict(lei_s="A", lei_p="B")], "lei_s string, lei_p string")
    spec = post2018.ROUNDS[number]

    def result(given, limit):
        facts = post2018.candidate_facts(spec, given, crosswalk, types, limit)
        links = post2018.link(number, given, crosswalk, affiliates, types, limit)
        return sorted(map(repr, facts.select(sorted(facts.columns)).collect())), ids(links), sorted(map(repr, uniqueness.match_cardinality(facts).collect()))

    plain = result(loans, None)
    assert plain[0]
    layout = post2018.lay_out(loans, max_block_pairs=200)
    assert layout.crowded is not None
    for given in (loans, layout):
        assert result(given, 3) == plain


def test_low_limit_of_blocks_moves_no_loan_more_often(spark, monkeypatch):
    """Pieces follow their own limit, so that many copies in a block called crowded are not moved once for every few pairs."""
    rows = [(f"{side}{n}", action, "b", 4.0) for side, action in (("S", 1.0), ("P", 6.0)) for n in range(30)]
    loans = spark.createDataFrame(rows, "HMDAIndex string, action_taken double, block string, interest_rate double")
    sides, moved, joined = candidates.split_sides(loans), [], candidates._join
    monkeypatch.setattr(candidates, "_join", lambda s, p, keys: moved.append(s.count() + p.count()) or joined(s, p, keys))
    for pieces, most in (({}, 60), ({"max_piece_pairs": 20}, 60 * 7)):
        blocking = Blocking(("block",), bands={"interest_rate": 0.0625}, max_block_pairs=20, **pieces)
        assert len(ids(candidates.crowded_join(*sides, blocking))) == 900
        assert moved.pop() == most


def test_loans_that_cannot_meet_are_spread(spark):
    """Loans without a block and of one-sided blocks fill no bucket; the rounds on other keys still see them."""
    rows = [(f"S{n}", 1.0, "sales only" if n < 300 else None if n < 600 else f"b{n % 40}") for n in range(1000)]
    rows += [(f"P{n}", 6.0, f"b{n % 40}") for n in range(400)]
    loans = spark.createDataFrame(rows, "HMDAIndex string, action_taken double, block string").withColumn("census_tract", F.col("block"))
    layout = post2018.lay_out(loans, max_block_pairs=10_000)
    assert layout.crowded is None and layout.calm.columns == loans.columns
    sizes = [r["count"] for r in layout.calm.repartition(16, "block").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * 1400 / 16
    joined = lambda df: ids(candidates.block_join(*candidates.split_sides(df), Blocking(("block",))))
    assert joined(layout.calm) == joined(loans)
    assert layout.calm.filter("census_tract IS NULL").count() == 300


def test_block_sizes_and_crowded(table):
    rows = [loan(f"s{n}", 1, k="a") for n in range(4)] + [loan(f"p{n}", 6, k="a") for n in range(3)] + [loan("s9", 1, k="b"), loan("p9", 6, k="b"), loan("s8", 1, k="c")]
    sides = candidates.split_sides(table(rows, LOAN + ", k string"))
    sizes = {r.k: (r.block_sellers, r.block_purchasers) for r in candidates.block_sizes(*sides, ["k"]).collect()}
    assert sizes == {"a": (4, 3), "b": (1, 1)}
    assert ids(candidates.crowded_blocks(*sides, Blocking(("k",), max_block_pairs=11)), "k") == ["a"]
    assert candidates.crowded_blocks(*sides, Blocking(("k",), max_block_pairs=12)) is None


def test_required_inputs(table):
    loans = LoanLayout(table([], "HMDAIndex string"))
    for number, given in ((2, {}), (6, {"crosswalk": loans.calm}), (7, {"crosswalk": loans.calm})):
        with pytest.raises(ValueError):
            post2018.link(number, loans, **given)


def test_pre2018_crowded(spark):
    """Copies and crowded blocks in the older rounds."""
    chance = random.Random(3)
    rows, template = [], None
    for n in range(500):
        if template is None or chance.random() < 0.6:
            template = dict(
                loan_type=1.0, loan_purpose=1.0, occupancy_type=1.0, property_type=1.0,
                census_tract="hot" if chance.random() < 0.5 else f"t{chance.randrange(5)}",
                loan_amount=float(chance.randrange(98, 113)), income=chance.choice([None, 50.0, 51.0, 54.0, 60.0]),
                respondent_id=chance.choice(["a", "b", None]), agency_code=1.0, people_needs=0, people_offers=0,
            )
        bought = chance.random() < 0.5
        rows.append(template | dict(HMDAIndex=str(n), sequence_number=n, action_taken=6.0 if bought else 1.0, purchaser_type=chance.choice([0.0, 1.0]), activity_year=chance.choice([2010, 2011])))
    texts, longs, whole = {"HMDAIndex", "census_tract", "respondent_id"}, {"people_needs", "people_offers", "sequence_number"}, {"activity_year"}
    kind = lambda c: "string" if c in texts else "bigint" if c in longs else "int" if c in whole else "double"
    names = list(rows[0])
    loans = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} {kind(c)}" for c in names)).cache()
    first = pre2018.link_round1(loans, max_block_pairs=None)
    assert first.count() > 0
    assert ids(pre2018.link_round1(loans, max_block_pairs=3)) == ids(first)
    crosswalk = pre2018.crosswalk_round1(loans)
    second = pre2018.link_round2(loans, crosswalk, max_block_pairs=None)
    assert ids(pre2018.link_round2(loans, crosswalk, max_block_pairs=3)) == ids(second)


@pytest.mark.parametrize("number", [1, 3])
def test_rounds_evaluate_pairs_in_small_methods(spark, monkeypatch, number):
    """What a round forms and writes runs as methods that are compiled well; the session's own limit is restored."""
    loans = random_loans(spark, 40 + number)
    crosswalk = spark.createDataFrame([], "HMDAIndex_s string, HMDAIndex_p string")
    own, limits = spark.conf.get(session.METHOD_LIMIT), []

    def written(df):
        limits.append(int(spark.conf.get(session.METHOD_LIMIT)))
        return session.cut_lineage(df)

    monkeypatch.setattr(post2018, "cut_lineage", written)
    post2018.link(number, loans, crosswalk)
    assert limits and max(limits) <= 2000
    assert spark.conf.get(session.METHOD_LIMIT) == own
    with pytest.raises(RuntimeError), session.small_methods(spark):
        raise RuntimeError
    assert spark.conf.get(session.METHOD_LIMIT) == own


@pytest.mark.parametrize("number", [1, 3])
def test_rounds_write_no_pairs_of_hopeless_records(spark, monkeypatch, number):
    """Copies on both sides form many pairs; what a round writes grows with the loans."""
    template = random_loans(spark, 5, 1).first().asDict() | {
        "block": "b5000.0", "loan_purpose": 1.0, "i_Purchase": 1, "income": 50.0, "interest_rate": 4.0, "activity_year": 2018,
        "people_needs": 0, "people_offers": 3, "purchaser_type": 6.0,
    }
    names = list(template)
    rows = [template | {"HMDAIndex": f"{side}{n}", "action_taken": action} for side, action in (("S", 1.0), ("P", 6.0)) for n in range(40)]
    rows += [template | {"HMDAIndex": f"{side}only", "action_taken": action, "block": "other"} for side, action in (("S", 1.0), ("P", 6.0))]
    loans = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], random_loans(spark, 5, 1).schema)
    counts = []

    def written(df):
        found = session.cut_lineage(df)
        counts.append(found.count())
        return found

    monkeypatch.setattr(post2018, "cut_lineage", written)
    crosswalk = spark.createDataFrame([], "HMDAIndex_s string, HMDAIndex_p string")
    assert ids(post2018.link(number, loans, crosswalk)) == [("Sonly", "Ponly")]
    assert max(counts) <= len(rows)


@pytest.mark.parametrize("most", [1, 2])
def test_marked_pairs_settle_like_written_pairs(spark, most):
    """Contest and uniqueness by marks on the records, against the same on the pairs, also for records without an id."""
    chance = random.Random(most)
    name = lambda side: chance.choice([None, *[f"{side}{n}" for n in range(25)]])
    rows = [("b", name("s"), name("p"), chance.choice([None, 0.0, 0.005, 0.02, 0.05]), chance.random() < 0.5) for _ in range(45)]
    pairs = spark.createDataFrame(rows, "block string, HMDAIndex_s string, HMDAIndex_p string, gap double, secondary boolean").cache()
    stands, wins = pf.closest_rule(F.col("gap"), 0.01)
    secondary = None if most == 1 else F.col("secondary")
    left = rivals.contest(pairs, stands, wins)
    wanted = uniqueness.unique_pairs(left, most == 1, secondary)
    marks = session.cut_lineage(rivals.marks_of([pairs], "block", (stands, wins), F.lit(True), 0))
    flagged = pairs
    for side in ("s", "p"):
        own = marks.filter(F.col("side") == side).select(F.col("record").alias("r"), F.col("won_0").alias(f"won_{side}"), F.col("standing").alias(f"standing_{side}"))
        flagged = flagged.join(own, F.col(f"HMDAIndex_{side}").eqNullSafe(F.col("r"))).drop("r")
    few_s, few_p = F.col("standing_s") <= most, F.col("standing_p") <= 1
    kept = (stands & few_s & few_p) | (~stands & ~F.col("won_s") & ~F.col("won_p") & (few_s | few_p))
    rows = flagged.filter(kept).select("HMDAIndex_s", "HMDAIndex_p", "secondary", "standing_s", "standing_p", (~stands).alias("weak"))
    assert wanted.count() > 0
    assert ids(rivals.up_to_marked(most, rows, secondary)) == ids(wanted)
