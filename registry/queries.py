"""The registered queries: every operator and plan on the derived loans.

Tables that many queries share are written once per session and input
folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.functions import people
from loanweave.operators import candidates, cleaning, uniqueness
from loanweave.operators import pair_filters as pf
from loanweave.operators.candidates import Blocking, LoanLayout
from loanweave.plans import post2018, pre2018, relations
from loanweave.plans.runs import Post2018Run
from loanweave.reports import counterparties, statistics, unmatched
from loanweave.session import cut_lineage, scratch_folder, tune
from loanweave.sources import deliveries, results
from registry.loans import raw_loans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SHARED: dict[tuple[str, str, str], object] = {}

SAME_PURPOSE = list(post2018.SAME_PURPOSE)
IDS = ["HMDAIndex_s", "HMDAIndex_p"]
# The derived loans are few, so lender pairs count as frequent early.
AFFILIATE_THRESHOLDS = {"min_share": 0.5, "min_links": 2}
TYPE_THRESHOLDS = {"min_share": 0.5, "min_links": 2}


class Inputs:
    """Tables derived from one input folder, each computed on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir

    def shared(self, name: str, build: Callable[[], object]):
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _SHARED:
            _SHARED[key] = build()
        return _SHARED[key]

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return self.shared(name, lambda: cut_lineage(build()))

    @property
    def raw(self) -> DataFrame:
        return self.written("raw", lambda: raw_loans(self.spark, self.sf_dir))

    @property
    def linkable(self) -> DataFrame:
        return deliveries.may_be_sold(self.raw)

    @property
    def clean(self) -> DataFrame:
        return self.written("clean", lambda: cleaning.null_sentinels(cleaning.convert_numerics(self.linkable)))

    @property
    def usable(self) -> DataFrame:
        return cleaning.require_keys(self.clean, SAME_PURPOSE, ("", "NA"))

    def written(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table that is read column by column and several times."""

        def write() -> str:
            path = scratch_folder(self.spark, name)
            build().write.parquet(path)
            return path

        return self.spark.read.parquet(self.shared(f"written {name}", write))

    def joined(self) -> DataFrame:
        """Candidate pairs; a loan takes what the rules on borrowers need into the join."""
        return self.joined_of(*candidates.split_sides(self.usable.withColumns(people.trait_bits(people.TRAITS))))

    def joined_of(self, sellers: DataFrame, purchasers: DataFrame) -> DataFrame:
        """Candidate pairs; the shared keys are given to both sides."""
        joined = candidates.block_join(sellers, purchasers, Blocking(tuple(SAME_PURPOSE)))
        return joined.withColumns({f"{k}_{side}": F.col(k) for k in SAME_PURPOSE for side in ("s", "p")})

    @property
    def pairs(self) -> DataFrame:
        """Candidate pairs, formed anew by each query from the columns it reads: they are too many to be written."""
        return self.joined()

    @property
    def close_pairs(self) -> DataFrame:
        return pf.numeric_matches(self.pairs, post2018.INCOME_AND_RATE)

    def close_pairs_of(self, sellers: DataFrame, purchasers: DataFrame) -> DataFrame:
        return pf.numeric_matches(self.joined_of(sellers, purchasers), post2018.INCOME_AND_RATE)

    @property
    def prepared(self) -> DataFrame:
        return self.table("prepared", lambda: post2018.prepare(self.linkable))

    @property
    def layout(self) -> LoanLayout:
        """The prepared loans as a run lays them out."""
        def build() -> LoanLayout:
            found = post2018.lay_out(self.prepared)
            buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            calm = self.result_folder.write_bucketed("check", found.calm, found.keys, buckets)
            return LoanLayout(calm, found.crowded, found.keys)

        return self.shared("layout", build)

    def links(self, number: int) -> DataFrame:
        spec = post2018.ROUNDS[number]

        def build() -> DataFrame:
            return post2018.link(
                spec,
                self.layout,
                self.crosswalk(spec.previous) if spec.previous else None,
                self.affiliates if spec.needs_affiliates else None,
                self.types if spec.needs_types else None,
            )

        return self.table(f"links{number}", build)

    def crosswalk(self, number: int) -> DataFrame:
        """Links of all rounds up to this one."""
        crosswalk = None
        for n in range(1, number + 1):
            crosswalk = results.append_crosswalk(self.links(n), n, crosswalk)
        return crosswalk

    def matched(self, number: int = 5) -> DataFrame:
        return self.table(f"matched{number}", lambda: relations.matched_loans(self.raw, self.crosswalk(number)))

    def linked_lenders(self, number: int = 5) -> DataFrame:
        """`matched` with the columns that relationships are read from, as a run reads them."""
        loans = self.raw.select(*relations.RELATION_COLUMNS, "action_taken")
        return self.table(f"lenders{number}", lambda: relations.matched_loans(loans, self.crosswalk(number)))

    @property
    def lender_names(self) -> DataFrame:
        """Most lenders, some under two spellings."""
        leis = self.raw.select("lei").dropDuplicates().filter("lei <> 'L3'")
        name = F.concat(F.lit("Bank "), "lei")
        names = leis.select("lei", name.alias("respondent_name_panel"), name.alias("respondent_name_ts"))
        return names.unionByName(names.withColumn("respondent_name_ts", F.lower("respondent_name_ts")))

    @property
    def affiliates(self) -> DataFrame:
        names = deliveries.upper_lender_names(self.lender_names)
        return self.written("affiliates", lambda: relations.affiliates(self.linked_lenders(), names, **AFFILIATE_THRESHOLDS))

    @property
    def types(self) -> DataFrame:
        return self.written("types", lambda: relations.typed_relationships(self.linked_lenders(), **TYPE_THRESHOLDS))

    @property
    def legacy(self) -> DataFrame:
        """The derived loans in the 2007-2017 form."""
        renamed = self.raw.drop("loan_amount").withColumnsRenamed(
            {
                "loan_amount_thousands": "loan_amount",
                "applicant_ethnicity_1": "applicant_ethnicity",
                "co_applicant_ethnicity_1": "co_applicant_ethnicity",
            }
        )
        income = F.when(F.col("income") == "Exempt", 9999.0).otherwise(F.col("income").try_cast("double"))
        return renamed.withColumn("income", income)

    @property
    def legacy_prepared(self) -> DataFrame:
        return self.table("legacy", lambda: pre2018.prepare(deliveries.may_be_sold(self.legacy)))

    @property
    def legacy_usable(self) -> DataFrame:
        return cleaning.require_keys(
            cleaning.null_income_9999(deliveries.may_be_sold(self.legacy), ["income"]), pre2018.EXACT_KEYS, ("",)
        )

    @property
    def legacy_pairs(self) -> DataFrame:
        keys = pre2018.EXACT_KEYS
        usable = self.legacy_usable.withColumns(people.trait_bits(people.TRAITS_PRE2018))
        pairs = candidates.block_join(*candidates.split_sides(usable), Blocking(keys))
        return pairs.withColumns({f"{k}_{side}": F.col(k) for k in keys for side in ("s", "p")})

    def legacy_crosswalk(self, number: int) -> DataFrame:
        first = self.table("legacy1", lambda: pre2018.crosswalk_round1(self.legacy_prepared))
        if number == 1:
            return first
        return self.table("legacy2", lambda: pre2018.crosswalk_round2(self.legacy_prepared, first))

    # --- files ---------------------------------------------------------------
    @property
    def year_range(self) -> tuple[int, int]:
        def bounds():
            row = self.raw.agg(F.min("activity_year").alias("a"), F.max("activity_year").alias("b")).first()
            return (row.a, row.b)

        return self.shared("years", bounds)

    @property
    def delivery_folder(self) -> str:
        """A folder with one delivery per year and a manifest that also lists others."""

        def write() -> str:
            folder = scratch_folder(self.spark, "deliveries")
            named = self.raw.withColumns({"delivery": F.col("activity_year"), "file": F.lit("lar.parquet")})
            named.write.partitionBy("delivery", "file").parquet(folder)
            years = self.raw.select(F.col("activity_year").alias("Year")).dropDuplicates()
            folder_of = F.concat(F.lit("delivery="), F.col("Year").cast("string"))
            kinds = [("lar", 1, "final"), ("LAR", 1, "snapshot"), ("lar", 0, "draft"), ("ts", 1, "final")]
            lines = None
            for order, (kind, has_parquet, version) in enumerate(kinds):
                line = years.select(
                    F.lit(kind).alias("FileType"), "Year", F.lit(has_parquet).alias("FileParquet"),
                    F.lit(0).alias("FileCSVGZ"), F.lit(0).alias("FileDTA"), F.lit(version).alias("VersionType"),
                    folder_of.alias("FolderName"),
                    F.lit("file=lar" if order == 0 else f"file={version}").alias("FilePrefix"),
                    F.lit(order).alias("line_order"),
                )
                lines = line if lines is None else lines.unionByName(line)
            manifest = lines.orderBy(F.desc("Year"), "line_order").drop("line_order").coalesce(1)
            manifest.write.csv(f"{folder}/{deliveries.MANIFEST_FILE}", header=True)
            return folder

        return self.shared("deliveries", write)

    @property
    def legacy_folder(self) -> str:
        def write() -> str:
            folder = scratch_folder(self.spark, "legacy")
            named = self.legacy.withColumn("file", F.concat(F.lit("lar_"), F.col("activity_year").cast("string"), F.lit(".parquet")))
            named.write.partitionBy("file").parquet(folder)
            return folder

        return self.shared("legacy_folder", write)

    @property
    def result_folder(self) -> results.ResultFolder:
        folder = self.shared("results", lambda: scratch_folder(self.spark, "results"))
        return results.ResultFolder(self.spark, folder, "_check")


def query(function: Callable[[Inputs], DataFrame]):
    """Register a query under the function's name."""
    QUERIES[function.__name__] = lambda spark, sf_dir: function(Inputs(spark, sf_dir))
    return function


def _ids(pairs: DataFrame, *more: str) -> DataFrame:
    return pairs.select(*IDS, *more)


# --- sources and sinks --------------------------------------------------------
@query
def resolve_deliveries(t: Inputs) -> DataFrame:
    found = deliveries.resolve_deliveries(t.spark, t.delivery_folder, "LAR", *t.year_range, extension="parquet")
    return found.select("Year", F.replace("path", F.lit(t.delivery_folder + "/"), F.lit("")).alias("path"))


@query
def load_deliveries(t: Inputs) -> DataFrame:
    return deliveries.load_deliveries(
        t.spark, t.delivery_folder, "lar", *t.year_range,
        columns=["HMDAIndex", "activity_year", "lei"],
        filters=[[("action_taken", "==", 6), ("purchaser_type", "in", [0, 1])], [("loan_type", ">", 3)]],
    )


@query
def match_columns(t: Inputs) -> DataFrame:
    wide = t.raw.withColumns({"aus_1": F.lit(1), "derived_race": F.lit("x"), "tract_population": F.lit(5)})
    return cleaning.linkage_columns(wide).select("HMDAIndex", "income", "lei")


@query
def load_linkage_input(t: Inputs) -> DataFrame:
    loans = deliveries.load_linkage_input(t.spark, t.delivery_folder, *t.year_range, [("loan_type", "in", [1, 2])])
    return loans.select("HMDAIndex", "activity_year", "action_taken", "purchaser_type", "income")


@query
def load_linkage_input_pre2018(t: Inputs) -> DataFrame:
    loans = deliveries.load_linkage_input_pre2018(t.spark, t.legacy_folder, *t.year_range)
    return loans.select("HMDAIndex", "respondent_id", "activity_year", "loan_amount", "income")


@query
def filter_from_tuples(t: Inputs) -> DataFrame:
    test = deliveries.filter_from_tuples(
        [("purchaser_type", "!=", 6), ("loan_type", "not in", [2, 3]), ("loan_amount", ">=", 50000), ("loan_amount", "<", 300000)]
    )
    return t.clean.filter(test).select("HMDAIndex", "loan_type", "loan_amount")


@query
def append_crosswalk(t: Inputs) -> DataFrame:
    t.result_folder.write_crosswalk(t.links(1), 1)
    return t.result_folder.write_crosswalk(t.links(2), 2)


@query
def append_crosswalk_csv(t: Inputs) -> DataFrame:
    t.result_folder.write_crosswalk_csv(t.links(1), 1)
    return t.result_folder.write_crosswalk_csv(t.links(2), 2)


@query
def write_crosswalk_pre2018(t: Inputs) -> DataFrame:
    return t.result_folder.write_pre2018_crosswalk(t.legacy_crosswalk(1), 1)


@query
def read_lender_names(t: Inputs) -> DataFrame:
    path = f"{scratch_folder(t.spark, 'lenders')}.csv"
    t.lender_names.write.csv(path, sep="|", header=True)
    return deliveries.read_lender_names(t.spark, path)


@query
def affiliates_sink(t: Inputs) -> DataFrame:
    found = relations.affiliate_candidates(t.linked_lenders(), **AFFILIATE_THRESHOLDS)
    return t.result_folder.write_affiliates(found, 5)


@query
def typed_relationships_sink(t: Inputs) -> DataFrame:
    return t.result_folder.write_typed_relationships(t.types, 5)


@query
def large_relationships_sink(t: Inputs) -> DataFrame:
    return t.result_folder.write_large_relationships(relations.large_relationships(t.linked_lenders(), min_links=100), 5)


@query
def matched_loans_sink(t: Inputs) -> DataFrame:
    return t.result_folder.write_matched_loans(t.matched(), 5).select(*IDS, "match_round", "lei_s", "lei_p")


# --- cleaning -----------------------------------------------------------------
_CONVERTED = [
    "income", "interest_rate", "loan_term", "intro_rate_period", "property_value", "total_units", *schema.FEE_COLUMNS,
    "applicant_age", "co_applicant_age", "applicant_age_above_62", "co_applicant_age_above_62",
    "debt_to_income_ratio", "conforming_loan_limit",
]


@query
def convert_numerics(t: Inputs) -> DataFrame:
    return cleaning.convert_numerics(t.raw).select("HMDAIndex", *_CONVERTED)


@query
def fee_exemption_flags(t: Inputs) -> DataFrame:
    flagged = cleaning.fee_exemption_flags(cleaning.convert_numerics(t.raw))
    return flagged.select("HMDAIndex", "i_ExemptFromFeesStrict", "i_ExemptFromFeesWeak")


_SENTINEL_CHECKED = [
    "conforming_loan_limit", "construction_method", "income", "total_units", "lien_status", *schema.FEE_COLUMNS,
    "interest_rate", "intro_rate_period", "loan_term", "property_value", "open_end_line_of_credit",
]


@query
def null_sentinels(t: Inputs) -> DataFrame:
    return cleaning.null_sentinels(cleaning.convert_numerics(t.raw)).select("HMDAIndex", *_SENTINEL_CHECKED)


@query
def null_sentinels_pre2018(t: Inputs) -> DataFrame:
    converted = cleaning.convert_numerics(t.raw)
    return cleaning.null_sentinels_pre2018(converted).select(
        "HMDAIndex", "conforming_loan_limit", "income", "discount_points", "lender_credits", "interest_rate"
    )


@query
def null_income_9999(t: Inputs) -> DataFrame:
    return cleaning.null_income_9999(t.legacy, ["income"]).select("HMDAIndex", "income")


@query
def drop_nonmatch_columns(t: Inputs) -> DataFrame:
    wide = t.raw.select("HMDAIndex", "lien_status", F.lit(1).alias("aus_2"), F.lit(2).alias("denial_reason"))
    return cleaning.drop_nonmatch_columns(wide)


@query
def drop_nonmatch_columns_pre2018(t: Inputs) -> DataFrame:
    wide = t.raw.select("HMDAIndex", "property_type", "lien_status", F.lit(1).alias("hoepa_status"))
    return cleaning.drop_nonmatch_columns(wide, pre2018_round=True)


@query
def require_keys(t: Inputs) -> DataFrame:
    return cleaning.require_keys(t.clean, SAME_PURPOSE, ("", "NA")).select("HMDAIndex", "census_tract")


@query
def require_keys_blank_tract(t: Inputs) -> DataFrame:
    return cleaning.require_keys(t.clean, SAME_PURPOSE, ("",)).select("HMDAIndex", "census_tract")


@query
def require_keys_county(t: Inputs) -> DataFrame:
    keys = ["loan_type", "loan_amount", "county_code", "occupancy_type"]
    return cleaning.require_keys(t.clean, keys).select("HMDAIndex", "census_tract")


@query
def purchase_purpose_flag(t: Inputs) -> DataFrame:
    return cleaning.purchase_purpose_flag(t.clean).select("HMDAIndex", "i_Purchase")


@query
def loan_amount_bin(t: Inputs) -> DataFrame:
    return cleaning.loan_amount_bin(t.legacy).select("HMDAIndex", "LoanAmountBin")


@query
def suffix_columns(t: Inputs) -> DataFrame:
    return cleaning.suffix_columns(t.clean.select("HMDAIndex", "lei", "loan_type"), "_s", ["loan_type"])


@query
def income_unit_features(t: Inputs) -> DataFrame:
    featured = cleaning.income_unit_features(t.pairs, keep=True)
    return _ids(featured, "income_fix_s", "income_fix_p", "income_diff", "income_diff_fix_1", "income_diff_fix_2")


@query
def product_label(t: Inputs) -> DataFrame:
    return cleaning.product_label(t.raw).select("HMDAIndex", "product")


@query
def rural_flag(t: Inputs) -> DataFrame:
    return cleaning.rural_flag(t.raw).select("HMDAIndex", "is_rural_county")


# --- candidate pairs ----------------------------------------------------------
@query
def keep_potential_matches(t: Inputs) -> DataFrame:
    return candidates.keep_potential_matches(t.clean, SAME_PURPOSE).select("HMDAIndex", "action_taken")


@query
def split_sides(t: Inputs) -> DataFrame:
    sellers, purchasers = candidates.split_sides(t.clean, t.crosswalk(1))
    return sellers.select("HMDAIndex", F.lit("s").alias("side")).unionByName(
        purchasers.select("HMDAIndex", F.lit("p").alias("side"))
    )


@query
def anti_matched_composite(t: Inputs) -> DataFrame:
    return candidates.anti_matched_composite(t.legacy_prepared, t.legacy_crosswalk(1)).select("HMDAIndex")


@query
def block_join(t: Inputs) -> DataFrame:
    return _ids(t.joined())


@query
def block_join_crowded(t: Inputs) -> DataFrame:
    """The same pairs as `block_join` within a rate tolerance, with every block
    of more than twenty pairs treated as crowded."""
    blocking = Blocking(tuple(SAME_PURPOSE), bands={"interest_rate": 0.0625}, max_block_pairs=20)
    pairs = candidates.blocked_pairs(*candidates.split_sides(t.usable), blocking)
    return _ids(pf.numeric_matches(pairs, {"interest_rate": 0.0625}))


@query
def band_join_amount(t: Inputs) -> DataFrame:
    keys = ["loan_type", "census_tract", "occupancy_type", "loan_purpose"]
    return _ids(candidates.band_join_amount(*candidates.split_sides(t.usable), keys))


@query
def bin_overlap_join(t: Inputs) -> DataFrame:
    keys = ["loan_type", "census_tract", "occupancy_type", "loan_purpose", "activity_year"]
    return _ids(candidates.bin_overlap_join(*candidates.split_sides(t.legacy_usable), keys))


@query
def affiliate_restrict(t: Inputs) -> DataFrame:
    return _ids(candidates.affiliate_restrict(t.pairs, t.affiliates), "lei_s", "lei_p")


@query
def purchaser_type_check(t: Inputs) -> DataFrame:
    return _ids(candidates.purchaser_type_check(t.pairs, t.types))


@query
def year_window(t: Inputs) -> DataFrame:
    return _ids(candidates.year_window(t.pairs))


@query
def year_window_one_year(t: Inputs) -> DataFrame:
    return _ids(candidates.year_window(t.pairs, max_gap=1))


@query
def different_lenders(t: Inputs) -> DataFrame:
    return _ids(candidates.different_lenders(t.legacy_pairs))


@query
def matched_loans(t: Inputs) -> DataFrame:
    return relations.matched_loans(t.raw, t.crosswalk(2)).select(
        *IDS, "match_round", "activity_year_s", "activity_year_p", "income_s", "income_p", "lei_s", "lei_p"
    )


@query
def attach_names(t: Inputs) -> DataFrame:
    config = counterparties.CounterpartyConfig(include_names=True)
    counts = counterparties.pair_counts(_named_matches(t), config)
    return counterparties.attach_names(counts, _named_matches(t), config)


# --- filters on pairs ---------------------------------------------------------
@query
def numeric_matches(t: Inputs) -> DataFrame:
    return _ids(pf.numeric_matches(t.pairs, post2018.FULL_TOLERANCES))


@query
def numeric_matches_with_differences(t: Inputs) -> DataFrame:
    kept = pf.numeric_matches(t.pairs, {"income": 1, "loan_term": 12}, drop_differences=False)
    return _ids(kept, "income_difference", "loan_term_difference")


@query
def weak_numeric_matches(t: Inputs) -> DataFrame:
    return _ids(pf.weak_numeric_matches(t.pairs, {"interest_rate": 0.01}))


@query
def weak_numeric_matches_two_columns(t: Inputs) -> DataFrame:
    return _ids(pf.weak_numeric_matches(t.pairs, {"interest_rate": 0.01, "income": 1}))


@query
def numeric_matches_post_unique(t: Inputs) -> DataFrame:
    return _ids(pf.numeric_matches_post_unique(t.close_pairs, post2018.AFTER_UNIQUE))


@query
def fee_match_counts(t: Inputs) -> DataFrame:
    counted = pf.fee_match_counts(t.pairs)
    return _ids(counted, "NumberFeeMatches", "NumberNonmissingFees_s", "NumberNonmissingFees_p", "i_GenerousFeeMatch")


@query
def fee_filter_strict(t: Inputs) -> DataFrame:
    return _ids(pf.fee_filter_strict(t.pairs))


@query
def fee_filter_generous(t: Inputs) -> DataFrame:
    return _ids(pf.fee_filter_generous(t.pairs))


@query
def fee_dominance(t: Inputs) -> DataFrame:
    return _ids(pf.fee_dominance(pf.fee_match_counts(t.pairs)))


@query
def income_dominance(t: Inputs) -> DataFrame:
    return _ids(pf.income_dominance(t.pairs))


@query
def rate_dominance(t: Inputs) -> DataFrame:
    return _ids(pf.rate_dominance(t.pairs))


@query
def seller_cleanup(t: Inputs) -> DataFrame:
    return _ids(pf.seller_cleanup(t.close_pairs))


@query
def match_sex(t: Inputs) -> DataFrame:
    return _ids(pf.match_sex(t.pairs))


@query
def match_sex_pre2018(t: Inputs) -> DataFrame:
    return _ids(pf.match_sex_pre2018(t.legacy_pairs))


@query
def match_age(t: Inputs) -> DataFrame:
    return _ids(pf.match_age(t.pairs))


_RACE_OUT = ["applicant_race_1_s", "applicant_race_1_p"]


@query
def match_race(t: Inputs) -> DataFrame:
    return _ids(pf.match_race(t.pairs), *_RACE_OUT)


@query
def match_race_strict(t: Inputs) -> DataFrame:
    return _ids(pf.match_race(t.pairs, strict=True), *_RACE_OUT)


@query
def match_race_pre2018(t: Inputs) -> DataFrame:
    return _ids(pf.match_race_pre2018(t.legacy_pairs))


@query
def match_ethnicity(t: Inputs) -> DataFrame:
    return _ids(pf.match_ethnicity(t.pairs), "applicant_ethnicity_1_s")


@query
def match_ethnicity_strict(t: Inputs) -> DataFrame:
    return _ids(pf.match_ethnicity(t.pairs, strict=True), "applicant_ethnicity_1_s")


@query
def match_ethnicity_pre2018(t: Inputs) -> DataFrame:
    return _ids(pf.match_ethnicity_pre2018(t.legacy_pairs))


def _purchase_flag_pairs(t: Inputs) -> DataFrame:
    keys = post2018.SAME_PURCHASE_FLAG
    flagged = cleaning.require_keys(cleaning.purchase_purpose_flag(t.clean), keys, ("", "NA"))
    return candidates.block_join(*candidates.split_sides(flagged), Blocking(keys))


@query
def purpose_compat_either(t: Inputs) -> DataFrame:
    return _ids(pf.purpose_compat(_purchase_flag_pairs(t), "either"))


@query
def purpose_compat_both(t: Inputs) -> DataFrame:
    return _ids(pf.purpose_compat(_purchase_flag_pairs(t), "both"))


@query
def affiliate_sales(t: Inputs) -> DataFrame:
    return pf.affiliate_sales(t.clean).select("HMDAIndex")


@query
def known_sales(t: Inputs) -> DataFrame:
    return pf.known_sales(t.clean).select("HMDAIndex")


@query
def primary_purchases(t: Inputs) -> DataFrame:
    return _ids(pf.primary_purchases(t.pairs))


@query
def sold_to_primary_pre2018(t: Inputs) -> DataFrame:
    return _ids(pf.sold_to_primary_pre2018(t.legacy_pairs))


@query
def amount_direction(t: Inputs) -> DataFrame:
    keys = ["loan_type", "census_tract", "occupancy_type", "loan_purpose"]
    return _ids(pf.amount_direction(candidates.band_join_amount(*candidates.split_sides(t.usable), keys)))


@query
def amount_direction_pre2018(t: Inputs) -> DataFrame:
    keys = ["loan_type", "census_tract", "occupancy_type", "loan_purpose", "activity_year"]
    pairs = candidates.bin_overlap_join(*candidates.split_sides(t.legacy_usable), keys)
    return _ids(pf.amount_direction_pre2018(pairs))


@query
def income_band_pre2018(t: Inputs) -> DataFrame:
    return _ids(pf.income_band_pre2018(t.legacy_pairs, 5))


@query
def property_type_equal(t: Inputs) -> DataFrame:
    return _ids(pf.property_type_equal(t.pairs))


@query
def year_type_consistency(t: Inputs) -> DataFrame:
    return _ids(pf.year_type_consistency(t.legacy_pairs))


# --- uniqueness ---------------------------------------------------------------
@query
def keep_uniques(t: Inputs) -> DataFrame:
    return _ids(uniqueness.keep_uniques(t.close_pairs))


@query
def keep_uniques_secondary(t: Inputs) -> DataFrame:
    return _ids(uniqueness.keep_uniques(t.close_pairs, one_to_one=False))


@query
def keep_uniques_pre2018(t: Inputs) -> DataFrame:
    return _ids(uniqueness.keep_uniques_pre2018(pf.income_band_pre2018(t.legacy_pairs, 5)))


@query
def keep_uniques_pre2018_secondary(t: Inputs) -> DataFrame:
    return _ids(uniqueness.keep_uniques_pre2018(pf.income_band_pre2018(t.legacy_pairs, 5), one_to_one=False))


@query
def match_cardinality(t: Inputs) -> DataFrame:
    return uniqueness.match_cardinality(t.close_pairs, formed=(*candidates.split_sides(t.usable), t.close_pairs_of))


@query
def filter_attrition(t: Inputs) -> DataFrame:
    return uniqueness.filter_attrition(t.pairs, post2018.FULL_TOLERANCES)


@query
def crosswalk_by_round(t: Inputs) -> DataFrame:
    return uniqueness.crosswalk_by_round(t.crosswalk(5))


# --- reports ------------------------------------------------------------------
def _originations(t: Inputs) -> DataFrame:
    return t.raw.filter("action_taken = 1").withColumn("origination_id", F.col("HMDAIndex"))


def _purchases(t: Inputs) -> DataFrame:
    return t.raw.filter("action_taken = 6").withColumn("purchase_id", F.col("HMDAIndex"))


def _scored(t: Inputs) -> DataFrame:
    score = (F.col("sequence_number_p") * 37 % 100).cast("double") / 100
    return t.close_pairs.select(
        *IDS, F.col("HMDAIndex_s").alias("origination_id"), F.col("HMDAIndex_p").alias("purchase_id"), score.alias("match_score")
    )


def _report(t: Inputs) -> dict[str, DataFrame]:
    return t.shared("rates", lambda: statistics.global_match_rates(_originations(t), _purchases(t), _scored(t)))


@query
def unique_links(t: Inputs) -> DataFrame:
    return statistics.unique_links(_scored(t)).select("origination_id", "purchase_id", "match_score")


@query
def unique_links_unscored(t: Inputs) -> DataFrame:
    return statistics.unique_links(_scored(t), keep_top_purchase=False).select("origination_id", "purchase_id")


@query
def unique_matches(t: Inputs) -> DataFrame:
    return _ids(unmatched.unique_matches(_scored(t)))


@query
def origination_attrs_join(t: Inputs) -> DataFrame:
    links = statistics.unique_links(_scored(t))
    return statistics.enriched_links(links, _originations(t), _purchases(t))


@query
def overall_match_rates(t: Inputs) -> DataFrame:
    return _report(t)["overall"]


@query
def match_rate_by_year(t: Inputs) -> DataFrame:
    return _report(t)["by_year"]


@query
def match_rate_by_lei(t: Inputs) -> DataFrame:
    return _report(t)["by_lei"]


@query
def match_rate_by_loan_type(t: Inputs) -> DataFrame:
    return _report(t)["by_loan_type"]


@query
def match_rate_by_purchaser_type(t: Inputs) -> DataFrame:
    return _report(t)["by_purchaser_type"]


@query
def match_rate_by_year_lei(t: Inputs) -> DataFrame:
    return _report(t)["by_year_lei"]


_NUMERIC = ["loan_amount", "property_value"]


def _profile(t: Inputs) -> dict[str, DataFrame]:
    originations = _originations(t).drop("origination_id")
    return t.shared("profile", lambda: unmatched.profile_unmatched_originations(originations, t.crosswalk(2), _NUMERIC))


def _purchase_profile(t: Inputs) -> dict[str, DataFrame]:
    named = _purchases(t).withColumn("respondent_name", F.concat(F.lit("Bank "), "lei"))
    return t.shared("purchase_profile", lambda: unmatched.profile_unmatched_purchases(named, t.crosswalk(2), top_n=7))


@query
def unmatched_originations(t: Inputs) -> DataFrame:
    return _profile(t)["unmatched_originations"]


@query
def unmatched_overall(t: Inputs) -> DataFrame:
    return _profile(t)["summary_unmatched_overall"]


@query
def unmatched_by_year(t: Inputs) -> DataFrame:
    return _profile(t)["summary_unmatched_by_year"]


@query
def unmatched_mix_product(t: Inputs) -> DataFrame:
    return _profile(t)["dist_product_unmatched"]


@query
def unmatched_mix_rural(t: Inputs) -> DataFrame:
    return _profile(t)["dist_rural_unmatched"]


@query
def compare_numeric(t: Inputs) -> DataFrame:
    table = _profile(t)["compare_numeric_matched_vs_unmatched"]
    return table.withColumn("std_mean_diff", F.round("std_mean_diff", 9))


@query
def mix_outer_join(t: Inputs) -> DataFrame:
    return _profile(t)["compare_mix_rural"]


@query
def compare_mix(t: Inputs) -> DataFrame:
    return _profile(t)["compare_mix_product"]


@query
def unmatched_purchases(t: Inputs) -> DataFrame:
    return _purchase_profile(t)["unmatched_purchases"]


@query
def unmatched_purchases_by_year(t: Inputs) -> DataFrame:
    return _purchase_profile(t)["summary_unmatched_purchases_by_year"]


@query
def unmatched_purchases_top_inst(t: Inputs) -> DataFrame:
    return _purchase_profile(t)["unmatched_purchases_by_inst_top"]


@query
def unmatched_purchases_by_type(t: Inputs) -> DataFrame:
    return _purchase_profile(t)["unmatched_purchases_by_type"]


def _named_matches(t: Inputs) -> DataFrame:
    """Close pairs with lender names; one lender goes by two."""
    def name(side: str):
        spelled = F.when(F.col(f"lei_{side}") != "L7", "Bank ").when(F.col(f"loan_type_{side}") > 2, "Bank ").otherwise("bank ")
        return F.concat(spelled, f"lei_{side}").alias(f"respondent_name_{side}")

    return t.close_pairs.select("lei_s", "lei_p", name("s"), name("p"))


@query
def top_counterparties_by_seller(t: Inputs) -> DataFrame:
    return counterparties.top_counterparties_by_seller(t.close_pairs)


@query
def top_counterparties_by_purchaser(t: Inputs) -> DataFrame:
    return counterparties.top_counterparties_by_purchaser(t.close_pairs)


@query
def top_counterparties_named(t: Inputs) -> DataFrame:
    config = counterparties.CounterpartyConfig(top_n=3, include_names=True)
    return counterparties.summarize_top_counterparties(_named_matches(t), config)[0]


@query
def top_counterparties_named_by_purchaser(t: Inputs) -> DataFrame:
    config = counterparties.CounterpartyConfig(top_n=3, include_names=True)
    return counterparties.summarize_top_counterparties(_named_matches(t), config)[1]


# --- relationships ------------------------------------------------------------
@query
def single_sale_links(t: Inputs) -> DataFrame:
    return _ids(relations.single_sale_links(t.linked_lenders()))


@query
def affiliates(t: Inputs) -> DataFrame:
    return t.affiliates


@query
def typed_relationships(t: Inputs) -> DataFrame:
    return t.types


@query
def large_relationships(t: Inputs) -> DataFrame:
    return relations.large_relationships(t.linked_lenders(), min_links=100)


@query
def affiliates_published(t: Inputs) -> DataFrame:
    """With the thresholds that a run uses unless told otherwise."""
    return relations.affiliate_candidates(t.linked_lenders())


@query
def typed_relationships_published(t: Inputs) -> DataFrame:
    return relations.typed_relationships(t.linked_lenders())


@query
def large_relationships_published(t: Inputs) -> DataFrame:
    return relations.large_relationships(t.linked_lenders())


# --- rounds -------------------------------------------------------------------
def _register_round(number: int) -> None:
    def run(t: Inputs) -> DataFrame:
        return t.links(number).withColumn("match_round", F.lit(number))

    run.__name__ = f"post_r{number}"
    query(run)


for _number in post2018.ROUNDS:
    _register_round(_number)


@query
def post_r7_after_r2(t: Inputs) -> DataFrame:
    """Round 7 straight after round 2, where more loans are left for it."""
    return post2018.link(7, t.layout, t.crosswalk(2), types=t.types)


@query
def post_r1_crowded(t: Inputs) -> DataFrame:
    """Round 1 with every block of more than twenty pairs treated as crowded."""
    return post2018.link(1, t.prepared, max_block_pairs=20)


@query
def post_r3_crowded(t: Inputs) -> DataFrame:
    return post2018.link(3, t.prepared, t.crosswalk(2), max_block_pairs=20)


@query
def post_r5_crowded(t: Inputs) -> DataFrame:
    return post2018.link(5, t.prepared, t.crosswalk(4), max_block_pairs=20)


@query
def post_all(t: Inputs) -> DataFrame:
    """All rounds from files to files, as a user runs them."""
    names = f"{scratch_folder(t.spark, 'lenders')}.csv"
    t.lender_names.write.csv(names, sep="|", header=True)
    run = Post2018Run(
        t.spark, t.delivery_folder, scratch_folder(t.spark, "run"), *t.year_range, file_suffix="_check",
        lender_file=names, affiliate_thresholds=AFFILIATE_THRESHOLDS, type_thresholds=TYPE_THRESHOLDS,
    )
    return run.all_rounds()


@query
def pre_r1(t: Inputs) -> DataFrame:
    return t.legacy_crosswalk(1)


@query
def pre_r2(t: Inputs) -> DataFrame:
    return t.legacy_crosswalk(2)
