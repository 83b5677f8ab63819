from __future__ import annotations

import pytest
from rows import ids
from pyspark.sql import functions as F

from loanweave.operators import cleaning
from loanweave.plans import post2018, relations
from loanweave.plans.runs import Post2018Run, Pre2018Run
from loanweave.session import cut_lineage
from loanweave.sources import deliveries
from loanweave.sources.results import ResultFolder, append_crosswalk

MANIFEST = """FileType,Year,FileParquet,FileCSVGZ,FileDTA,VersionType,FolderName,FilePrefix
lar,2019,1,0,0,b,y19,late
LAR,2018,0,1,0,a,y18,text
lar,2018,1,1,0,a,y18,first
lar,2018,1,0,0,b,y18,second
ts,2018,1,0,0,a,y18,other
lar,x,1,0,0,a,bad,bad
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "file_list_hmda.csv").write_text(MANIFEST)
    return tmp_path


def paths(spark, folder, **selection):
    found = deliveries.delivery_paths(spark, str(folder), **selection)
    return [p.removeprefix(f"{folder}/") for p in found]


def test_manifest(spark, folder):
    assert paths(spark, folder, extension="parquet", min_year=1) == ["y18/first.parquet", "y19/late.parquet"]
    assert paths(spark, folder, extension="CSV.GZ", max_year=2018) == ["y18/text.CSV.GZ"]
    assert paths(spark, folder, min_year=2018) == ["y18/text", "y19/late"]
    assert paths(spark, folder, version_type="b", min_year=2018, extension="parquet") == ["y18/second.parquet", "y19/late.parquet"]
    assert paths(spark, folder, extension="dta") == [] and paths(spark, folder, file_type="TS") == ["y18/other"]
    with pytest.raises(ValueError):
        paths(spark, folder, extension="orc")


def test_loading_years_of_unlike_types(spark, folder):
    spark.sql("SELECT 'a' AS HMDAIndex, 1.0D AS action_taken, 0.0D AS purchaser_type, 'Exempt' AS income, 2018 AS activity_year, 'x' AS aus_1").write.parquet(f"{folder}/y18/first.parquet")
    spark.sql(
        "SELECT * FROM VALUES ('b', 6.0D, 2.0D, 55.0D, 7), ('c', 1.0D, 2.0D, 5.0D, 7), ('d', 1.0D, CAST(NULL AS DOUBLE), 6.0D, 7), ('e', 3.0D, 0.0D, 6.0D, 7) "
        "AS t(HMDAIndex, action_taken, purchaser_type, income, extra)"
    ).write.parquet(f"{folder}/y19/late.parquet")
    loans = deliveries.load_linkage_input(spark, str(folder), 2018, 2019)
    assert "aus_1" not in loans.columns
    converted = cleaning.convert_numerics(loans)
    assert ids(converted, "HMDAIndex", "income", "extra") == [("a", -99999.0, None), ("b", 55.0, 7), ("d", 6.0, 7)]
    every = deliveries.load_deliveries(spark, str(folder), "lar", 2018, 2019, ["HMDAIndex"], [("action_taken", "not in", [1])])
    assert ids(every, "HMDAIndex") == ["b", "e"]
    either = deliveries.load_deliveries(spark, str(folder), "lar", 2019, 2019, ["HMDAIndex"], [[("HMDAIndex", "==", "b")], [("income", "<", 6)]])
    assert ids(either, "HMDAIndex") == ["b", "c"]
    for function, years in ((deliveries.load_linkage_input, (2018, 2020)), (deliveries.load_linkage_input_pre2018, (2007, 2007))):
        with pytest.raises(FileNotFoundError):
            function(spark, str(folder), *years)
    with pytest.raises(FileNotFoundError):
        deliveries.load_deliveries(spark, str(folder), "none")


def test_filters_reach_the_scan(spark, folder, capsys):
    spark.range(3).select(F.col("id").cast("string").alias("HMDAIndex"), F.lit(1.0).alias("action_taken"), F.lit(0.0).alias("purchaser_type"), F.lit(1).alias("unneeded")).write.parquet(f"{folder}/y18/first.parquet")
    deliveries.load_linkage_input(spark, str(folder), 2018, 2018).select("HMDAIndex").explain()
    plan = capsys.readouterr().out
    assert "In(action_taken, [1.0,6.0])" in plan and "unneeded" not in plan.split("ReadSchema")[1]


@pytest.mark.parametrize(
    ("op", "value", "kept"),
    [("==", 2, [2]), ("!=", 2, [1, 3]), ("in", [1, 3], [1, 3]), ("not in", [1], [2, 3, None]), (">=", 2, [2, 3]), ("<=", 2, [1, 2]), (">", 2, [3]), ("<", 2, [1])],
)
def test_filter_operators(table, op, value, kept):
    df = table([{"x": v} for v in (1, 2, 3, None)], "x int")
    assert [r.x for r in df.filter(deliveries.filter_from_tuples([("x", op, value)])).collect()] == kept


def test_unknown_filter_operator():
    with pytest.raises(ValueError):
        deliveries.filter_from_tuples([("x", "~", 1)])


def test_crosswalk_files(spark, table, tmp_path):
    folder = ResultFolder(spark, tmp_path, None)
    links = table([{"HMDAIndex_s": "a", "HMDAIndex_p": "b", "more": 1}], "HMDAIndex_s string, HMDAIndex_p string, more int")
    folder.write_crosswalk(links, 1)
    assert ids(folder.write_crosswalk(links.withColumn("HMDAIndex_s", F.lit("c")), 2), "HMDAIndex_s", "match_round") == [("a", 1), ("c", 2)]
    assert (tmp_path / "hmda_seller_purchaser_matches_round2.parquet").exists()
    folder.write_crosswalk_csv(links, 1)
    written, wanted = folder.write_crosswalk_csv(links, 2), append_crosswalk(links, 2, append_crosswalk(links, 1))
    assert written.dtypes == wanted.dtypes and ids(written, *wanted.columns) == ids(wanted, *wanted.columns)


def test_lender_names(spark, tmp_path):
    (tmp_path / "names.csv").write_text("lei|respondent_name_panel|respondent_name_ts|other\nab|Bank|\nAB|bank||\ncd|x|y|z\n")
    names = deliveries.read_lender_names(spark, str(tmp_path / "names.csv"))
    assert ids(names, "lei", "respondent_name_ts") == [("AB", None), ("CD", "Y")]


@pytest.fixture(scope="module")
def derived(spark):
    from registry.queries import Inputs

    return Inputs(spark, "/root/testdata/sf0.001")


def test_post2018_run(spark, derived, tmp_path):
    """A run from files to files: the same links as the plans give, every link
    planted, no loan linked twice but for the sixth round's exception."""
    from registry.queries import AFFILIATE_THRESHOLDS, TYPE_THRESHOLDS

    names = str(tmp_path / "names.csv")
    derived.lender_names.write.csv(names, sep="|", header=True)
    run = Post2018Run(
        spark, derived.delivery_folder, str(tmp_path / "run"), *derived.year_range, file_suffix="_t", lender_file=names,
        max_block_pairs=4, affiliate_thresholds=AFFILIATE_THRESHOLDS, type_thresholds=TYPE_THRESHOLDS, buckets=4,
    )
    final = run.all_rounds().cache()
    assert run.prepared_loans().crowded is not None
    assert ids(final, "HMDAIndex_s", "HMDAIndex_p", "match_round") == ids(derived.crosswalk(8), "HMDAIndex_s", "HMDAIndex_p", "match_round")
    assert final.filter("substr(HMDAIndex_s, 2) <> substr(HMDAIndex_p, 2)").isEmpty()
    for number in range(2, 9):
        assert run.results.crosswalk(number - 1).exceptAll(run.results.crosswalk(number)).isEmpty()
    others = final.filter("match_round <> 6")
    for side in ("HMDAIndex_s", "HMDAIndex_p"):
        rounds = others.groupBy(side).agg(F.countDistinct("match_round").alias("rounds"))
        assert rounds.filter("rounds > 1").isEmpty()
    early = others.filter("match_round IN (1, 2, 5)")
    assert early.groupBy("HMDAIndex_s").count().filter("count > 1").isEmpty()
    matched = run.results.matched_loans(8)
    assert matched.columns[:3] == ["HMDAIndex_s", "HMDAIndex_p", "match_round"] and matched.columns[3:] == sorted(matched.columns[3:])
    assert matched.count() == final.count()
    assert run.large_relationships(8).count() == 0
    # Another object takes the run up without writing the loans again.
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet") if "prepared_loans" in str(p)}
    for table in spark.catalog.listTables():
        if table.name.startswith("prepared_loans_calm") and "_4_" in table.name:
            spark.sql(f"DROP TABLE {table.name}")
    again = Post2018Run(
        spark, derived.delivery_folder, str(tmp_path / "run"), *derived.year_range, file_suffix="_t", lender_file=names,
        max_block_pairs=4, affiliate_thresholds=AFFILIATE_THRESHOLDS, type_thresholds=TYPE_THRESHOLDS, buckets=4,
    )
    assert ids(again.round(4)) == ids(final.filter("match_round <= 4"))
    assert written and written == {p: p.stat().st_mtime_ns for p in (tmp_path / "run").rglob("*.parquet") if "prepared_loans" in str(p)}


def test_pre2018_run(spark, derived, tmp_path):
    run = Pre2018Run(spark, derived.legacy_folder, str(tmp_path), *derived.year_range)
    final = run.all_rounds()
    assert ids(final, "HMDAIndex_s", "HMDAIndex_p", "MatchRound") == ids(derived.legacy_crosswalk(2), "HMDAIndex_s", "HMDAIndex_p", "MatchRound")
    with pytest.raises(ValueError):
        run.round(3)


def test_rounds_do_not_move_bucketed_loans(spark, derived, capsys):
    """The join of a bucketed layout reads both sides without an exchange."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        post2018.candidate_facts(post2018.ROUNDS[3], derived.layout, derived.crosswalk(2)).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    plan = capsys.readouterr().out
    assert "hashpartitioning(HMDAIndex_s" in plan and "hashpartitioning(block" not in plan
    assert "people_needs" in plan and plan.count("Exchange") == 4


def test_hand_over_tables_are_column_files(spark):
    """Rows are written once, packed by column, and not as a checkpoint that runs what leads to them twice."""
    found = cut_lineage(spark.range(3).withColumn("text", F.lit("x")))
    assert found.count() == 3 and all(path.endswith(".parquet") for path in found.inputFiles()) and found.inputFiles()


def test_relationships_read_few_columns(derived):
    assert {c.rsplit("_", 1)[0] for c in derived.linked_lenders().columns} <= {*relations.RELATION_COLUMNS, "action_taken", "match"}
