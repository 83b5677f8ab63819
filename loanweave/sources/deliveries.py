"""Yearly register deliveries: the manifest, predicates and loaders."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanweave import schema
from loanweave.functions.logic import none_of
from loanweave.operators.cleaning import linkage_columns

FilterTuple = tuple[str, str, object]

MANIFEST_FILE = "file_list_hmda.csv"
EXTENSION_FLAGS = {"parquet": "FileParquet", "csv.gz": "FileCSVGZ", "dta": "FileDTA"}


def read_manifest(spark: SparkSession, data_folder: str) -> DataFrame:
    """The manifest with ``position``, the order of its lines."""
    lines = spark.read.csv(f"{data_folder}/{MANIFEST_FILE}", header=True)
    numbers = {c: F.col(c).try_cast("double").cast("int") for c in ("Year", *EXTENSION_FLAGS.values()) if c in lines.columns}
    return lines.withColumns(numbers).withColumn("position", F.monotonically_increasing_id())


def resolve_deliveries(
    spark: SparkSession,
    data_folder: str,
    file_type: str = "lar",
    min_year: int | None = None,
    max_year: int | None = None,
    version_type: str | None = None,
    extension: str | None = None,
) -> DataFrame:
    """``Year, path`` of the first listed delivery per year, in year order."""
    manifest = read_manifest(spark, data_folder).filter(F.lower("FileType") == file_type.lower())
    if min_year is not None:
        manifest = manifest.filter(F.col("Year") >= min_year)
    if max_year is not None:
        manifest = manifest.filter(F.col("Year") <= max_year)
    if extension is not None:
        if extension.lower() not in EXTENSION_FLAGS:
            raise ValueError(f"unsupported extension {extension!r}; expected one of: {', '.join(EXTENSION_FLAGS)}")
        manifest = manifest.filter(F.col(EXTENSION_FLAGS[extension.lower()]) == 1)
    if version_type is not None:
        manifest = manifest.filter(F.col("VersionType") == version_type)
    ending = "" if extension is None else f".{extension}"
    path = F.concat(F.lit(f"{data_folder}/"), "FolderName", F.lit("/"), "FilePrefix", F.lit(ending))
    listed = Window.partitionBy("Year").orderBy("position")
    first = manifest.withColumn("listed", F.row_number().over(listed)).filter("listed = 1")
    return first.select("Year", path.alias("path")).orderBy("Year")


def delivery_paths(spark: SparkSession, data_folder: str, **selection) -> list[str]:
    """The resolved paths. The manifest has one line per file, so this is a small list."""
    return [row.path for row in resolve_deliveries(spark, data_folder, **selection).collect()]


def tuple_predicate(column: str, op: str, value) -> Column:
    """A ``(column, op, value)`` filter. Missing values fail every test but ``not in``."""
    c = F.col(column)
    tests = {
        "==": lambda: c == value,
        "!=": lambda: c != value,
        "in": lambda: c.isin(list(value)),
        "not in": lambda: none_of(c, value),
        ">=": lambda: c >= value,
        "<=": lambda: c <= value,
        ">": lambda: c > value,
        "<": lambda: c < value,
    }
    if op not in tests:
        raise ValueError(f"unsupported filter operator {op!r}")
    return tests[op]()


def filter_from_tuples(filters: Sequence[FilterTuple] | Sequence[Sequence[FilterTuple]]) -> Column:
    """AND of tuples, or OR over lists of tuples."""
    if filters and isinstance(filters[0], tuple):
        filters = [filters]
    return reduce(or_, [reduce(and_, [tuple_predicate(*f) for f in group]) for group in filters])


def read_years(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Yearly tables stacked by name.

    Years with the same columns are one scan. A column that is text in one
    year is text in all; a column that a year lacks is null there.
    """
    alike: dict[str, list[str]] = {}
    schemas: dict[str, T.StructType] = {}
    for path in paths:
        found = spark.read.parquet(path).schema
        alike.setdefault(found.json(), []).append(path)
        schemas[found.json()] = found
    frames = [spark.read.schema(schemas[key]).parquet(*group) for key, group in alike.items()]
    return union_years(frames)


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    types: dict[str, set[str]] = {}
    for frame in frames:
        for name, dtype in frame.dtypes:
            types.setdefault(name, set()).add(dtype)
    mixed = {name for name, found in types.items() if len(found) > 1 and "string" in found}
    aligned = [f.withColumns({c: F.col(c).cast("string") for c in f.columns if c in mixed}) if mixed else f for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)


def load_deliveries(
    spark: SparkSession,
    data_folder: str,
    file_type: str = "lar",
    min_year: int | None = 2018,
    max_year: int | None = 2023,
    columns: Sequence[str] | None = None,
    filters=None,
) -> DataFrame:
    """All parquet deliveries of the years; columns and filters reach the scan."""
    paths = delivery_paths(
        spark, data_folder, file_type=file_type, min_year=min_year, max_year=max_year, extension="parquet"
    )
    if not paths:
        raise FileNotFoundError("no delivery matches; check the manifest and the year bounds")
    loans = read_years(spark, paths)
    if filters:
        loans = loans.filter(filter_from_tuples(filters))
    return loans if columns is None else loans.select(*columns)


def may_be_sold(df: DataFrame) -> DataFrame:
    """Purchases, and originations not sold to an agency; an unreported type stays."""
    return df.filter(
        none_of(F.col("purchaser_type"), schema.AGENCY_PURCHASER_TYPES)
        | (F.col("action_taken") == schema.PURCHASED)
    )


def _linkage_rows(df: DataFrame, added_filters: Sequence[FilterTuple] = ()) -> DataFrame:
    tests = [("action_taken", "in", [schema.ORIGINATED, schema.PURCHASED]), *added_filters]
    return may_be_sold(df.filter(filter_from_tuples(tests)))


def load_linkage_input(
    spark: SparkSession,
    data_folder: str,
    min_year: int = 2018,
    max_year: int = 2023,
    added_filters: Sequence[FilterTuple] | None = None,
) -> DataFrame:
    """Originations and purchases of the years, with the columns used for linking.

    Every year of the range must have a delivery.
    """
    listed = resolve_deliveries(spark, data_folder, min_year=min_year, max_year=max_year, extension="parquet").collect()
    missing = set(range(min_year, max_year + 1)) - {row.Year for row in listed}
    if missing:
        raise FileNotFoundError(f"no parquet delivery for {sorted(missing)}")
    return _linkage_rows(linkage_columns(read_years(spark, [row.path for row in listed])), added_filters or ())


def year_files(spark: SparkSession, data_folder: str, year: int) -> list[str]:
    """Parquet paths in the folder whose name holds the year, on any file system.

    Spark lists the files; their contents are not read. A delivery of several
    files is the folder that holds them.
    """
    folder = data_folder.rstrip("/")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/*{year}*.parquet")
    except AnalysisException as gone:
        if gone.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    inside = re.escape(re.sub(r"^\w+:/*(?=/)", "", folder))
    delivery = F.regexp_extract("path", rf"^(.*?{inside}/[^/]+)", 1)
    return sorted(row.delivery for row in files.select(delivery.alias("delivery")).distinct().collect())


def load_linkage_input_pre2018(
    spark: SparkSession, data_folder: str, min_year: int = 2007, max_year: int = 2017
) -> DataFrame:
    """Originations and purchases of 2007-2017, all columns, first file per year."""
    paths = []
    for year in range(min_year, max_year + 1):
        found = year_files(spark, data_folder, year)
        if not found:
            raise FileNotFoundError(f"no parquet file for {year} in {data_folder}")
        paths.append(found[0])
    return _linkage_rows(read_years(spark, paths))


LENDER_SCHEMA = ("lei", "respondent_name_panel", "respondent_name_ts")


def read_lender_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lender names from a pipe-separated file, upper-cased."""
    names = spark.read.csv(path, sep="|", header=True).select(*LENDER_SCHEMA)
    return upper_lender_names(names)


def upper_lender_names(names: DataFrame) -> DataFrame:
    return names.select([F.upper(c).alias(c) for c in LENDER_SCHEMA]).dropDuplicates()


CROSSWALK_SCHEMA = T.StructType(
    [
        T.StructField("HMDAIndex_s", T.StringType()),
        T.StructField("HMDAIndex_p", T.StringType()),
        T.StructField("match_round", T.IntegerType()),
    ]
)
