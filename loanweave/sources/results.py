"""Tables that hand results over between rounds.

Each round writes a path of its own and reads its predecessor's, so nothing
is overwritten while it is read. The file names are fixed values that readers
of the result folder rely on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanweave import schema
from loanweave.sources.deliveries import CROSSWALK_SCHEMA


class ResultFolder:
    """Names and access for everything a linkage run leaves in its folder."""

    def __init__(self, spark: SparkSession, folder: str, suffix: str | None = None):
        self.spark, self.folder, self.suffix = spark, str(folder), suffix or ""

    def _path(self, name: str, match_round: int, extension: str = "parquet") -> str:
        return f"{self.folder}/{name}_round{match_round}{self.suffix}.{extension}"

    def crosswalk_path(self, match_round: int) -> str:
        return self._path("hmda_seller_purchaser_matches", match_round)

    def crosswalk(self, match_round: int) -> DataFrame:
        return self.spark.read.parquet(self.crosswalk_path(match_round))

    def write_crosswalk(self, links: DataFrame, match_round: int) -> DataFrame:
        """Append a round's links to its predecessor's crosswalk."""
        previous = self.crosswalk(match_round - 1) if match_round > 1 else None
        append_crosswalk(links, match_round, previous).write.mode("overwrite").parquet(self.crosswalk_path(match_round))
        return self.crosswalk(match_round)

    def write_crosswalk_csv(self, links: DataFrame, match_round: int) -> DataFrame:
        """The same as text, for the 2007-2017 form."""
        previous = self.read_crosswalk_csv(match_round - 1) if match_round > 1 else None
        path = f"{self.folder}/hmda_seller_purchaser_matches_round{match_round}.csv"
        append_crosswalk(links, match_round, previous).write.mode("overwrite").csv(path, header=True)
        return self.read_crosswalk_csv(match_round)

    def read_crosswalk_csv(self, match_round: int) -> DataFrame:
        path = f"{self.folder}/hmda_seller_purchaser_matches_round{match_round}.csv"
        return self.spark.read.csv(path, header=True, schema=CROSSWALK_SCHEMA)

    def pre2018_crosswalk_path(self, match_round: int) -> str:
        return f"{self.folder}/pre2017_hmda_seller_purchaser_matches_round{match_round}.parquet"

    def pre2018_crosswalk(self, match_round: int) -> DataFrame:
        return self.spark.read.parquet(self.pre2018_crosswalk_path(match_round))

    def write_pre2018_crosswalk(self, crosswalk: DataFrame, match_round: int) -> DataFrame:
        crosswalk.write.mode("overwrite").parquet(self.pre2018_crosswalk_path(match_round))
        return self.pre2018_crosswalk(match_round)

    def write_matched_loans(self, loans: DataFrame, match_round: int) -> DataFrame:
        loans.write.mode("overwrite").parquet(self._path("hmda_seller_purchaser_matched_loans", match_round))
        return self.matched_loans(match_round)

    def matched_loans(self, match_round: int) -> DataFrame:
        return self.spark.read.parquet(self._path("hmda_seller_purchaser_matched_loans", match_round))

    def write_typed_relationships(self, relationships: DataFrame, match_round: int) -> DataFrame:
        path = self._path("hmda_seller_purchaser_relationships_w_types", match_round)
        relationships.write.mode("overwrite").parquet(path)
        return self.typed_relationships(match_round)

    def typed_relationships(self, match_round: int) -> DataFrame:
        return self.spark.read.parquet(self._path("hmda_seller_purchaser_relationships_w_types", match_round))

    def write_affiliates(self, affiliates: DataFrame, match_round: int) -> DataFrame:
        path = self._path("affiliate_lei_matches", match_round, "csv")
        affiliates.write.mode("overwrite").csv(path, header=True)
        return self.affiliates(match_round)

    def affiliates(self, match_round: int) -> DataFrame:
        path = self._path("affiliate_lei_matches", match_round, "csv")
        return self.spark.read.csv(path, header=True, schema="lei_s string, lei_p string")

    def write_large_relationships(self, pairs: DataFrame, match_round: int) -> DataFrame:
        path = f"{self.folder}/large_seller_purchaser_relationships_round{match_round}.parquet"
        pairs.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def write_plain(self, name: str, loans: DataFrame) -> DataFrame:
        loans.write.mode("overwrite").parquet(self._prepared_path(name))
        return self.plain(name)

    def plain(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._prepared_path(name))

    def _prepared_path(self, name: str) -> str:
        return f"{self.folder}/prepared_loans_{name}{self.suffix}.parquet"

    def write_bucketed(self, name: str, loans: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
        """An external table in this folder with one file per bucket."""
        table, path = self._bucketed(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        spread = loans.repartition(buckets, *keys)
        writer = spread.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
        writer.option("path", path).saveAsTable(table)
        return self.spark.table(table)

    def bucketed(self, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
        """The table that `write_bucketed` left, also in a session that doesn't know it yet."""
        table, path = self._bucketed(name)
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(path).schema)
            by = ", ".join(keys)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(table)

    def _bucketed(self, name: str) -> tuple[str, str]:
        path = f"{self.folder}/prepared_loans_{name}{self.suffix}_bucketed"
        return f"prepared_loans_{name}_{hashlib.md5(path.encode()).hexdigest()}", path

    def mark_complete(self, name: str, note: str) -> None:
        """Say, with a note, that all that belongs to the name has been written."""
        marker = self.spark.createDataFrame([(note,)], "note string").coalesce(1)
        marker.write.mode("overwrite").parquet(f"{self._prepared_path(name)}.complete")

    def completed(self, name: str) -> str | None:
        """The note of `mark_complete`, or None if there is none."""
        try:
            row = self.spark.read.parquet(f"{self._prepared_path(name)}.complete").first()
        except AnalysisException:
            return None
        return None if row is None else row["note"]


def append_crosswalk(links: DataFrame, match_round: int, previous: DataFrame | None = None) -> DataFrame:
    """``HMDAIndex_s, HMDAIndex_p, match_round`` of this and all earlier rounds."""
    current = links.select("HMDAIndex_s", "HMDAIndex_p", F.lit(match_round).cast("int").alias("match_round"))
    return current if previous is None else previous.select(current.columns).unionByName(current)


def append_crosswalk_pre2018(links: DataFrame, match_round: int, previous: DataFrame | None = None) -> DataFrame:
    """The id columns that exist on either side and ``MatchRound``."""
    ids = [f"{c}_{side}" for side in ("s", "p") for c in schema.PRE2018_ID_COLUMNS if f"{c}_{side}" in links.columns]
    current = links.select(*ids, F.lit(match_round).cast("int").alias("MatchRound"))
    return current if previous is None else previous.unionByName(current, allowMissingColumns=True)
