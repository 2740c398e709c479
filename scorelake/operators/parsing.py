"""Scorings that stay parsed: a table of the texts that were read, so that a rerun reads only what it hasn't seen."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import GRAMMAR, SCORING, TRUMPETS, Family, join_parsed, named_texts, parse_column
from ..sources.tables import settled

BUCKETS = 16
KEY = ["_h1", "_h2"]


class ParsedTexts:
    """The table below `path` of all texts that one version of the grammar has parsed for one family: _h1, _h2, text, scoring.

    It is bucketed and sorted by the texts' 128 bits, so that neither a lookup nor a comparison of two versions moves its
    rows. Number of buckets, grammar and family are part of where it lies. One run adds to it at a time.
    """

    def __init__(self, spark: SparkSession, path: str, family: Family = TRUMPETS, grammar: str = GRAMMAR, buckets: int = BUCKETS):
        self.spark, self.family = spark, family
        self.version = hashlib.sha256(repr((grammar, family)).encode()).hexdigest()[:12]
        where = f"{path.rstrip('/')}/{self.version}-{buckets}"
        self.name = f"parsed_{hashlib.sha256(where.encode()).hexdigest()[:16]}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (_h1 BIGINT, _h2 BIGINT, text STRING, scoring {SCORING}) USING parquet "
            f"CLUSTERED BY (_h1, _h2) SORTED BY (_h1, _h2) INTO {buckets} BUCKETS LOCATION '{where}'"
        )

    def rows(self) -> DataFrame:
        """One row a text; a run that was repeated may have written some twice."""
        return self.spark.table(self.name).groupBy(*KEY).agg(F.first("text").alias("text"), F.first("scoring").alias("scoring"))

    def add(self, df: DataFrame, text_col: str) -> int:
        """Parses the texts of `df` that name the family and aren't in the table yet; how many."""
        new = named_texts(df, text_col, self.family).join(self.spark.table(self.name).select(*KEY), KEY, "left_anti")
        before = self.spark.table(self.name).count()
        new.select(*KEY, F.col("_text").alias("text"), parse_column(F.col("_text"), self.family).alias("scoring")).write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).count() - before

    def parse(self, df: DataFrame, text_col: str, out: str = "scoring") -> DataFrame:
        """`df` with the struct `out`, as `parse_scoring` gives it, after adding what is missing."""
        self.add(df, text_col)
        asked = named_texts(df, text_col, self.family).select(*KEY, "_n")
        return join_parsed(df, text_col, settled(asked.join(self.rows().select(*KEY, F.col("scoring").alias(out)), KEY)), self.family, out)

    def forget(self) -> None:
        """Drops the name from the session's catalogue; the table's files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _comparable(scoring: Column) -> Column:
    """All of a scoring as text; null for one without players and doublings."""
    told = F.to_json(F.struct(F.array_sort(F.map_entries(scoring["counts"])).alias("counts"), scoring["doublings"].alias("doublings"), scoring["uncertain"].alias("uncertain")))
    return F.when((F.size(scoring["counts"]) > 0) | (F.size(scoring["doublings"]) > 0), told)


def changes(old: ParsedTexts, new: ParsedTexts) -> DataFrame:
    """(text, before, after) for the texts whose scoring differs; a text that names no member of one of the families has none there."""
    a = old.rows().select(*KEY, F.col("text").alias("_a"), F.col("scoring").alias("before"))
    b = new.rows().select(*KEY, F.col("text").alias("_b"), F.col("scoring").alias("after"))
    both = a.join(b.hint("merge"), KEY, "full")
    return both.where(~_comparable(F.col("before")).eqNullSafe(_comparable(F.col("after")))).select(F.coalesce("_a", "_b").alias("text"), "before", "after")
