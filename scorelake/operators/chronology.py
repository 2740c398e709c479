"""A place in time for works without a year, from their dated neighbours in numbered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold
from ..sources.tables import settled

SERIES = r"(?i)^(.*?)\bNo\.?\s*(\d+)\b"
#: Only catalogues numbered in order of composition.
CATALOGUE = r"(?i)^\s*(Op|K|D)\.?\s*(\d+)"
STEP = 0.001


def series_of(title: Column) -> Column:
    """Struct of stem and number from "… No. 5 …"; null without both."""
    stem, n = fold(F.regexp_extract(title, SERIES, 1)), F.nullif(F.regexp_extract(title, SERIES, 2), F.lit("")).cast("long")
    return F.when((stem != "") & n.isNotNull(), F.struct(stem.alias("stem"), n.alias("n")))


def catalogue_of(catalogue: Column) -> Column:
    n = F.nullif(F.regexp_extract(catalogue, CATALOGUE, 2), F.lit("")).cast("long")
    return F.when(n.isNotNull(), F.struct(F.lower(F.regexp_extract(catalogue, CATALOGUE, 1)).alias("stem"), n.alias("n")))


def estimate(y: Column, n: Column, prev: Column, following: Column) -> Column:
    """The year of number n between two dated members (structs n, y; null where there is none)."""
    slope = prev["y"] + (following["y"] - prev["y"]) * (n - prev["n"]) / (following["n"] - prev["n"])
    beside = prev["y"] + STEP * (n - prev["n"])
    between = F.when((prev["y"] > following["y"]) | (slope == prev["y"]), beside).otherwise(slope)
    return (
        F.when(prev.isNotNull() & following.isNotNull(), between)
        .when(prev.isNotNull(), beside)
        .when(following.isNotNull(), following["y"] - STEP * (following["n"] - n))
    )


def _placed(df: DataFrame, sequence: str, out: str) -> DataFrame:
    """Adds the estimate from the sequences (composer, stem) that the column `sequence` names. Rows outside any stay where they are.

    The members of all sequences are dealt to ranges of (composer, stem, number), so that a sequence of any length takes as
    many tasks as it fills. A member looks for its dated neighbours in its own range; where the sequence goes on in other
    ranges, the nearest dated members of those are carried over. Only sequences at the ends of ranges need that, so the
    table of what is carried is bounded by the number of ranges.
    """
    held = F.col(sequence)
    inside = df.where(held.isNotNull()).withColumns({"_c": F.coalesce(F.col("c").cast("string"), F.lit("")), "_stem": held["stem"], "_num": held["n"]})
    dealt = settled(inside.repartitionByRange("_c", "_stem", "_num").withColumn("_range", F.spark_partition_id()))
    dated = F.when(F.coalesce(F.col("y"), F.lit(0)) != 0, F.struct(F.col("_num").alias("n"), F.col("y").alias("y")))
    # A null order is passed over, so that undated members are no neighbours. Of equal numbers the last is before, the first behind.
    place = F.when(dated.isNotNull(), F.struct("_num", "ord"))
    order = W.partitionBy("_range", "_c", "_stem").orderBy("_num")
    prev = F.max_by(dated, place).over(order.rangeBetween(W.unboundedPreceding, 0))
    following = F.min_by(dated, place).over(order.rangeBetween(1, W.unboundedFollowing))

    blocks = dealt.groupBy("_c", "_stem", "_range").agg(F.max_by(dated, place).alias("_last"), F.min_by(dated, place).alias("_first"))
    along = W.partitionBy("_c", "_stem").orderBy("_range")
    carried = blocks.withColumn("_parts", F.count(F.lit(1)).over(W.partitionBy("_c", "_stem"))).where("_parts > 1")
    carried = carried.select(
        "_c", "_stem", "_range", F.last("_last", True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_before"), F.first("_first", True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("_behind"),
    )
    own = dealt.withColumn("_prev", prev).withColumn("_next", following).join(F.broadcast(carried), ["_c", "_stem", "_range"], "left")
    own = own.withColumn(out, estimate(F.col("y"), F.col("_num"), F.coalesce("_prev", "_before"), F.coalesce("_next", "_behind")))
    return own.select(*df.columns, out).unionByName(df.where(held.isNull()).withColumn(out, F.lit(None).cast("double")))


def assign_sort_years(works: DataFrame) -> DataFrame:
    """Adds sy to works (ord, c, t, cat, y, arr): the year, else the estimate from the title's series, else from a
    chronological catalogue, else null; three decimals. Arrangements take part in no sequence."""
    # Titles and catalogue numbers are read once and written: each step below goes over the works several times.
    in_order = ~F.col("arr")
    df = settled(works.withColumn("_series", F.when(in_order, series_of(F.col("t")))).withColumn("_catalogue", F.when(in_order, catalogue_of(F.col("cat")))))
    df = _placed(_placed(df, "_series", "_a"), "_catalogue", "_b")
    sy = F.coalesce(F.nullif(F.col("y"), F.lit(0)).cast("double"), "_a", "_b")
    return df.withColumn("sy", F.floor(sy * 1000 + 0.5) / 1000).drop("_a", "_b", "_series", "_catalogue")
