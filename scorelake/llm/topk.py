"""Exact top-k search among binary codes by incremental multi-index hashing. DataFrame operations only.

Codes of 64 bits are cut into segments, and each segment of each distinct code is indexed. A query probes the values
within radius 0, 1, ... of its own in each of the m segments. Once radius r is done, every code within m * (r + 1) - 1 bits
has turned up, since one that has not differs by more than r in each segment; once the first j segments are done to
radius r and the others to r - 1, every code within m * r + j - 1 bits has. A query ends when its k-th distance is within that.
"""

from __future__ import annotations

import math
import uuid
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, written

BITS = 64
#: About 64 / log2(number of codes) is best; a fixed number keeps the work of a query alike at every size.
SEGMENTS = 4
K = 10
QUERY_STEP = 100
#: More probes of a segment than this are made segment by segment.
WIDE = 600


def sign_code(embedding: Column) -> Column:
    """Bit b of the 64-bit code is 1 if coordinate b is above 0; of a longer embedding, if the sum of coordinates b, b + 64, b + 128, ... is.

    Null for a null embedding; missing and null coordinates are 0.
    """
    several = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.aggregate(F.filter(embedding, lambda x, i: i % BITS == b), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)).cast("double")))
    values = F.when(F.size(embedding) > BITS, several).otherwise(embedding.cast("array<double>"))
    ones = F.array(*[F.lit((1 << i) - (1 << 64 if i == 63 else 0)) for i in range(BITS)])
    bits = F.transform(values, lambda x, b: F.when(x > 0, F.element_at(ones, b + 1)).otherwise(F.expr("0L")))
    return F.when(embedding.isNotNull(), F.aggregate(bits, F.expr("0L"), lambda a, x: a.bitwiseOR(x)))


def cuts(segments: int) -> list[tuple[int, int]]:
    """Where each segment of a code begins and how wide it is; the first are wider by one where they can't all be alike."""
    widths = [BITS // segments + (s < BITS % segments) for s in range(segments)]
    return [(sum(widths[:s]), w) for s, w in enumerate(widths)]


def segment(code: Column, at: int, width: int) -> Column:
    """The bits of a segment as a number."""
    return F.shiftrightunsigned(code, at).bitwiseAND(F.lit((1 << width) - 1))


def masks(width: int, radius: int) -> Column:
    """All numbers of `width` bits with `radius` of them set, as a constant array."""
    every = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
    return F.split(F.lit(",".join(map(str, every))), ",").cast("array<long>") if every else F.array().cast("array<long>")


class SegmentIndex:
    """A table (s, value, code): every segment of every code, bucketed by segment and value, so that probes move to it and it stays where it is."""

    def __init__(self, codes: DataFrame, layout: list[tuple[int, int]]):
        self.spark, self.name, buckets = codes.sparkSession, f"segment_index_{uuid.uuid4().hex}", shuffle_partitions(codes.sparkSession)
        rows = codes.select("code", F.posexplode(F.array(*[segment(F.col("code"), *c) for c in layout])).alias("s", "value"))
        rows = rows.repartition(buckets, "s", "value").select("s", "value", "code")
        rows.write.format("parquet").bucketBy(buckets, "s", "value").saveAsTable(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, segments: int = SEGMENTS) -> DataFrame:
    """(query_id, rank, neighbour_id, distance): for each row of `queries` (id, code) the k rows of `vectors` (id, code)
    with the smallest Hamming distance, the smaller id first among equals, the query's own id left out.

    Exact. Queries with fewer than k other vectors get all there are. Null codes and ids take no part, repeated rows
    count once. Copies of a code are searched once and stand for their k + 1 smallest ids, which is all a result can
    hold. Queries are probed in tables, never collected; only the number of open ones comes to the driver.
    """
    vectors = vectors.select("id", "code").where("id is not null and code is not null").distinct()
    # At most k + 1 ids of each code; each task drops the others before anything is sent.
    first = vectors.withColumn("n", F.row_number().over(W.partitionBy("code").orderBy("id"))).where(F.col("n") <= k + 1)
    kinds = written(first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "codes")
    layout = cuts(segments)
    index = SegmentIndex(kinds, layout)
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).where("query_id is not null and query is not null").distinct()
    asked = written(asked, "queries")
    open_ = written(asked.select("query").distinct().withColumn("bound", F.lit(BITS)), "open")
    best = None
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
    apart = [F.bit_count(segment(F.col("query"), *c).bitwiseXOR(segment(F.col("code"), *c))) for c in layout]
    values = F.array(*[segment(F.col("query"), *c) for c in layout])
    widest = max(w for _, w in layout)
    for radius in range(widest + 1):
        # Small radii take all segments at once. Large ones, which probe thousands of values, go on segment by segment and stop between.
        steps = [list(range(segments))] if math.comb(widest, radius) <= WIDE else [[s] for s in range(segments)]
        wide, narrow = masks(widest, radius), masks(widest - 1, radius)
        mask = F.when(F.col("s").isin([s for s, (_, w) in enumerate(layout) if w == widest]), wide).otherwise(narrow)
        for step in steps:
            # Dealt out before they multiply; and joined by shuffle, as the planner would take the probes for as few as the queries.
            probes = open_.select("query", "bound", F.posexplode(values).alias("s", "own")).where(F.col("s").isin(step))
            probes = probes.repartition(shuffle_partitions(open_.sparkSession), "query", "s").withColumn("mask", F.explode(mask))
            probes = probes.select("query", "bound", "s", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
            # Only codes as near as the k-th so far can change a result.
            found = probes.join(index.table().hint("shuffle_hash"), ["s", "value"]).where(distance <= F.col("bound"))
            # A code turns up first in its nearest segment, the foremost of several; elsewhere it is left out.
            for x in range(segments):
                found = found.where(F.when(F.col("s") > x, apart[x] > radius).when(F.col("s") < x, apart[x] >= radius).otherwise(F.lit(True)))
            found = found.select("query", "code", distance.alias("distance"))
            better = _nearest_codes(found if best is None else best.unionByName(found), kinds, k)
            covered = segments * radius + step[-1]
            state = better.join(kinds, "code").groupBy("query").agg(
                F.sum(F.size("ids")).alias("n"), F.max("distance").alias("far"), F.sum(F.when(F.col("distance") <= covered, F.size("ids")).otherwise(0)).alias("near")
            )
            left = open_.select("query").join(state, "query", "left").where(F.coalesce("near", F.lit(0)) <= k)
            still = written(left.select("query", F.when(F.col("n") > k, F.col("far")).otherwise(BITS).alias("bound")), "open")
            discard(open_, *([best] if best is not None else []))
            open_, best = still, better
            if not open_.count():
                index.drop()
                return _ranked(asked, best, kinds, k)
    index.drop()
    return _ranked(asked, best, kinds, k)


def _nearest_codes(found: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """The codes that can hold any of a query's k + 1 nearest ids: those at no more than the (k + 1)-th code's distance, at most k + 1 by distance and smallest id."""
    named = found.join(kinds.select("code", F.element_at("ids", 1).alias("least")), "code")
    order = W.partitionBy("query").orderBy("distance", "least")
    return written(named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query", "code", "distance"), "best")


def _ranked(asked: DataFrame, best: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    pairs = asked.join(best, "query").join(kinds, "code").select("query_id", "distance", F.explode("ids").alias("neighbour_id"))
    order = W.partitionBy("query_id").orderBy("distance", "neighbour_id")
    pairs = pairs.where("neighbour_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return pairs.select("query_id", "rank", "neighbour_id", "distance")


def embedding_search(embeddings: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """top_k of the sign codes of `embeddings` (vec_id, embedding); the queries are the rows whose id is divisible by `step`."""
    rows = embeddings.select(embeddings["vec_id"].alias("id"), sign_code(embeddings["embedding"]).alias("code"))
    return top_k(rows, rows.where(F.col("id") % step == 0), k)
