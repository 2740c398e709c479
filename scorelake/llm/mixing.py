"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count, written

BLOCK_WORDS = 64
SHARD_WORDS = 1 << 18
MOST_REPEATS = 3
WEIGHTS = (5, 2, 1)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Adds `target` to (source, source_size): the sources, by code point and null last, weigh `weights` in turn
    and share all words; a target stops at `most` times its source's size, and the excess goes to the others by weight.

    That fixed point is target = min(most * size, level * weight). Sources are ordered by the level at which they
    stop; a source has stopped if all words suffice to raise everybody to its own level. The windows run over one
    row per source.
    """
    every = W.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_stop = every.orderBy("stop", F.col("source").asc_nulls_last())
    before = by_stop.rowsBetween(W.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = sources.withColumn("weight", weight.cast("double")).withColumn("top", most * F.col("source_size").cast("double"))
    df = df.withColumn("stop", F.col("top") / F.col("weight")).withColumn("total", F.sum("source_size").over(every).cast("double"))
    df = df.withColumn("weights", F.sum("weight").over(every))
    full, heavy = (F.coalesce(F.sum(c).over(before), F.lit(0.0)) for c in ("top", "weight"))
    df = df.withColumn("stopped", full + F.col("stop") * (F.col("weights") - heavy) <= F.col("total"))
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("top"))).over(every), F.lit(0.0))
    left = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(every)
    df = df.withColumn("target", F.when(F.col("stopped"), F.col("top")).otherwise(rest / left * F.col("weight")))
    return df.select("source", "source_size", "target")


def sainte_lague(df: DataFrame, within: list[str], key: str, weight: str, seats: str, out: str) -> DataFrame:
    """Gives the `seats` of each group `within` to its rows by the highest quotients weight / (2k - 1); ties go to the smaller key.

    A divisor a little too large gives every row seats that it certainly has, a divisor a little too small those it
    may have at most; the two differ by about two seats a row, and only those quotients are ranked.
    """
    group = W.partitionBy(*[F.col(c) for c in within])
    n, total = F.count(F.lit(1)).over(group), F.sum(weight).over(group)
    share = F.when(total > 0, F.col(weight) / total).otherwise(F.lit(0.0))
    df = df.withColumn("_sure", F.greatest(F.floor(share * (F.col(seats) - n / 2) + 0.5) - 1, F.lit(0)).cast("long"))
    df = df.withColumn("_most", (F.ceil(share * (F.col(seats) + n / 2) + 0.5) + 1).cast("long"))
    names = [c for c in df.columns if c not in ("_sure", "_most")]
    open_ = df.where(F.col(weight) > 0).withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))))
    open_ = open_.withColumn("_q", F.col(weight) / (2 * F.col("_k") - 1))
    first = F.when(F.col("_k") == F.col("_sure") + 1, F.col("_sure")).otherwise(F.lit(0))
    open_ = open_.withColumn("_left", F.col(seats) - F.sum(first).over(group))
    open_ = open_.withColumn("_rank", F.row_number().over(group.orderBy(F.desc("_q"), F.col(key).asc_nulls_last(), "_k")))
    got = F.sum((F.col("_rank") <= F.col("_left")).cast("long")) + F.max("_sure")
    return open_.groupBy(*names).agg(got.alias(out))


def mix(docs: DataFrame, size: Column | None = None, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, row: Column | None = None) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source): doc_id, source, size, source_size, target, taken, and `row`, which may number the rows.

    Blocks of `block_words` words go to the sources by Sainte-Laguë on their targets, and each source's blocks to
    pools of its shards and then to the shards (documents dealt by a seeded hash, about `shard_words` words each), both
    by Sainte-Laguë on their sizes.
    A shard's blocks are read in the order of the seeded hash of its documents, round and round, so that every
    document is taken once before any is taken twice, and none more than three times. The seed alone decides; reruns
    agree. Null and empty texts have size 0 and are taken 0 times, null sources are a source, repeated rows are
    documents of their own, a table without words takes nothing, and an empty table gives no rows.
    """
    size = word_count(docs["text"]) if size is None else size
    draw = F.xxhash64(F.lit(seed), docs["doc_id"], F.xxhash64(docs["text"]))
    sized = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), size.alias("size"), draw.alias("draw"), (F.lit(None) if row is None else row).cast("long").alias("row"))
    sized = written(sized, "mix-sizes")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = plan.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
    plan = plan.withColumn("seats", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block_words).cast("long"))
    blocks = sainte_lague(plan.where("target > 0").withColumn("_all", F.lit(0)), ["_all"], "source", "target", "seats", "blocks")
    plan = plan.join(blocks.select(F.col("source").alias("_s"), "blocks"), F.col("source").eqNullSafe(F.col("_s")), "left")
    plan = written(plan.select("source", "source_size", "target", "shards", F.coalesce("blocks", F.lit(0)).alias("blocks")), "mix-plan")

    named = plan.select(F.col("source").alias("_s"), "source_size", "target", "shards", "blocks")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("shard", F.pmod("draw", F.col("shards")))
    rows = rows.withColumn("place", F.xxhash64("draw", F.lit(seed)))
    shards = rows.where("size > 0").groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"), F.first("shards").alias("shards"))
    # Blocks go to pools of shards and then to the shards of each, so that no window is over more than some thousand rows.
    shards = shards.withColumn("pool", F.pmod("shard", F.ceil(F.sqrt("shards")).cast("long")))
    pools = shards.groupBy("source", "pool").agg(F.sum("shard_size").alias("pool_size"), F.first("blocks").alias("blocks"))
    pools = sainte_lague(pools, ["source"], "pool", "pool_size", "blocks", "pool_quota").select(F.col("source").alias("_s"), F.col("pool").alias("_p"), "pool_quota")
    shards = shards.join(pools, F.col("source").eqNullSafe(F.col("_s")) & (F.col("pool") == F.col("_p"))).select("source", "pool", "shard", "shard_size", "pool_quota")
    quotas = sainte_lague(shards, ["source", "pool"], "shard", "shard_size", "pool_quota", "quota")
    quotas = quotas.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "shard_size", "quota")
    full = rows.where("size > 0").join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_h")))
    order = W.partitionBy("source", "shard").orderBy("place", "doc_id", "size", "row")
    full = full.withColumn("end", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    words = F.least(F.col("quota") * block_words, F.col("shard_size") * MOST_REPEATS)
    full = full.withColumn("rounds", F.floor(words / F.col("shard_size"))).withColumn("rest", words % F.col("shard_size"))
    part = F.greatest(F.least("end", "rest") - (F.col("end") - F.col("size")), F.lit(0))
    columns = ["doc_id", "source", "size", "source_size", "target", "row"]
    full = full.select(*columns, (F.col("rounds") * F.col("size") + part).cast("long").alias("taken"))
    return full.unionByName(rows.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
