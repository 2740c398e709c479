"""First wins, its components, and joins with hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from scorelake.operators import dedupe, joins

SCHEMA = "id int, ord int, register array<string>, query array<string>"


def by_hand(rows):
    seen, kept = {}, set()
    for i, ord_, register, query in sorted(rows, key=lambda r: r[1]):
        if not any(seen.get(q, ord_) < ord_ for q in query or ()):
            kept.add(i)
            for k in register or ():
                seen.setdefault(k, ord_)
    return kept


def survivors(spark, rows):
    return {x["id"] for x in dedupe.first_wins(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_random_rows(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, r.randrange(70), sorted({f"k{r.randrange(60)}" for _ in range(r.randrange(3))}), sorted({f"k{r.randrange(60)}" for _ in range(r.randrange(3))})) for i in range(150)]
    rows += [(900, 1, None, None), (901, 2, [], ["k1"]), (902, 0, ["k1"], None)]
    expected = by_hand(rows)
    assert survivors(spark, rows) == expected
    monkeypatch.setattr(dedupe, "ROUNDS", 0)
    assert survivors(spark, rows) == expected
    monkeypatch.setattr(dedupe, "COMPONENT", 2)
    assert survivors(spark, rows) == expected
    assert survivors(spark, []) == set()


def test_a_chain_of_thousands_takes_few_rounds(spark, monkeypatch):
    n, calls, rounds = 5000, [], []
    split, one = dedupe.join_split, dedupe._round
    monkeypatch.setattr(dedupe, "join_split", lambda *a, **k: calls.append(1) or split(*a, **k))
    monkeypatch.setattr(dedupe, "_round", lambda x: rounds.append(1) or one(x))
    order = list(range(n))
    random.Random(1).shuffle(order)
    rows = [(order[i], i, [f"k{i}"], [f"k{i}", f"k{i - 1}"]) for i in range(n)]
    assert survivors(spark, rows) == by_hand(rows)
    assert len(rounds) == dedupe.ROUNDS and len(calls) <= 2 * 16


def test_components(spark):
    r = random.Random(9)
    rows = [(i, [f"k{r.randrange(90)}" for _ in range(r.randrange(3))]) for i in range(120)]
    root = {i: i for i, _ in rows}
    find = lambda i: i if root[i] == i else find(root[i])
    first = {}
    for i, keys in rows:
        for k in keys:
            a, b = sorted((find(first.setdefault(k, i)), find(i)))
            root[b] = a
    out = dedupe.components(spark.createDataFrame(rows, "id int, keys array<string>"))
    assert {(x["id"], x["root"]) for x in out.collect()} == {(i, find(i)) for i, _ in rows}


@pytest.mark.parametrize("hot", [0, 40_000])
def test_a_hot_key_stays_where_it_lies(spark, hot):
    """Half of all rows have one key: the join leaves no task more than its share."""
    rows = spark.range(80_000).select("id", F.when(F.col("id") < hot, 7).otherwise(F.col("id") % 5000).alias("k")).repartition(8)
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    out = joins.join_split(rows, groups, ["k"], "n")
    assert out.columns == ["k", "id", "v"] and out.count() == 80_000 and out.where("v <> 2 * k").count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these rows would all fit in one task
    try:
        assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 30_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
