"""Places, batches, chunks and sequences that no single task holds."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scorelake.operators import chronology, search
from scorelake.sources import tables


@pytest.fixture
def apart(spark):
    """Keeps small ranges apart, which adaptive execution would join."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def estimate_by_hand(rows):
    """(ord -> year) of one sequence of (ord, n, y)."""
    dated = sorted((n, o, y) for o, n, y in rows if y)
    out = {}
    for o, n, y in rows:
        before, behind = [x for x in dated if x[0] <= n], [x for x in dated if x[0] > n]
        if y:
            out[o] = float(y)
            continue
        p, f = (before[-1] if before else None), (behind[0] if behind else None)
        if p and f:
            slope = p[2] + (f[2] - p[2]) * (n - p[0]) / (f[0] - p[0])
            sy = p[2] + 0.001 * (n - p[0]) if p[2] > f[2] or slope == p[2] else slope
        elif p:
            sy = p[2] + 0.001 * (n - p[0])
        else:
            sy = f[2] - 0.001 * (f[0] - n) if f else None
        out[o] = None if sy is None else int(sy * 1000 + 0.5) / 1000
    return out


def test_a_sequence_in_several_tasks(spark, apart):
    r = random.Random(2)
    one = [(o, r.randrange(1, 900), r.randrange(1700, 1900) if o % 40 == 7 else None) for o in range(1500)]
    bare = [(o, n, None) for o, n, _ in one[:20]]
    rows = [(o, "a", f"Study No. {n}", None, y, False) for o, n, y in one] + [(10_000 + o, "b", f"Study No. {n}", None, y, False) for o, n, y in bare] + [(20_000, None, "Study No. 1", None, 1800, False), (20_001, None, "Study No. 2", None, None, False)]
    df = spark.createDataFrame(rows, "ord int, c string, t string, cat string, y int, arr boolean")
    inside = df.repartitionByRange("c", "t").select(F.spark_partition_id().alias("p")).distinct().count()
    assert inside > 1
    got = {x["ord"]: x["sy"] for x in chronology.assign_sort_years(df).collect()}
    expected = estimate_by_hand(one) | {10_000 + o: None for o, _, _ in bare} | {20_000: 1800.0, 20_001: 1800.001}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v, abs=1.1e-3) if v is not None else got[k] is None for k, v in expected.items())


def test_batches_sort_few_rows(spark, apart):
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 613).alias("k"))
    index = search.OrderIndex(rows, [F.desc("k"), F.col("id")], 500)
    expected = sorted(((r["k"], r["id"]) for r in rows.collect()), key=lambda x: (-x[0], x[1]))
    for number in (0, 1, 17, 33, 34):
        got = sorted(((r["place"], r["k"], r["id"]) for r in index.batch(number).collect()))
        assert [(k, i) for _, k, i in got] == expected[number * 150 : number * 150 + 150] and [p for p, _, _ in got] == list(range(number * 150 + 1, number * 150 + 1 + len(got)))
    assert index.ranges.count() > 5 and index.ranges.agg(F.max("_n")).first()[0] < 1500
    assert search.OrderIndex(rows.limit(0), [F.col("id")]).batch(0).count() == 0


def test_chunks_and_facets(spark, apart):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", None]) if i % 3 else "a", r.choice("xyz"), r.randrange(4), r.sample(["trumpet", "cornet", "tuba"], r.randrange(3))) for i in range(700)]
    df = spark.createDataFrame(rows, "ord int, g string, c string, size int, req array<string>")
    got = {(x["g"], x["chunk"]): x["items"] for x in search.chunks(df, "g", [F.desc("size"), F.col("ord")], F.col("ord"), 50).collect()}
    expected = {}
    for g in ("a", "b", None):
        own = sorted((-s, i) for i, h, _, s, _ in rows if h == g)
        expected |= {(g, k // 50): [i for _, i in own[k : k + 50]] for k in range(0, len(own), 50)}
    assert got == expected
    found = {(x["facet"], x["value"]): x["works"] for x in search.facets(df, ("trumpet", "cornet")).collect()}
    members = Counter(k for *_, req in rows for k in req if k != "tuba")
    assert found == {("all", ""): 700, ("composers", None): 3} | {("genre", k): n for k, n in Counter(x[1] for x in rows).items()} | {("size", str(k)): n for k, n in Counter(x[3] for x in rows).items()} | {("member", k): n for k, n in members.items()}
    assert search.facets(df.limit(0), ("trumpet",)).count() == 0


def test_done_keys_are_not_shuffled(spark, tmp_path):
    df = spark.range(100).select("id", F.lit("b").alias("t"))
    both = df.unionByName(df.withColumn("t", F.lit("a")))
    tables.append_new(df.where("id < 60").withColumn("t", F.lit("old")), str(tmp_path / "t"), "id")
    kept = tables.append_new(both, str(tmp_path / "t"), "id")
    assert {(r["t"], r["n"]) for r in kept.groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()} == {("old", 60), ("a", 40)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.unseen(df, kept, "id")._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("Range (") < plan.index("Bucketed: true")
