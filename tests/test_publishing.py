"""Versions that are published whole or not at all."""

import pytest
from pyspark.sql import functions as F

from scorelake.sources import publishing as p


@pytest.fixture
def rows(spark):
    return spark.range(400).select("id", (F.col("id") % 40).alias("c"), F.create_map(F.lit("a"), "id", F.lit("b"), F.lit(1).cast("long")).alias("m"), F.when(F.col("id") % 3 > 0, "x").alias("t"))


def held(spark, path, version=None):
    return sorted((r["id"], r["c"], r["t"]) for r in p.load(spark, path, "works", version).collect())


def tables(rows, **more):
    return {"works": p.Table(rows, "c", **more)}


def test_only_changed_buckets_are_written(spark, rows, tmp_path):
    path = str(tmp_path)
    first = p.publish(tables(rows), path)
    assert first.outcome == "published" and first.written == first.buckets > 12
    again = rows.withColumn("m", F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array(F.lit(1).cast("long"), "id"))).repartition(5)
    assert p.publish(tables(again), path) == p.Outcome("unchanged", first.version, 0, first.buckets)
    changed = rows.withColumn("t", F.when(F.col("c") == 7, "new").otherwise(F.col("t")))
    second = p.publish(tables(changed), path)
    assert (second.outcome, second.written) == ("published", 1) and p.versions(spark, path) == [first.version, second.version]
    assert held(spark, path) == sorted((r["id"], r["c"], r["t"]) for r in changed.collect())
    assert held(spark, path, first.version) == sorted((r["id"], r["c"], r["t"]) for r in rows.collect())
    gone = p.publish(tables(changed.where("c <> 7")), path)
    assert gone.written <= 1 and p.load(spark, path, "works").count() == 390


def test_a_failure_leaves_the_last_whole_version(spark, rows, tmp_path):
    path = str(tmp_path)
    p.publish(tables(rows), path)
    before = held(spark, path)

    def stop(manifest):
        assert manifest.where("bucket >= 0").agg(F.sum("n")).first()[0] == 400
        raise InterruptedError

    other = rows.withColumn("t", F.lit("?"))
    with pytest.raises(InterruptedError):
        p.publish(tables(other), path, stop)
    assert held(spark, path) == before and len(p.versions(spark, path)) == 1
    with pytest.raises(RuntimeError, match="differs"):
        p.publish(tables(rows.withColumn("t", F.current_timestamp().cast("string"))), path)
    assert held(spark, path) == before
    assert p.publish(tables(other), path).outcome == "published" and held(spark, path)[0][2] == "?"
    # The first version and the two runs that never switched.
    gone = p.vacuum(spark, path, 1)
    assert gone == 3 and held(spark, path)[0][2] == "?" and len(p.versions(spark, path)) == 1


def test_losses_are_refused(spark, rows, tmp_path):
    path = str(tmp_path)
    both = tables(rows) | {"people": p.Table(rows.select("c").distinct(), "c")}
    p.publish(both, path)
    assert p.publish(tables(rows), path).outcome == "refused"
    assert p.publish(both | tables(rows.where("id < 319")), path).outcome == "refused"
    assert p.publish(both | tables(rows.where("id < 320")), path).outcome == "published" and p.load(spark, path, "works").count() == 320
    assert p.publish(both | tables(rows.where("id < 3"), loss=None), path).outcome == "published"
    assert p.publish(both | tables(rows.limit(0)), path, force=True).outcome == "published"
    assert p.load(spark, path, "works").count() == 0 and p.load(spark, path, "works").columns == ["id", "c", "m", "t"]


def test_odd_tables(spark, rows, tmp_path):
    path = str(tmp_path)
    assert p.publish(tables(rows.limit(0)), path).outcome == "published" and p.load(spark, path, "works").count() == 0
    assert p.publish(tables(rows), path).outcome == "published" and p.load(spark, path, "works").count() == 400
    assert p.publish(tables(rows.drop("t")), path).written > 12 and p.load(spark, path, "works").columns == ["id", "c", "m"]
    with pytest.raises(ValueError):
        p.load(spark, path, "nothing")
    nulls = spark.createDataFrame([(None, 5, None), (5, None, None), (None, None, [None, 1]), (None, None, [1, None])], "a int, b int, l array<int>")
    found = [p.fingerprints(nulls.limit(4).where(w), F.lit(0)).first()["fingerprint"] for w in ("b = 5", "a = 5", "l[1] = 1", "l[0] = 1")]
    assert len(set(found)) == 4


def test_folders_stay_few(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(p, "FOLDERS", 3)
    path = str(tmp_path)
    for i in range(7):
        rows = rows.withColumn("t", F.when(F.col("c") == i, f"v{i}").otherwise(F.col("t")))
        p.publish(tables(rows), path)
        assert p.manifest(spark, path).select("version").distinct().count() <= 3
    assert held(spark, path) == sorted((r["id"], r["c"], r["t"]) for r in rows.collect())
