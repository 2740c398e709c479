"""Publishing a set of tables as one version, whole or not at all.

    <path>/data/<table>/<version>/bucket=<n>/   rows of the buckets that this version wrote
    <path>/manifests/<version>/                 for each table and bucket its rows, their fingerprint, and the version that wrote it
    <path>/current/<number>-<version>           an empty file, made last: the largest number names the version that is read

A version writes the buckets whose rows differ from those of the version before and takes the others over. What is written
is read back and held against its manifest before the switch. Until then, readers and the next run see the old version
alone, so that a run which stops anywhere leaves nothing half done. One publisher writes to a path at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StructField, StructType

LOSS = 0.2
BUCKETS = 16
#: A table is read from the folders of at most so many versions; a version that would need more writes all its buckets.
FOLDERS = 8
BUCKET = "bucket"


def guard_loss(old: int, new: int, loss: float = LOSS) -> bool:
    """Whether a refresh may be published: it loses no more than a fifth."""
    return new >= old * (1 - loss)


# ── fingerprints ──────────────────────────────────────────────────────────────


def _ordered(value: Column, kind: DataType) -> Column:
    """The value with maps as sorted arrays of entries, however deep."""
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(_ordered(e["key"], kind.keyType).alias("key"), _ordered(e["value"], kind.valueType).alias("value")))
        return F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[_ordered(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def row_text(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All of a row as text, names and nulls included: equal for equal rows only, in whatever order columns and map entries stand."""
    kinds = {f.name: f.dataType for f in df.schema}
    cells = [_ordered(F.col(f"`{c}`"), kinds[c]).alias(c) for c in sorted(columns or df.columns)]
    return F.to_json(F.struct(*cells), {"ignoreNullFields": "false"})


def fingerprints(df: DataFrame, by: Column, columns: list[str] | None = None) -> DataFrame:
    """(bucket, n, fingerprint) by bucket: a sum of 128 bits of hashes of the rows, which no order or partitioning changes."""
    text = row_text(df, columns)
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "_text").cast("decimal(38,0)")).cast("string")
    rows = df.select(by.alias(BUCKET), text.alias("_text"))
    return rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("|", total(1), total(2)), 256).alias("fingerprint"))


def bucket_of(key: str | None, buckets: int) -> Column:
    return F.lit(0) if key is None else F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def build_of(manifest: DataFrame) -> DataFrame:
    """One row, build: ten hexadecimal digits of a hash over the tables' hashes over their buckets' fingerprints."""
    own = F.concat_ws(":", BUCKET, "fingerprint")
    by_table = manifest.groupBy("table").agg(F.concat_ws("|", F.array_sort(F.collect_list(own))).alias("all"))
    whole = F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws("=", "table", F.sha2("all", 256)))))
    return by_table.agg(F.substring(F.sha2(whole, 256), 1, 10).alias("build"))


# ── files ─────────────────────────────────────────────────────────────────────


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    system, where = _files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []


def _delete(spark: SparkSession, path: str) -> None:
    system, where = _files(spark, path)
    system.delete(where, True)


def versions(spark: SparkSession, path: str) -> list[str]:
    """The published versions, oldest first."""
    found = sorted((int(n), version) for n, _, version in (name.partition("-") for name in _names(spark, f"{path}/current")) if n.isdigit())
    return [version for _, version in found]


def manifest(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    """(table, bucket, n, fingerprint, version) of a version, the current one unless another is named; None where nothing is published."""
    known = versions(spark, path)
    if not known:
        return None
    return spark.read.parquet(f"{path}/manifests/{version or known[-1]}")


def load(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """A table of the current version, or of another one that hasn't been removed."""
    found = manifest(spark, path, version)
    own = [] if found is None else found.where(F.col("table") == name).groupBy("version").agg(F.collect_set(BUCKET).alias("buckets")).collect()  # at most FOLDERS rows
    if not own:
        raise ValueError(f"{path} has no table {name}")
    parts = []
    for folder in own:
        # -1 stands for a table without rows, whose folder holds its columns alone.
        rows = spark.read.option("basePath", f"{path}/data/{name}/{folder['version']}").parquet(f"{path}/data/{name}/{folder['version']}")
        parts.append(rows.where(F.col(BUCKET).isin(folder["buckets"])).drop(BUCKET))
    return reduce(lambda a, b: a.unionByName(b), parts)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes what only versions before the last `keep`, and runs that never switched, need; how many folders went."""
    stay = set(versions(spark, path)[-keep:])
    used = set()
    for version in stay:
        used |= {(r["table"], r["version"]) for r in manifest(spark, path, version).select("table", "version").distinct().collect()}
    gone = 0
    for name in _names(spark, f"{path}/current"):
        if name.partition("-")[2] not in stay:
            _delete(spark, f"{path}/current/{name}")
    for version in _names(spark, f"{path}/manifests"):
        if version not in stay:
            _delete(spark, f"{path}/manifests/{version}")
    for name in _names(spark, f"{path}/data"):
        for version in _names(spark, f"{path}/data/{name}"):
            if (name, version) not in used:
                _delete(spark, f"{path}/data/{name}/{version}")
                gone += 1
    return gone


# ── publishing ────────────────────────────────────────────────────────────────


@dataclass(frozen=True)
class Outcome:
    """What became of a run: published, unchanged or refused; the current version; how many buckets it wrote, of how many."""

    outcome: str
    version: str | None
    written: int
    buckets: int


@dataclass(frozen=True)
class Table:
    """Rows, the column that they are dealt to buckets by (None: one bucket), an order within files, and how many rows may go."""

    rows: DataFrame
    key: str | None
    order: tuple[Column | str, ...] = ()
    #: None: any.
    loss: float | None = LOSS
    buckets: int = BUCKETS


def _planned(tables: dict[str, Table]) -> DataFrame:
    """The manifest of the tables as they are: (table, bucket, n, fingerprint)."""
    found = []
    for name, t in tables.items():
        own = fingerprints(t.rows, bucket_of(t.key, t.buckets)).select(F.lit(name).alias("table"), BUCKET, "n", "fingerprint")
        # The columns and their types count as a bucket of their own, without rows.
        shape = F.sha2(F.lit(t.rows.schema.simpleString()), 256)
        own = own.unionByName(t.rows.sparkSession.range(1).select(F.lit(name).alias("table"), F.lit(-1).alias(BUCKET), F.lit(0).cast("long").alias("n"), shape.alias("fingerprint")))
        found.append(own)
    return reduce(lambda a, b: a.unionByName(b), found)


def publish(tables: dict[str, Table], path: str, verify: Callable[[DataFrame], None] | None = None, force: bool = False) -> Outcome:
    """Makes the tables the current version at `path`.

    Equal tables are left as they are. A table that would lose more than its `loss` of the current version's rows is
    refused, unless forced, and so is one that goes missing. Only buckets with other rows are written, which are then read
    back; `verify` may look at the new manifest and raise. Only then does the version become the current one. The
    manifest is made of buckets, so that what the driver sees doesn't grow with the rows.
    """
    spark = next(iter(tables.values())).rows.sparkSession
    known = versions(spark, path)
    version = uuid.uuid4().hex
    new = {(r["table"], r[BUCKET]): (r["n"], r["fingerprint"]) for r in _planned(tables).collect()}  # a row a bucket
    old = {(r["table"], r[BUCKET]): (r["n"], r["fingerprint"], r["version"]) for r in manifest(spark, path).collect()} if known else {}
    buckets = len([b for _, b in new if b >= 0])
    if known and new == {k: v[:2] for k, v in old.items()}:
        return Outcome("unchanged", known[-1], 0, buckets)
    count = lambda rows, name: sum(v[0] for (table, _), v in rows.items() if table == name)
    for name in {table for table, _ in old} if not force else ():
        t = tables.get(name)
        if t is None or (t.loss is not None and not guard_loss(count(old, name), count(new, name), t.loss)):
            return Outcome("refused", known[-1], 0, buckets)

    plan, wrote = {}, 0
    for name, t in tables.items():
        own = {b: v for (table, b), v in new.items() if table == name}
        kept = {b: old[name, b][2] for b, v in own.items() if old.get((name, b), ())[:2] == v}
        if -1 not in kept or len(set(kept.values())) >= FOLDERS:
            kept = {}  # other columns, or too many folders: all buckets anew
        fresh = sorted(set(own) - set(kept))
        plan |= {(name, b): kept.get(b, version) for b in own}
        if fresh:
            plan[name, -1] = version  # any folder shows the columns; older ones can go when no bucket needs them
        if fresh:
            where, home = bucket_of(t.key, t.buckets), f"{path}/data/{name}/{version}"
            rows = t.rows.withColumn(BUCKET, where).where(F.col(BUCKET).isin(fresh))
            # An empty table has no bucket, but its columns must be readable: its file lies in that of the shape.
            if fresh == [-1]:
                rows = t.rows.limit(0).withColumn(BUCKET, F.lit(-1))
                rows.drop(BUCKET).write.parquet(f"{home}/{BUCKET}=-1")
            else:
                rows = rows.repartition(BUCKET)
                if t.order:
                    rows = rows.sortWithinPartitions(BUCKET, *t.order)
                rows.write.partitionBy(BUCKET).parquet(home)
                back = spark.read.schema(StructType([*t.rows.schema, StructField(BUCKET, IntegerType())])).parquet(home)
                found = {r[BUCKET]: (r["n"], r["fingerprint"]) for r in fingerprints(back, F.col(BUCKET), t.rows.columns).collect()}
                if found != {b: own[b] for b in fresh if b >= 0}:
                    raise RuntimeError(f"{name}: what was written differs from what was planned; its rows may depend on when they are read")
        wrote += len([b for b in fresh if b >= 0])
    lines = [(name, b, *new[name, b], by) for (name, b), by in sorted(plan.items())]
    spark.createDataFrame(lines, "table string, bucket int, n long, fingerprint string, version string").coalesce(1).write.parquet(f"{path}/manifests/{version}")
    if verify:
        verify(spark.read.parquet(f"{path}/manifests/{version}"))
    number = 1 + max([int(n) for n, _, _ in (x.partition("-") for x in _names(spark, f"{path}/current")) if n.isdigit()], default=0)
    system, marker = _files(spark, f"{path}/current/{number}-{version}")
    system.createNewFile(marker)
    return Outcome("published", version, wrote, buckets)
