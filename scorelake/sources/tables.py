"""Reading catalogues and publishing results."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import publishing

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read again: a short lineage for loops."""
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


#: Rows of small texts that one task reads with a Python helper, a few seconds of work.
ROWS_A_TASK = 20_000


def spread(df: DataFrame) -> DataFrame:
    """The rows in tasks of about ROWS_A_TASK, at least one for each core: a small file is one task, however dear its rows are to read.

    `df` is read twice, once to count it.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(tasks)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `settled` wrote and nothing reads any more."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def load_source(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    """A source with a declared schema; one that isn't there is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(form).load(path)


def write_if_changed(df: DataFrame, path: str, columns: list[str], loss: float | None = None) -> bool:
    """Publishes `columns` of `df` as the table `rows` at `path` unless it holds the same values already; whether it wrote.

    The rows are written once, before they are compared, so that both see the same. With `loss`, a table that would lose
    more than that share of its rows is refused.
    """
    rows = settled(df.select(*columns))
    try:
        return publishing.publish({"rows": publishing.Table(rows, columns[0], loss=loss)}, path).outcome == "published"
    finally:
        discard(rows)


def build_manifest(works: DataFrame, composers: DataFrame) -> DataFrame:
    """build (ten hex digits of what all columns of the tables hold), works, composers: the same data has the same build."""
    whole = F.lit(0)
    both = publishing.fingerprints(works, whole).withColumn("table", F.lit("works")).unionByName(publishing.fingerprints(composers, whole).withColumn("table", F.lit("composers")))
    numbers = both.agg(F.coalesce(F.max(F.when(F.col("table") == "works", F.col("n"))), F.lit(0)).alias("works"), F.coalesce(F.max(F.when(F.col("table") == "composers", F.col("n"))), F.lit(0)).alias("composers"))
    return publishing.build_of(both).join(numbers, F.lit(True))  # one row each


def publish_index(works: DataFrame, composers: DataFrame, statistics: DataFrame, path: str, buckets: int = publishing.BUCKETS, verify=None, force: bool = False) -> publishing.Outcome:
    """The merged index as a version at `path`: works without provenance by a bucket of the composer, composers in order of sort name, the statistics.

    A version that loses more than a fifth of the works or composers is refused.
    """
    return publishing.publish(
        {
            "works": publishing.Table(works.drop("src", "url"), "c", ("id",) if "id" in works.columns else (), buckets=buckets),
            "composers": publishing.Table(composers, "composer_id", (F.coalesce("sort", F.lit("zz")), "composer_id"), buckets=buckets),
            "statistics": publishing.Table(statistics, None, loss=None),
        }, path, verify, force,
    )


#: The columns of an export and what they show.
EXPORT = {
    "Composer": "composer", "Work": "t", "Catalogue": "cat", "Year": "y", "Genre": "g", "Trumpet-family scoring": "s", "Full instrumentation": "full", "Arrangement": "arr",
}


def export_matches(matches: DataFrame, composers: DataFrame, path: str) -> None:
    """All matches with their composers' names under the eight headings: every cell quoted, CRLF, each file with a byte order mark and a header."""
    named = matches.join(composers.select(F.col("composer_id").alias("c"), F.col("name").alias("composer")), "c", "left").withColumn("composer", F.coalesce("composer", F.lit("Unknown")))
    shown = dict(named.dtypes)
    cells = [F.when(F.col(c), "yes").otherwise("no") if shown[c] == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in EXPORT.values()]
    line = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in cells])
    header = "\ufeff" + ",".join(f'"{name}"' for name in EXPORT)
    # The low 33 bits of this id count the rows of a task, and a task writes a file.
    first = F.monotonically_increasing_id() % (1 << 33) == 0
    named.select(F.concat(F.when(first, header + "\r\n").otherwise(""), line).alias("value")).write.mode("overwrite").option("lineSep", "\r\n").text(path)
    if matches.sparkSession.read.text(path).isEmpty():
        matches.sparkSession.range(1).select(F.lit(header).alias("value")).coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def export_csv(matches: DataFrame, path: str) -> None:
    """All matches: every cell quoted, quotes doubled, CRLF, a header, yes and no for flags, nothing for null."""
    flat = [F.when(F.col(c), "yes").otherwise("no").alias(c) if t == "boolean" else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c, t in matches.dtypes]
    matches.select(*flat).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"', lineSep="\r\n", emptyValue="")


def export_list(matches: DataFrame, path: str) -> None:
    """A line for each work: [composer — ]title[, catalogue] — scoring."""
    matches.select(list_line()).write.mode("overwrite").text(path)


def list_line():
    named = F.when(F.col("cat").isNotNull(), F.concat_ws(", ", "t", "cat")).otherwise(F.col("t"))
    return F.concat_ws(" — ", "composer", named, "s").alias("line")


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What of `todo` isn't in `done`."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def _kept(spark: SparkSession, path: str, schema: StructType, key: str, buckets: int) -> str:
    """The name, in this session, of the table at `path`, which is bucketed and sorted by `key`."""
    where = f"{path.rstrip('/')}/{buckets}-buckets"
    name = f"kept_{hashlib.sha256(where.encode()).hexdigest()[:16]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{where}'")
    return name


def unseen(harvested: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """What of `harvested` the bucketed table doesn't hold, one row a key: of several that with the least text of all its columns.

    The table's rows stay where they are.
    """
    return harvested.join(kept.select(key), key, "left_anti").groupBy(key).agg(F.min_by(F.struct(*harvested.columns), publishing.row_text(harvested)).alias("_row")).select("_row.*")


def append_new(harvested: DataFrame, path: str, key: str, buckets: int = 16) -> DataFrame:
    """Appends what of `harvested` the table at `path` doesn't hold yet, and returns the table; one row a key."""
    spark = harvested.sparkSession
    name = _kept(spark, path, harvested.schema, key, buckets)
    try:
        unseen(harvested, spark.table(name), key).select(*harvested.columns).write.insertInto(name)
        spark.catalog.refreshTable(name)
        return spark.table(name).select("*")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the name alone: the files stay


def refresh_partition(df: DataFrame, path: str, source: str = "source") -> None:
    """Replaces the sources that `df` holds and leaves the others in the table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(source).parquet(path)
