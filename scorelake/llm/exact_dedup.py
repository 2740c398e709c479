"""Exact dedup against a persistent digest index, bucketed and sorted by hash. DataFrame operations only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, join_groups, shuffle_partitions, written


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    text = ascii_lower(F.coalesce(docs["text"], F.lit("")))
    return docs.select(docs["doc_id"].alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """A table (digest, keep_id), one row for each digest ever added, bucketed and sorted by digest.

    A later batch is deduplicated against it by a sort-merge anti-join, for which the index itself is not
    shuffled, and what is new is appended. The index outlives the session when `path` names a folder, which then holds
    the rows and the number of buckets. An index that is opened again keeps its number of buckets: asking for another
    is an error, since rows would be looked for in the wrong bucket.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        known = self._known(path)
        if known and buckets and known != buckets:
            raise ValueError(f"the index has {known} buckets, not {buckets}")
        self.buckets = known or buckets or shuffle_partitions(spark)
        where = f"LOCATION '{path}/digests'" if path else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS {where}"
        )
        if path and not known:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")

    def _known(self, path: str | None) -> int | None:
        """The number of buckets of the index where there is one already."""
        if self.spark.catalog.tableExists(self.name):
            about = {r["col_name"]: r["data_type"] for r in self.spark.sql(f"DESCRIBE FORMATTED {self.name}").collect()}
            return int(about["Num Buckets"])
        if path:
            layout = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/layout")
            if layout.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(layout):
                return self.spark.read.parquet(f"{path}/layout").first()["buckets"]
        return None

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of `groups` (digest, keep_id) whose digest the index doesn't have."""
        return groups.join(self.table().hint("merge"), "digest", "left_anti")

    def add(self, groups: DataFrame) -> None:
        """Appends the groups that are new. Of a digest that is known, the old row stays."""
        new = self.unseen(groups).select("digest", "keep_id")
        (
            new.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the largest doc_id stays; texts
    already in the index are all dropped in favour of the indexed document. group_size counts the rows of `docs` with
    the text. A repeated row with the kept doc_id is kept as well. A null doc_id stays only if no row of its group has
    an id (keep_id is then null). An empty table gives no rows. Other columns are ignored, whatever their names.

    The rows are added in `batches` ranges of ids, the largest ids first, so that what stays is in the index before its
    copies are. Without an index of the caller's, one is made and dropped again.
    """
    own = index is None
    index = DigestIndex(docs.sparkSession) if own else index
    rows = written(digests(docs), "digests")
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("doc_id").cast("double"), F.max("doc_id").cast("double")).first()
    width = ((high or 0) - (low or 0)) / batches
    batch = F.least(F.floor((F.lit(high) - F.col("doc_id").cast("double")) / width), F.lit(batches - 1)) if width else F.lit(batches - 1)
    batch = F.coalesce(batch, F.lit(batches - 1)).cast("int")
    # Written first: pushed below the aggregate, the anti-join would send every row of a hot digest to one task.
    groups = rows.groupBy("digest", batch.alias("batch")).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    groups = written(groups, "digest-groups")
    for b in range(batches):
        index.add(groups.where(F.col("batch") == b))
    sizes = groups.groupBy("digest").agg(F.sum("n").alias("group_size"))
    named = written(sizes.join(index.table().hint("merge"), "digest"), "digest-names")
    out = join_groups(rows, named, ["digest"], "group_size", n)
    if own:
        out = written(out, "digest-results")
        index.drop()
        discard(rows, groups, named)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
