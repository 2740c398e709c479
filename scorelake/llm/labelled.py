"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, y) and the columns `keep` of at most `most` labelled documents, as many of each label where there are enough.

    Only rows that aren't held out take part, chosen by a seeded hash of their id. Of several labels of a document the
    largest counts; null labels don't. The chosen ids, `most` at most, are broadcast, so that texts are not shuffled.
    A doc_id with several rows in `docs` gives all of them (at most `most` in all).
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    drawn = [known.where(F.col("y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most // 2) for y in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1]).withColumnRenamed("doc_id", "_id")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), *[docs[c].alias(c) for c in keep])
    return rows.join(F.broadcast(chosen), rows["doc_id"] == chosen["_id"]).select("doc_id", "text", "y", *keep).orderBy(F.xxhash64(F.lit(seed), "doc_id", "text")).limit(most)
