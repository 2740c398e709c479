"""A training corpus from `documents`: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import line_dedup as lines
from scorelake.llm import mixing, packing, quality, simhash
from scorelake.llm.common import WORD, fresh, new_path, written
from scorelake.llm.queries import VOCABULARY


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    voters = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("score", docs.columns)
    scored = quality.score(docs, voters, docs.columns, score)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their later copies of repeated lines; n_chars follows the text."""
    about = fresh("line_dedup", docs.columns)
    out = lines.line_dedup(docs, out=about).drop(about)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a number each, so that repeated rows and ids are told apart; and that column's name."""
    row = fresh("row", docs.columns)
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest doc_id, rows without an id last. Repeated rows are copies of each other."""
    rows, row = _numbered(docs)
    groups = simhash.near_groups(rows, rows[row])
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    stay = first.select(F.col("first.row").alias(fresh("stay", rows.columns)))
    return rows.join(stay, rows[row] == stay[stay.columns[0]], "left_semi").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: whole copies, and the first words of one that is taken in part."""
    rows, row = _numbered(docs)
    taken = mixing.mix(rows, row=rows[row]).where("taken > 0").select(F.col("row").alias("_row"), F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    both = rows.select(F.col(row).alias("_row"), F.struct(*docs.columns).alias("_doc")).join(taken, "_row")
    both = both.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / F.col("_size")))))
    words = F.least("_size", F.col("_taken") - (F.col("_copy") - 1) * F.col("_size")).cast("int")
    part = F.array_join(F.slice(F.regexp_extract_all("_doc.text", F.lit(f"({WORD})")), F.lit(1), words), " ")
    both = both.withColumn("_text", F.when(words < F.col("_size"), part).otherwise(F.col("_doc.text")))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return both.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs, VOCABULARY)


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Trained scores, fingerprints and token ids are beyond SQL; tests hold each stage's rows against plain loops over its input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
