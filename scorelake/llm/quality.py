"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A document is the square roots of its shares of hashed byte trigrams, weighed by rarity, with a few terms for words
that repeat. A truncated SVD of the labelled sample gives the latent space. Every document is compared with every
labelled vector by cosine, in blocks, and the labels of the nearest are weighed by similarity.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import held_out, small_batches, split_words, text_chunks, word_hashes
from .labelled import sample

#: Labelled documents to learn from at most.
SAMPLE = 4096
TERMS = 2048
REPEATS = 4
DIMENSIONS = 48
NEIGHBOURS = 32
SHARPNESS = 12.0
THRESHOLD = 0.3
BLOCK = 512


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each document: square roots of the shares of its hashed trigrams, and of words equal to the last, second last ... word."""
    data, starts, ends, first = split_words(data, at)
    n = len(first) - 1
    begin = np.r_[starts, len(data)][first]
    x = data.astype(np.uint32)
    code = x[:-2] + x[1:-1] * np.uint32(257) + x[2:] * np.uint32(66049) if len(x) > 2 else x[:0]
    code = (code * np.uint32(2654435761)) >> np.uint32(21)
    doc = np.repeat(np.arange(n), np.diff(begin))[: len(code)]
    # A trigram that reaches into the next document is nobody's.
    inside = np.arange(2, len(code) + 2) < begin[doc + 1]
    out = np.zeros((n, TERMS + REPEATS), dtype=np.float32)
    out[:, :TERMS] = np.bincount(doc[inside] * TERMS + code[inside], minlength=n * TERMS).reshape(n, TERMS)
    out[:, :TERMS] /= np.maximum(out[:, :TERMS].sum(axis=1, keepdims=True), 1)
    word = word_hashes(data, starts, ends)
    of = np.repeat(np.arange(n), np.diff(first))
    for lag in range(1, REPEATS + 1):
        same = of[lag:][(word[lag:] == word[:-lag]) & (of[lag:] == of[:-lag])]
        out[:, TERMS + lag - 1] = np.bincount(same, minlength=n) / np.maximum(np.diff(first), 1)
    return np.sqrt(out)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


@dataclass
class Voters:
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Voters:
        """x: features of the labelled sample, y: their labels."""
        rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
        _, vectors = np.linalg.eigh(((x * rarity).T @ (x * rarity)).astype(np.float64))
        basis = rarity[:, None] * vectors[:, ::-1][:, :DIMENSIONS]
        return cls(basis, _unit(x @ basis), y.astype(np.float64))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The mean label of the nearest, weighed by exp(sharpness * (cosine - nearest cosine)); all that are as near as the last of the nearest vote.

        Cosines are rounded to nine digits, below which they depend on the other documents of a block.
        """
        if not len(self.labels):
            return np.full(len(x), 0.5)
        k, out = min(NEIGHBOURS, len(self.labels)), []
        for i in range(0, len(x), BLOCK):
            cosine = np.round(_unit(x[i : i + BLOCK] @ self.basis) @ self.vectors.T, 9)
            last = np.partition(cosine, -k, axis=1)[:, -k]
            doc, voter = np.nonzero(cosine >= last[:, None])
            weight = np.exp(SHARPNESS * (cosine[doc, voter] - cosine.max(axis=1)[doc]))
            out.append(np.bincount(doc, weight * self.labels[voter]) / np.bincount(doc, weight))
        return np.concatenate(out) if out else np.zeros(0)


def _fitted(batches):
    """One pickled model of all rows of a task."""
    import pyarrow as pa

    y, x = [], []
    for batch in batches:
        for part, data, at in text_chunks(batch):
            y.append(part.column("y").to_numpy(zero_copy_only=False))
            x.append(features(data, at))
    model = _model(np.concatenate(y), np.concatenate(x)) if y else _model(np.zeros(0), np.zeros((0, TERMS + REPEATS), dtype=np.float32))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])


def _model(y: np.ndarray, x: np.ndarray) -> Voters:
    """The model of the rows in an order of their own, so that it doesn't depend on how they arrive."""
    order = sorted(range(len(y)), key=lambda i: (y[i], x[i].tobytes()))
    return Voters.fit(x[order], y[order].astype(np.float32))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Voters:
    """Learns from at most `most` labelled documents that aren't held out, in one task; only the model comes to the driver."""
    small_batches(docs.sparkSession)
    found = sample(docs, labels, label, most).coalesce(1).mapInArrow(_fitted, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else _model(np.zeros(0), np.zeros((0, TERMS + REPEATS), dtype=np.float32))


def _scored(model, out: str):
    def score(batches):
        import pyarrow as pa

        voters = pickle.loads(model.value)
        for batch in batches:
            for part, data, at in text_chunks(batch):
                found = voters.scores(features(data, at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], [*part.schema.names, out])

    return score


def score(docs: DataFrame, voters: Voters, keep: list[str], out: str = "score") -> DataFrame:
    """The columns `keep` of `docs` and the score as column `out`, a name that `docs` doesn't have. What is broadcast is bounded by the size of the sample."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(pickle.dumps(voters))
    rows = docs.select(*[docs[c].alias(c) for c in dict.fromkeys([*keep, "text"])])
    scored = rows.mapInArrow(_scored(model, out), StructType([*rows.schema, StructField(out, DoubleType())]))
    return scored.select(*[scored[c] for c in keep], out)


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, held_out, score, predicted.

    score, 0 to 1, is higher where label 1 is likelier; predicted is 1 from `threshold` on. Null and empty texts are
    scored like any other, as texts without terms. Without usable labels every score is 0.5. Repeated rows are
    scored alike; a null doc_id counts as held out. An empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels, label), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
