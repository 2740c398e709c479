"""Language by the nearest of several centroids of each language.

A document is its hashed n-grams of letters, damped, weighed by rarity over all documents that may teach, and normalised.
The documents of a language in a bounded sample are clustered by cosine, since one language has several kinds of text.
A document takes the language of its nearest centroid, and is rejected where it is farther from it than nearly all of the
sample's documents are from theirs.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import fresh, small_batches, text_chunks

#: Documents that the centroids are made of, at most; as many of each language.
SAMPLE = 4096
FEATURES = 1 << 13
GRAMS = (2, 3, 4)
CENTROIDS = 4
ROUNDS = 12
SHARPNESS = 20.0
#: Share of a centroid's own documents that may lie farther from it than a document that isn't rejected.
STRAY = 0.01
UNKNOWN = "und"
_DOCS = 256

#: Blank for ASCII that is no letter.
_LETTER = np.full(256, 0x20, dtype=np.uint8)
for _a, _b in ((0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _LETTER[_a:_b] = np.arange(_a, _b)


def _lowered(batch):
    """The batch with its texts in lower case."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return batch.set_column(batch.schema.names.index("text"), "text", pc.utf8_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), "")))


def profiles(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each document: square roots of the counts of its hashed n-grams, where runs of other characters are one blank."""
    letters = _LETTER[data]
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] != 0x20) | (letters[:-1] != 0x20)
    # A text's own blank stays in front of it, so that first words look like the others.
    begin = np.r_[0, np.cumsum(keep)][at]
    x = np.r_[np.uint8(0x20), letters[keep]].astype(np.uint32)
    n, cells = len(at) - 1, np.zeros(0, dtype=np.int64)
    of = np.repeat(np.arange(n), np.diff(begin))
    parts = []
    code = x[:-1]
    for k in range(2, max(GRAMS) + 1):
        code = code[: len(x) - k + 1] * np.uint32(0x01000193) + x[k - 1 :]
        if k in GRAMS:
            # The gram from byte i - 1 to i + k - 2 of the texts belongs to the text of byte i, if it ends there too.
            own = of[: len(code)]
            inside = np.arange(k - 1, len(code) + k - 1) <= begin[own + 1]
            hashed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k) >> np.uint32(19)
            parts.append(own[inside] * FEATURES + hashed[inside])
    cells = np.concatenate(parts) if parts else cells
    return np.sqrt(np.bincount(cells, minlength=n * FEATURES).astype(np.float32)).reshape(n, FEATURES)


def _pieces(batch):
    """Slices of a lower-cased batch with their profiles, of at most _DOCS documents."""
    for part, data, at in text_chunks(_lowered(batch)):
        for d in range(0, len(part), _DOCS):
            own = at[d : d + _DOCS + 1]
            yield part.slice(d, _DOCS), profiles(data[own[0] : own[-1]], own - own[0])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` normalised centroids of normalised rows: each start is the row farthest from those before, then rounds of nearest and mean."""
    start = [int(np.argmax(x @ x.mean(axis=0)))]
    near = x @ x[start[0]]
    while len(start) < most and near.min() < 1 - 1e-6:
        start.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[start[-1]])
    centroids = x[start]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        filled = np.bincount(own, minlength=len(centroids)) > 0
        new = np.where(filled[:, None], unit(sums), centroids)
        if np.allclose(new, centroids, atol=1e-6):
            break
        centroids = new
    return centroids


@dataclass
class Centroids:
    languages: list[str]
    rarity: np.ndarray
    vectors: np.ndarray
    #: Of each centroid: the index of its language, and the cosine below which a document is rejected.
    language: np.ndarray
    least: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, languages: list[str], rarity: np.ndarray, most: int = CENTROIDS) -> Centroids:
        """x: profiles of the sample, languages: theirs."""
        names, x = sorted(set(languages)), unit(x * rarity)
        y = np.searchsorted(names, languages) if names else np.zeros(0, dtype=np.int64)
        vectors, language, least = [], [], []
        for i in range(len(names)):
            own = x[y == i]
            centres = cluster(own, most)
            cosine = own @ centres.T
            nearest = np.argmax(cosine, axis=1)
            vectors.append(centres)
            for c in range(len(centres)):
                language.append(i)
                least.append(float(np.quantile(cosine[nearest == c, c], STRAY)) if (nearest == c).any() else 1.0)
        return cls(names, rarity, np.concatenate(vectors) if vectors else np.zeros((0, FEATURES), dtype=np.float32), np.array(language, dtype=np.int64), np.array(least))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language of the nearest centroid, a score from 0 to 1, the cosine, and whether it is too small."""
        cosine = np.round(np.clip((unit(x * self.rarity) @ self.vectors.T).astype(np.float64), 0, 1), 5)
        best = np.argmax(cosine, axis=1)
        top = cosine[np.arange(len(x)), best]
        by = np.stack([cosine[:, self.language == i].max(axis=1) for i in range(len(self.languages))], axis=1)
        score = 1 / np.exp(SHARPNESS * (by - top[:, None])).sum(axis=1)
        return self.language[best], score, top, top < self.least[best]


def _counted(batches):
    """How many documents have each feature, and (feature -1) how many there are."""
    import pyarrow as pa

    df, documents = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for part, x in _pieces(batch):
            df, documents = df + (x > 0).sum(axis=0), documents + len(part)
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[seen, -1].astype(np.int64)), pa.array(np.r_[df[seen], documents].astype(np.int64))], ["feature", "n"])


def _fitted(rarity, most: int):
    def fit(batches):
        import pyarrow as pa

        y, x = [], [np.zeros((0, FEATURES), dtype=np.float32)]
        for batch in batches:
            for part, own in _pieces(batch):
                y += part.column("lang").to_pylist()
                x.append(own)
        x = np.concatenate(x)
        # An order of their own, so that the centroids don't depend on how rows arrive.
        order = sorted(range(len(y)), key=lambda i: (y[i], x[i].tobytes()))
        model = Centroids.fit(x[order], [y[i] for i in order], rarity.value, most)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    return fit


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; such rows never teach. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, most: int = SAMPLE, centroids: int = CENTROIDS, seed: int = 7) -> Centroids:
    """Learns from the rows of `docs` (doc_id, text, lang) with a lang and a letter that aren't held out: rarities from all of them, centroids from at most `most`.

    As many of each language are chosen where there are enough, by a seeded hash of id and text. The model, which grows
    with the number of languages alone, is made in one task and comes to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r["feature"]: r["n"] for r in rows.select("text").mapInArrow(_counted, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    documents, df = counts.pop(-1, 0), np.zeros(FEATURES)
    df[list(counts)] = list(counts.values())
    rarity = spark.sparkContext.broadcast((np.log((1 + documents) / (1 + df)) + 1).astype(np.float32))

    languages = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    each = max(1, most // max(1, languages.count()))
    # About twice as many as are needed get past the hash, so that no task sorts all rows of a language.
    place = F.xxhash64(F.lit(seed), "doc_id", "text")
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 64) / F.col("n")) * 2.0**64 - 2.0**63
    drawn = rows.withColumn("place", place).join(F.broadcast(languages), "lang").where(F.col("place") <= share).drop("n")
    from pyspark.sql import Window as W

    order = W.partitionBy("lang").orderBy("place", "doc_id", "text")
    chosen = drawn.withColumn("k", F.row_number().over(order)).where(F.col("k") <= each).select("text", "lang")
    found = chosen.coalesce(1).mapInArrow(_fitted(rarity, centroids), "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else Centroids.fit(np.zeros((0, FEATURES), dtype=np.float32), [], rarity.value)


_RESULT = StructType([StructField("language", StringType()), StructField("score", DoubleType()), StructField("cosine", DoubleType()), StructField("rejected", BooleanType())])


def _identified(model, flag: str, out: str):
    def identify(batches):
        import pyarrow as pa

        own: Centroids = pickle.loads(model.value)
        for batch in batches:
            for part, x in _pieces(batch):
                lettered = part.column(flag).to_numpy(zero_copy_only=False)
                if own.languages:
                    language, score, cosine, far = own.nearest(x)
                else:
                    lettered, score, cosine, far = np.zeros(len(part), dtype=bool), np.zeros(len(part)), np.zeros(len(part)), np.ones(len(part), dtype=bool)
                    language = np.zeros(len(part), dtype=np.int64)
                names = pa.array([own.languages[i] if known else UNKNOWN for i, known in zip(language.tolist(), lettered.tolist(), strict=True)], pa.string())
                fields = {"language": names, "score": pa.array(np.where(lettered, score, 0.0)), "cosine": pa.array(np.where(lettered, cosine, 0.0)), "rejected": pa.array(far | ~lettered)}
                kept = [c for c in part.schema.names if c not in (flag, "text")]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.StructArray.from_arrays(list(fields.values()), list(fields))], [*kept, out])

    return identify


def identify(docs: DataFrame, model: Centroids, keep: tuple[str, ...] | list[str] = ("doc_id",), out: str = "language") -> DataFrame:
    """The columns `keep` of `docs` (text) and a struct `out`: language, score, cosine, rejected.

    language is that of the nearest centroid, `und` where the text is null or has no letter (score and cosine 0, rejected).
    score, 0 to 1, is higher the nearer it is than other languages; rejected says that the text is farther from the
    centroid than the model allows: a caller who wants no guess there drops those rows. Without learned languages all are
    `und`. An empty table gives no rows. The model that is broadcast grows with the number of languages alone.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    inner, flag = [f"c{i}" for i in range(len(keep))], "lettered"
    rows = docs.select(*[docs[c].alias(i) for c, i in zip(keep, inner, strict=True)], docs["text"].alias("text"), has_letter(docs["text"]).alias(flag))
    if fresh(out, list(keep)) != out:
        raise ValueError(f"{out} is a column already")
    done = rows.mapInArrow(_identified(shared, flag, "found"), StructType([*[f for f in rows.schema if f.name in inner], StructField("found", _RESULT)]))
    return done.select(*[F.col(i).alias(c) for c, i in zip(keep, inner, strict=True)], F.col("found").alias(out))


def language_id(docs: DataFrame, most: int = SAMPLE, centroids: int = CENTROIDS) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, lang_pred, score, rejected.

    Learns from `docs` itself, as `fit` says, and predicts from the text alone, as `identify` says. Repeated rows are
    predicted alike; a null doc_id counts as held out; columns of other names play no part.
    """
    found = identify(docs, fit(docs, most, centroids))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.language").alias("lang_pred"), "language.score", "language.rejected")
