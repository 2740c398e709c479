"""Toxicity by a convolutional text classifier, trained in numpy.

Words (runs of letters, lower-cased) have an embedding that is the sum of two hashed ones, of the whole word and of its
first letters. Filters of several widths run over a document's words, each keeps its maximum over the whole text, and
a logistic layer weighs the maxima. All of it begins at random and is trained together. The embedding of a word times each
filter's taps is a table, so that a document of n words costs n look-ups and additions. Training follows the gradient only
through the words that hold a maximum, and runs in one task on the words of the sample; the driver gets the network.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, small_batches, text_chunks, word_hashes, word_spans
from .labelled import sample

#: Labelled documents to learn from at most.
SAMPLE = 4096
BUCKETS = 1 << 16
WIDTH = 12
FILTERS = ((1, 8), (2, 6), (3, 6))
PREFIX = 4
EPOCHS = 12
RATE = 0.01
#: Share of words left out of a document at each training step.
DROPPED = 0.3
#: How far the labels' weights are evened out: 0 not at all, 1 fully.
BALANCE = 0.5
BATCH = 64
THRESHOLD = 0.5

_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket numbers for each word (of the word; of its first letters, behind the others), and each document's first word."""
    data = _LETTERS[data]
    starts, ends = word_spans(data)
    whole = (word_hashes(data, starts, ends) >> np.uint64(40)).astype(np.int64) % BUCKETS
    begin = (word_hashes(data, starts, np.minimum(ends, starts + PREFIX), 1) >> np.uint64(40)).astype(np.int64) % BUCKETS
    return np.stack([whole, begin + BUCKETS], axis=1).astype(np.int32), np.searchsorted(starts, at)


@dataclass
class Network:
    embedding: np.ndarray
    taps: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float = 0.0
    #: Score thresholds by language, which the operator reports beside the one for all.
    thresholds: dict = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        taps = [rng.normal(0, 0.5, (w, WIDTH, n)).astype(np.float32) for w, n in FILTERS]
        total = sum(n for _, n in FILTERS)
        return cls((rng.normal(0, 0.02, (2 * BUCKETS, WIDTH))).astype(np.float32), taps, [np.zeros(n, dtype=np.float32) for _, n in FILTERS], rng.normal(0.5, 0.2, total).astype(np.float32) * np.where(np.arange(total) % 2, -1, 1).astype(np.float32), -0.5)

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embedding @ tap for tap in width] for width in self.taps]

    def maxima(self, words: np.ndarray, first: np.ndarray, look) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each width: every filter's maximum in each document, and the responses. look(words, width, tap) gives a tap's part."""
        found = []
        n = np.diff(first)
        for k, (w, filters) in enumerate(FILTERS):
            top = np.zeros((len(n), filters), dtype=np.float32)
            has = n >= w
            if has.any():
                last = len(words) - w + 1
                response = look(words[:last], k, 0)
                for t in range(1, w):
                    response += look(words[t : last + t], k, t)
                # Windows that cross into the next document don't count.
                end = first[1:][has] - w + 1
                edges = np.stack([first[:-1][has], end], axis=1).ravel()
                top[has] = np.maximum.reduceat(np.vstack([response, np.full((1, filters), -np.inf, dtype=np.float32)]), np.minimum(edges, len(response)))[::2]
                found.append((top, response))
            else:
                found.append((top, np.zeros((0, filters), dtype=np.float32)))
        return found

    def scores(self, words: np.ndarray, first: np.ndarray, tables) -> np.ndarray:
        look = lambda x, k, t: tables[k][t][x[:, 0]] + tables[k][t][x[:, 1]]
        tops = [np.maximum(top + b, 0) for (top, _), b in zip(self.maxima(words, first, look), self.bias, strict=True)]
        z = np.concatenate(tops, axis=1) @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def train(self, docs: list[np.ndarray], y: np.ndarray, seed: int = 5, rate: float = RATE, epochs: int = EPOCHS) -> None:
        """docs: the words of each document. Adam for the dense layers, Adagrad for the embeddings that take part.

        A share of the words is left out at random each time, so that a filter can't lean on a single one; documents of
        the rarer label weigh as much as the others.
        """
        rng = np.random.default_rng(seed)
        dense = [*self.taps, *self.bias, self.out]
        m, v, step = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense], 0
        shift_m = shift_v = 0.0
        seen = np.full(len(self.embedding), 1e-3, dtype=np.float32)
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** BALANCE
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
                own_words = [docs[i][rng.random(len(docs[i])) >= DROPPED] for i in batch]
                words = np.concatenate(own_words) if own_words else np.zeros((0, 2), dtype=np.int32)
                first = np.r_[0, np.cumsum([len(d) for d in own_words])]
                buckets, inverse = np.unique(words, return_inverse=True)
                inverse, rows = inverse.reshape(words.shape), self.embedding[buckets]
                tables = [[rows @ tap for tap in width] for width in self.taps]
                found = self.maxima(inverse, first, lambda x, k, t, tables=tables: tables[k][t][x[:, 0]] + tables[k][t][x[:, 1]])
                active = [np.maximum(top + b, 0) for (top, _), b in zip(found, self.bias, strict=True)]
                hidden = np.concatenate(active, axis=1)
                error = weight[batch] * (1 / (1 + np.exp(-np.clip(hidden @ self.out + self.shift, -30, 30))) - y[batch]) / len(batch)
                back = np.outer(error, self.out) * (hidden > 0)
                grads, bias_grads, at = [], [], 0
                g_rows = np.zeros_like(rows)
                for (w, filters), (top, response), tap in zip(FILTERS, found, self.taps, strict=True):
                    own = back[:, at : at + filters]
                    at += filters
                    g = np.zeros_like(tap)
                    place, d, f = holders(top, response, first, w)
                    share = own[d, f].astype(np.float32)[:, None]
                    for t in range(w):
                        pair = inverse[place + t]
                        np.add.at(g[t].T, f, share * (rows[pair[:, 0]] + rows[pair[:, 1]]))
                        change = share * tap[t][:, f].T
                        np.add.at(g_rows, pair[:, 0], change)
                        np.add.at(g_rows, pair[:, 1], change)
                    grads.append(g)
                    bias_grads.append(own.sum(axis=0))
                step += 1
                for p, g, a, b in zip(dense, [*grads, *bias_grads, hidden.T @ error], m, v, strict=True):
                    g = g + 1e-4 * p
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
                shift_m += 0.1 * (error.sum() - shift_m)
                shift_v += 0.001 * (error.sum() ** 2 - shift_v)
                self.shift -= rate * (shift_m / (1 - 0.9**step)) / (np.sqrt(shift_v / (1 - 0.999**step)) + 1e-7)
                moved = np.flatnonzero(np.abs(g_rows).sum(axis=1))
                seen[buckets[moved]] += (g_rows[moved] ** 2).mean(axis=1)
                self.embedding[buckets[moved]] -= (5 * rate * g_rows[moved] / np.sqrt(seen[buckets[moved]])[:, None]).astype(np.float32)


def holders(top: np.ndarray, response: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each filter has its maximum in each document that is long enough: (word, document, filter), the foremost of equal places."""
    n = np.diff(first)
    long_ = np.flatnonzero(n >= width)
    windows = n[long_] - width + 1
    doc = np.repeat(long_, windows)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows) + first[doc]
    row, f = np.nonzero(response[at] == top[doc]) if len(at) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    _, one = np.unique(doc[row] * top.shape[1] + f, return_index=True)
    return at[row[one]], doc[row[one]], f[one]


def balanced_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The threshold that parts the two labels with the fewest errors, each label weighed alike; midway between scores."""
    if not (0 < y.sum() < len(y)):
        return THRESHOLD
    order = np.argsort(score)
    s, one = score[order], y[order] == 1
    missed = np.r_[0, np.cumsum(one)] / one.sum()
    false = (~one).sum() - np.r_[0, np.cumsum(~one)]
    cost = missed + false / (~one).sum()
    best = np.flatnonzero(cost == cost.min())
    edges = np.r_[0.0, (s[1:] + s[:-1]) / 2, 1.0]
    return float(np.median(edges[best]))


def calibrate(score: np.ndarray, middle: float) -> np.ndarray:
    """Scores mapped to 0..1 so that `middle` becomes 0.5 and the order stays."""
    middle = min(max(middle, 1e-6), 1 - 1e-6)
    return np.where(score < middle, 0.5 * score / middle, 0.5 + 0.5 * (score - middle) / (1 - middle))


def learn(docs: list[np.ndarray], y: np.ndarray, langs: list[str | None], seed: int = 3) -> tuple[Network, float]:
    """The words, labels and languages of the sample -> a network and its threshold, found on a fifth that it wasn't trained on; thresholds by language likewise."""
    part = np.random.default_rng(seed).permutation(len(docs)) % 5 == 0
    network = Network.new(seed)
    if not (0 < y[~part].sum() < (~part).sum()):
        return network, THRESHOLD
    network.train([d for d, p in zip(docs, part, strict=True) if not p], y[~part])
    tables = network.tables()
    score = np.concatenate([network.scores(d, np.array([0, len(d)]), tables) for d in docs])
    middle = balanced_threshold(score[part], y[part])
    for lang in set(langs):
        own = part & np.array([x == lang for x in langs])
        if 0 < y[own].sum() < own.sum():
            network.thresholds[lang] = float(calibrate(np.array([balanced_threshold(score[own], y[own])]), middle)[0])
    return network, middle


def _learned(batches):
    """One pickled network of all rows of a task, in an order of their own."""
    import pyarrow as pa

    rows = []
    for batch in batches:
        for part, data, at in text_chunks(batch):
            words, first = tokens(data, at)
            facts = zip(part.column("doc_id").to_pylist(), part.column("y").to_pylist(), part.column("lang").to_pylist(), strict=True)
            rows += [(i, y, lang, words[a:b].copy()) for (i, y, lang), a, b in zip(facts, first[:-1], first[1:], strict=True)]
    rows.sort(key=lambda r: (r[0], r[1], r[3].tobytes()))
    found = learn([r[3] for r in rows], np.array([r[1] for r in rows], dtype=np.float32), [r[2] for r in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE) -> bytes:
    """Learns from at most `most` labelled documents that aren't held out; the pickled network and its threshold. Languages serve the thresholds alone."""
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    rows = sample(docs, labels, label, most, keep=("lang",)).coalesce(1).mapInArrow(_learned, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else pickle.dumps((Network.new(), THRESHOLD))


def _scored(model):
    def score(batches):
        import pyarrow as pa

        network, middle = pickle.loads(model.value)
        tables = network.tables()
        for batch in batches:
            for part, data, at in text_chunks(batch, 1 << 19):
                out = calibrate(network.scores(*tokens(data, at), tables), middle)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out)], [*part.schema.names, "score"])

    return score


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang): doc_id, held_out, score, predicted, lang_threshold.

    score, 0 to 1, is higher where label 1 is likelier, and comes from the text alone. predicted is 1 from `threshold`
    on; lang_threshold is the score that parts the labels best in the row's language (null for a language without
    enough labels), for callers that want a decision by language. Null and empty texts score as texts without words.
    Without usable labels the network stays untrained. Repeated rows score alike; a null doc_id counts as held out. An
    empty table gives no rows. What is broadcast is the network, of fixed size.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    fitted = fit(docs, labels, label)
    network, _ = pickle.loads(fitted)
    model = spark.sparkContext.broadcast(fitted)
    lang = docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), lang.alias("lang"))
    scored = rows.mapInArrow(_scored(model), "doc_id long, text string, lang string, score double")
    by_lang = F.lit(None).cast("double")
    for name, x in sorted(network.thresholds.items(), key=str):
        by_lang = F.when(F.col("lang").eqNullSafe(F.lit(name)), F.lit(x)).otherwise(by_lang)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), by_lang.alias("lang_threshold"))
