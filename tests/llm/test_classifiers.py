"""Classifiers: held-out accuracy, and odd input."""

import zlib

import numpy as np
import pytest

from scorelake.llm import toxicity as toxic
from scorelake.llm.quality import NEIGHBOURS, SHARPNESS, Voters, features, fit, quality
from scorelake.llm.toxicity import FILTERS, Network, balanced_threshold, calibrate, toxicity


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet")


def area(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


@pytest.mark.parametrize(("operator", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(docs, labels, operator, label):
    out = operator(docs, labels)
    rows = out.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    score, predicted, y = (np.array([r[c] for r in rows]) for c in ("score", "predicted", label))
    assert out.count() == docs.count() and ((score >= 0) & (score <= 1)).all()
    assert area(score, y) > 0.97
    assert predicted[y == 1].mean() > 0.9 and predicted[y == 0].mean() < 0.1


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows(spark, odd, empty, operator):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9, 80)] + [(None, 1, 1), (9, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    out = operator(odd, labels)
    rows = {(r["doc_id"], r["held_out"], r["predicted"]) for r in out.collect()}
    assert out.count() == odd.count()
    assert all(h == (i is None or zlib.crc32(str(i).encode()) % 5 == 0) for i, h, _ in rows)
    assert operator(empty, labels).count() == 0
    assert operator(odd, labels.limit(0)).count() == odd.count()
    again = operator(odd.withColumn("lang", odd["source"]).repartition(3), labels)
    scores = [np.array(sorted((r["doc_id"] or -1, r["score"]) for r in x.collect())) for x in (again, out)]
    assert np.allclose(scores[0], scores[1], atol=1e-6)


def test_maxima_stay_inside_documents():
    network = Network.new()
    tables = network.tables()
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 1000, (n, 2)) for n in (0, 1, 2, 3, 9, 0, 40, 1, 0)]
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    look = lambda x, k, t: tables[k][t][x[:, 0]] + tables[k][t][x[:, 1]]
    for k, (top, _) in enumerate(network.maxima(np.concatenate(docs), first, look)):
        w = FILTERS[k][0]
        for d, x in enumerate(docs):
            own = [sum(tables[k][t][x[i + t]].sum(axis=0) for t in range(w)) for i in range(len(x) - w + 1)]
            assert np.allclose(top[d], np.max(own, axis=0) if own else 0, atol=1e-4)


def test_thresholds():
    assert balanced_threshold(np.array([0.1, 0.2, 0.3, 0.8, 0.9]), np.array([0, 0, 0, 1, 1])) == pytest.approx(0.55)
    assert calibrate(np.array([0.0, 0.2, 0.6, 1.0]), 0.2).tolist() == pytest.approx([0, 0.5, 0.75, 1])


def test_trigrams_are_told_apart_by_2048_terms():
    data = np.random.default_rng(0).integers(97, 123, 20000).astype(np.uint8)
    data[-1] = 32
    x = features(data, np.array([0, len(data)]))
    assert (x[0, :-4] > 0).sum() > 1900


def test_only_the_model_comes_to_the_driver(docs, labels, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(out := collect(self)) or out)
    voters = fit(docs, labels)
    assert len(voters.vectors) > 1000 and [len(rows) for rows in seen] == [1]


def joined(texts):
    parts = [t.encode() + b" " for t in texts]
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])]


def test_features_are_a_document_s_own():
    texts = ["one", "two three", "", "a", "x y x y", " \n", "ab", "one"]
    together = features(*joined(texts))
    assert np.array_equal(together, np.concatenate([features(*joined([t])) for t in texts]))
    assert not together[2].any() and together[0].any()


def test_votes_by_brute_force():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(size=(120, 30)))
    x[40:60] = x[7]  # ties at the last neighbour
    y = rng.integers(0, 2, 120).astype(float)
    voters = Voters.fit(x, y)
    asked = np.concatenate([np.abs(rng.normal(size=(40, 30))), x[:8]])
    latent = asked @ voters.basis
    latent /= np.linalg.norm(latent, axis=1, keepdims=True)
    expected = []
    for row in latent:
        cosine = [round(float(row @ v), 9) for v in voters.vectors]
        last = sorted(cosine)[-NEIGHBOURS]
        votes = [(np.exp(SHARPNESS * (c - max(cosine))), label) for c, label in zip(cosine, y) if c >= last]
        expected.append(sum(w * label for w, label in votes) / sum(w for w, _ in votes))
    assert np.allclose(voters.scores(asked), expected, atol=1e-9)
    assert np.allclose(voters.scores(asked), np.concatenate([voters.scores(asked[i : i + 1]) for i in range(len(asked))]), atol=1e-9)


def test_scores_by_a_plain_forward_pass():
    network, rng = Network.new(), np.random.default_rng(2)
    docs = [rng.integers(0, 1000, (n, 2)) for n in (0, 1, 2, 5, 30)]
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    got = network.scores(np.concatenate(docs), first, network.tables())
    for d, x in enumerate(docs):
        vectors = network.embedding[x[:, 0]] + network.embedding[x[:, 1]]
        hidden = []
        for (w, n), tap, bias in zip(FILTERS, network.taps, network.bias, strict=True):
            for f in range(n):
                places = [sum(float(vectors[i + t] @ tap[t, :, f]) for t in range(w)) for i in range(len(x) - w + 1)]
                hidden.append(max((max(places) if places else 0) + bias[f], 0))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-(np.dot(hidden, network.out) + network.shift))), abs=1e-5)


def test_training_follows_the_gradient(monkeypatch):
    """One batch without noise: the loss falls, from a start that knows nothing of the labels."""
    monkeypatch.setattr(toxic, "DROPPED", 0.0)
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 400, (rng.integers(3, 40), 2)) for _ in range(60)]
    y = np.array([float(any(d[:, 0] % 50 == 7)) for d in docs], dtype=np.float32)

    def loss(epochs):
        network = Network.new()
        network.train(docs, y, epochs=epochs)
        score = np.concatenate([network.scores(d, np.array([0, len(d)]), network.tables()) for d in docs])
        return -np.mean(y * np.log(score + 1e-9) + (1 - y) * np.log(1 - score + 1e-9))

    assert loss(40) < 0.2 * loss(0)


def test_word_hashes_part_patterns():
    """Polynomials modulo 2**64 give a Thue-Morse word and its complement one hash."""
    from scorelake.llm.common import word_hashes

    bits = [bin(i).count("1") % 2 for i in range(2048)]
    words = [bytes(97 + b for b in bits), bytes(98 - b for b in bits), b"ab", b"ab\0", b"abcdefgh", b"abcdefgh\0", b"abcdefghijklmnop", b"abcdefghijklmnopq"]
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    ends = np.cumsum([len(w) for w in words])
    found = [word_hashes(data, ends - [len(w) for w in words], ends, seed) for seed in (0, 1)]
    assert all(len(set(x.tolist())) == len(words) for x in found) and not set(found[0].tolist()) & set(found[1].tolist())
    again = word_hashes(np.frombuffer(b"xx" + words[4] + b"yy", dtype=np.uint8), np.array([2]), np.array([10]))
    assert again[0] == found[0][4]
