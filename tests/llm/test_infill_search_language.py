"""Fill-in-the-middle, ranked lexical search and language identification against plain loops, and on odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import language, lexical
from scorelake.llm.infill import FIRST, FURTHER, OTHER, REST, Texts, WaveletMatrix, classes, infill, restore
from scorelake.llm.language import Centroids, cluster, identify, language_id, unit
from scorelake.llm.lexical import Block, search

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(texts):
    parts = [t.encode() for t in texts]
    begin = np.r_[0, np.cumsum([len(p) + 1 for p in parts])]
    return np.frombuffer(b"".join(p + b" " for p in parts), dtype=np.uint8), begin[:-1], begin[1:] - 1


def test_ranks_by_counting():
    rng = np.random.default_rng(0)
    for levels, n in ((1, 70), (2, 64), (3, 1000), (2, 0), (2, 1)):
        x = rng.integers(0, 1 << levels, n).astype(np.uint8)
        matrix, places = WaveletMatrix(x, levels), np.arange(n + 1)
        for s in range(1 << levels):
            assert matrix.rank(s, places).tolist() == [int((x[:i] == s).sum()) for i in places]


def test_classes():
    assert classes(np.frombuffer("a Bc1é日z\n".encode(), dtype=np.uint8)).tolist() == [FIRST, OTHER, FIRST, FURTHER, OTHER, OTHER, REST, OTHER, REST, REST, FIRST, OTHER]


@pytest.mark.parametrize("unit_", ["token", "word", "character"])
def test_places_by_scanning(unit_):
    kinds = {"token": TOKEN, "word": re.compile("[A-Za-z]+"), "character": re.compile("(?s).")}
    texts = ["", "a", "ab cd", " x", "é日 ab,cd\n\n", "zz" * 50, "1234", "a1b2 c3"]
    data, begin, end = joined(texts)
    found = Texts(data, begin, end, unit_)
    for k in range(12):
        places = found.after(np.minimum(found.units, k))
        for t, s, p, units in zip(texts, begin, places, found.units, strict=True):
            starts = [m.start() for m in kinds[unit_].finditer(t)]
            assert units == len(starts)
            at = len(t) if min(k, units) == len(starts) else starts[k]
            assert p - s == len(t[:at].encode())


def cut_by_hand(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    units = TOKEN.findall(text)
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_by_hand(spark, odd, empty):
    more = [(1000 + i, t) for i, t in enumerate(["<P>", "a <S> b", "<<S", "<P", "M>" * 40, "日本語 text, 12 é́", "😀" * 30, "x" * 3_000_000, "<<P> >", "\n\n"] * 6)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = infill(docs, ["doc_id", "text", "size", "u"]).withColumn("back", restore(F.col("infill.output"), F.col("infill.form")))
    rows = out.collect()
    assert len(rows) == docs.count() and {r["infill"]["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r["infill"]) == cut_by_hand(r["doc_id"], r["text"]) and r["back"] == (r["text"] or "")
    assert infill(empty).count() == 0
    with pytest.raises(ValueError, match="column"):
        infill(docs, ["doc_id", "text"], out="Text")


def ranked_by_hand(docs, items, most=50):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    big_n, big_l, df = sum(map(bool, terms)), sum(map(len, terms)), Counter(x for t in terms for x in set(t))
    out = []
    for item_id, text in set(items):
        asked, scores = set(TERM.findall((text or "").translate(LOWER))), []
        for (doc_id, _), t in zip(docs, terms, strict=True):
            tf, score = Counter(t), 0
            for x in asked & set(t):
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1)))
                score += w * (10**9 * tf[x] // (1000 * tf[x] + 20 * (100 - 50 + 50 * len(t) * big_n // big_l)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank + 1, doc_id, -minus) for rank, (minus, _, doc_id) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=repr)


def test_search_by_hand(spark, odd, empty, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "la LA one"), (2, None), (3, ""), (4, " .,!"), (5, docs[8][1]), (5, docs[8][1]), (6, "W1 w2 w3 éa"), (None, "tail lead changed"), (7, docs[16][1]), (8, "notanywhere"), (6, "ab cd")]
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit(1)).withColumn("rank", F.lit(1))
    expected = ranked_by_hand(docs, items)
    got = search(odd.repartition(7), asked)
    assert sorted(map(tuple, got.collect()), key=repr) == expected and got.columns == ["item_id", "rank", "doc_id", "score"]
    monkeypatch.setattr(lexical, "FAN_IN", 2)
    assert sorted(map(tuple, search(odd.repartition(9), asked, most=3, block_bytes=600).collect()), key=repr) == ranked_by_hand(docs, items, 3)
    assert search(empty, asked).count() == 0 and search(odd, asked.limit(0)).count() == 0


def test_small_tiles_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    block = Block.of([{"item_id": i, "text": " ".join(f"t{j}" for j in rng.integers(0, 40, 12))} for i in range(9)])
    model = lexical.Model(block, rng.integers(0, 40000, len(block.vocabulary)), 10**9, 10**12)
    pairs = np.unique(rng.integers(0, 20 * len(block.vocabulary), 300))
    doc, term = pairs // len(block.vocabulary), pairs % len(block.vocabulary)
    impact = rng.integers(1, 10**6, len(doc))
    expected = np.zeros((9, 20), dtype=object)
    for d, t, x in zip(doc, term, impact, strict=True):
        for i in block.item[block.term == t]:
            expected[i, d] += int(model.weight[t]) * int(x)
    for items, terms in ((1024, 4096), (4, 3), (1, 1)):
        monkeypatch.setattr(lexical, "ITEMS", items)
        monkeypatch.setattr(lexical, "TERMS", terms)
        got = np.zeros((9, 20), dtype=object)
        for i, scores in model.tiles(doc, term, impact, 20):
            got[i : i + len(scores)] = scores
        assert (got == expected).all()


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    asked = [r for r in found if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in asked]) > 0.995
    assert np.mean([r["rejected"] for r in asked]) < 0.03


def test_language_odd_rows(spark, odd, empty):
    out = language_id(odd).collect()
    assert len(out) == odd.count() and {r["lang_pred"] for r in out} <= {"en", "es", "fr", "und"}
    und = [r for r in out if r["lang_pred"] == "und"]
    assert {r["doc_id"] for r in und} == {1, 2, 3, 4} and all(r["score"] == 0 and r["rejected"] for r in und)
    assert language_id(empty).count() == 0
    assert {r["lang_pred"] for r in language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    again = language_id(odd.withColumn("source", F.lit("x")).repartition(5))
    key = lambda r: (r["doc_id"] or -1, r["lang_pred"], round(r["score"], 6))
    assert sorted(map(key, again.collect())) == sorted(map(key, out))


def test_lang_of_held_out_rows_teaches_nothing(spark, odd):
    held = language.held_out(F.col("doc_id"))
    changed = odd.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    key = lambda df: sorted((r["doc_id"] or -1, r["lang_pred"], round(r["score"], 6)) for r in language_id(df).collect())
    assert key(changed) == key(odd)


def test_nearest_by_hand():
    rng = np.random.default_rng(1)
    rarity = rng.random(language.FEATURES).astype(np.float32) + 1
    x = rng.random((30, language.FEATURES), dtype=np.float32) ** 8
    model = Centroids.fit(x, [("a", "b", "c")[i % 3] for i in range(30)], rarity, 2)
    names, score, cosine, far = model.nearest(x[:7])
    for i in range(7):
        own = x[i] * rarity
        by = [float(own @ v) / float(np.linalg.norm(own)) for v in model.vectors]
        best = int(np.argmax(by))
        assert names[i] == model.language[best] and cosine[i] == pytest.approx(max(by), abs=1e-4)
        tops = [max(b for b, k in zip(by, model.language) if k == j) for j in range(3)]
        assert score[i] == pytest.approx(1 / sum(math.exp(language.SHARPNESS * (t - max(by))) for t in tops), abs=1e-3)
        assert far[i] == (cosine[i] < model.least[best])


def test_clusters_part_two_kinds():
    rng = np.random.default_rng(2)
    x = unit(np.r_[np.eye(8)[np.zeros(20, int)], np.eye(8)[np.full(20, 5)]] + rng.random((40, 8)) * 0.1)
    own = np.argmax(x @ cluster(x, 2).T, axis=1)
    assert len(set(own[:20])) == len(set(own[20:])) == 1 and own[0] != own[20]
    assert len(cluster(unit(np.ones((5, 8))), 4)) == 1


def test_far_texts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = spark.createDataFrame([(1, "xkcd qqqq zzxx vvww " * 40), (2, "Ωμέγα και άλφα " * 20)], "doc_id long, text string")
    found = identify(strange, language.fit(docs), ["doc_id"], "f").select("f.*").collect()
    assert all(r["rejected"] and r["cosine"] < 0.3 for r in found)
