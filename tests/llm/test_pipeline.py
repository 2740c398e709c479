"""The pipeline's stages, each held against plain loops over its own input."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import WORD, plain_fingerprint
from test_search import repeated_lines

import corpus_pipeline
from scorelake.llm import quality as q
from scorelake.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
CLASHES = ("score", "Line_Dedup", "row", "_row", "_taken", "_size", "taken", "stay", "fp_", "component_id", "y")


@pytest.fixture(scope="module", params=["odd", "sf0.001"])
def docs(request, spark, odd, tmp_path_factory):
    """Odd rows with columns named like the operators' own, or documents; both written, as a stage's input is."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    if request.param == "odd":
        df = odd
        for k, name in enumerate(CLASHES):
            df = df.withColumn(name, F.lit(k))
    path = str(tmp_path_factory.mktemp("docs") / "t")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return tuple(sorted((k, str(v)) for k, v in r.items()))


def test_quality(spark, docs):
    out = STAGES["quality_classifier"](spark, docs, SF)
    voters = q.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    expected = Counter()
    for r in rows_of(docs):
        data = np.frombuffer((r["text"] or "").encode() + b" ", dtype=np.uint8)
        if voters.scores(q.features(data, np.array([0, len(data)])))[0] >= 0.3:
            expected[key(r)] += 1
    assert out.columns == docs.columns and Counter(map(key, rows_of(out))) == expected


def test_lines(spark, docs):
    rows = rows_of(docs)
    gone, _ = repeated_lines([(r["doc_id"], r["text"]) for r in rows])
    expected = Counter()
    for r in rows:
        if r["doc_id"] is not None:  # rows without an id are last, in the order of a hash
            kept = None if r["text"] is None else "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in gone[r["doc_id"], r["text"]])
            expected[key(r | {"text": kept, "n_chars": None if kept is None else len(kept)})] += 1
    out = STAGES["line_dedup"](spark, docs, SF)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert Counter(key(r) for r in rows_of(out) if r["doc_id"] is not None) == expected


def test_near_copies(spark, docs):
    rows = rows_of(docs)
    prints = [plain_fingerprint(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    groups = defaultdict(list)
    for g, r in zip(group, rows, strict=True):
        groups[g].append(r)
    out = rows_of(STAGES["simhash_near_dedup"](spark, docs, SF))
    left = Counter(map(key, out))
    assert len(out) == len(groups)
    for own in groups.values():
        least = min((r["doc_id"] is None, r["doc_id"] or 0) for r in own)
        assert sum(left[k] for k in {key(r) for r in own if (r["doc_id"] is None, r["doc_id"] or 0) == least}) == 1


def test_mix(spark, docs):
    rows = rows_of(docs)
    out = rows_of(STAGES["source_mix"](spark, docs, SF))
    words = lambda t: WORD.findall(t or "")
    size = Counter()
    for r in rows:
        size[r["source"]] += len(words(r["text"]))
    total, order = sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    stopped = set()
    while True:
        rest = total - sum(3 * size[s] for s in stopped)
        target = {s: 3.0 * size[s] if s in stopped else rest * weight[s] / sum(weight[x] for x in order if x not in stopped) for s in order}
        above = {s for s in order if s not in stopped and target[s] > 3 * size[s]}
        if not above:
            break
        stopped |= above
    got = Counter()
    for r in out:
        got[r["source"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(abs(got[s] - target[s]) <= 2 * 64 + 1 for s in order)
    # Every row that comes out is a row that went in, whole or its first words; whole ones at most three times, cut ones once.
    other = lambda r: key({k: v for k, v in r.items() if k not in ("text", "n_chars")})
    source_rows = defaultdict(list)
    for r in rows:
        source_rows[other(r)].append(r["text"] or "")
    for k, mine in source_rows.items():
        whole, cut = Counter(), []
        for r in out:
            if other(r) == k:
                if r["text"] in mine:
                    whole[r["text"]] += 1
                else:
                    cut.append(words(r["text"]))
        assert all(n <= 3 * mine.count(t) for t, n in whole.items()) and len(cut) <= len(mine)
        assert all(any(words(t)[: len(c)] == c for t in mine) for c in cut)
    assert Counter(map(key, rows_of(STAGES["source_mix"](spark, docs, SF)))) == Counter(map(key, out))


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    out, sequences, expected = STAGES["best_fit_packing"](spark, docs, SF).collect(), defaultdict(list), Counter()
    for r in docs.collect():
        ids = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = (len(ids) - 1) % 2048 + 1
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            b = first if not k else a + 2048
            expected[r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == expected
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_empty_tables(spark, empty):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and (name == "best_fit_packing" or out.columns == empty.columns)


def test_the_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    folder = corpus_pipeline.new_path(spark, "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 10 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert out.join(docs, "doc_id", "left_anti").count() == 0
