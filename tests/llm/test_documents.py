"""Operators with a contract on documents, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from scorelake.llm.exact_dedup import DigestIndex, digests, exact_dedup
from scorelake.llm.mixing import mix
from scorelake.llm.packing import best_fit, bin_completion, complete_bins, dominated, encoder, fillings, least_bins, pack
from scorelake.llm.queries import VOCABULARY
from scorelake.llm.simhash import near_dedup
from scorelake.llm.substring import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(params=["odd", "sf0.001"])
def docs(request, spark, odd):
    return odd if request.param == "odd" else small(spark)


def test_exact_dedup(docs):
    rows = rows_of(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    expected = []
    for i, t in rows:
        t = (t or "").translate(LOWER)
        keep = max((x for x in groups[t] if x is not None), default=None)
        expected.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert Counter(map(tuple, exact_dedup(docs).collect())) == Counter(expected)


KNOWN: set[str] = set()


def test_exact_dedup_against_an_index(spark, odd):
    index = DigestIndex(spark, buckets=4)
    KNOWN.add(index.name)
    exact_dedup(odd.where("doc_id < 12"), index)
    n = index.table().count()
    out = {r["doc_id"]: r for r in exact_dedup(spark.createDataFrame([(900, "ONE"), (901, "fresh")], "doc_id long, text string"), index).collect()}
    assert (out[900]["keep_id"], out[900]["kept"]) == (6, False) and out[901]["kept"]
    assert index.table().count() == n + 1
    plan = index.unseen(digests(odd).selectExpr("digest", "doc_id keep_id", "1L group_size"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan


def test_an_index_opened_again_keeps_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(400)], "doc_id long, text string")
    index = DigestIndex(spark, path=str(tmp_path / "index"), buckets=4)
    exact_dedup(docs, index).count()
    with pytest.raises(ValueError):
        DigestIndex(spark, path=str(tmp_path / "index"), buckets=7)
    again = DigestIndex(spark, path=str(tmp_path / "index"))
    KNOWN.update((index.name, again.name))
    out = exact_dedup(spark.createDataFrame([(1000 + i, f"TEXT {i}") for i in range(500)], "doc_id long, text string"), again).collect()
    assert again.buckets == 4 and again.table().count() == 500 and sum(r["kept"] for r in out) == 200


def test_batches_add_up_to_one(spark, docs):
    whole = Counter(map(tuple, exact_dedup(docs).collect()))
    assert Counter(map(tuple, exact_dedup(docs, batches=2).collect())) == whole == Counter(map(tuple, exact_dedup(docs, batches=5).collect()))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("digest_index") and t.name not in KNOWN]


def plain_fingerprint(t):
    words = WORD.findall((t or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_near_dedup(docs):
    rows = rows_of(docs)
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    expected = Counter((i, f"{fps[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows))
    assert Counter(map(tuple, near_dedup(docs).collect())) == expected


def test_every_close_pair_meets_at_an_anchor():
    from scorelake.llm.simhash import anchors

    rng = np.random.default_rng(1)
    fp = rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
    near = fp.copy()
    for k in range(400):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            near[k] ^= np.int64(np.uint64(1 << int(b)).astype(np.int64))
    (ra, a), (rb, b) = anchors(fp), anchors(near)
    for k in range(400):
        assert set(a[ra == k]) & set(b[rb == k])
    assert 50 < len(a) / 400 < 75


def test_large_anchors_are_searched_whole():
    from scorelake.llm.simhash import _compare

    base = np.int64(0x1234567890ABCDEF)
    fp = np.unique(np.array([base ^ np.int64(1 << a) ^ np.int64(1 << b) for a in range(30) for b in range(a)], dtype=np.int64))
    u, v = _compare(np.zeros(len(fp), dtype=np.int32), fp)
    assert len(u) <= len(fp) and set(u) | set(v) == set(fp)


def test_mix(docs, spark):
    rows = [(r["doc_id"], len(WORD.findall(r["text"] or "")), r["source"]) for r in docs.collect()]
    size = Counter()
    for _, n, s in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in stopped)
        target = {s: 3.0 * size[s] if s in stopped else rest * weight[s] / sum(weight[x] for x in order if x not in stopped) for s in order}
        above = {s for s in order if s not in stopped and target[s] > 3 * size[s]}
        if not above:
            break
        stopped |= above
    out = mix(docs, block_words=8, shard_words=2000).collect()
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in out) == Counter(rows)
    taken = Counter()
    for r in out:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 8 * 2 + 0.01 * target[s] for s in order)
    assert Counter(map(tuple, mix(docs, block_words=8, shard_words=2000).collect())) == Counter(map(tuple, out))


def test_sainte_lague_is_the_rule_of_highest_quotients(spark):
    from scorelake.llm.mixing import sainte_lague

    votes = {"a": 53000.0, "b": 24000.0, "c": 23000.0, "d": 900.0, "e": 1.0}
    df = spark.createDataFrame([(0, k, v, 37) for k, v in votes.items()], "g int, k string, w double, seats long")
    got = {r["k"]: r["n"] for r in sainte_lague(df, ["g"], "k", "w", "seats", "n").collect()}
    best = sorted(((v / (2 * i + 1), k) for k, v in votes.items() for i in range(37)), reverse=True)[:37]
    assert got == {k: sum(x == k for _, x in best) for k in votes}


def test_pack(docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    ids = [(i, [*own.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows_of(docs)]
    out = pack(docs, VOCABULARY).collect()
    expected = []
    for i, x in ids:
        first = (len(x) - 1) % 2048 + 1
        cuts = [(0, first), *((s, s + 2048) for s in range(first, len(x), 2048))]
        expected += [(i, k, a, b - a, zlib.crc32(np.array(x[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(cuts)]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == Counter(expected)
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(len(x) for _, x in ids) // 2048) * 1.01 + 1


def test_encoder_agrees_with_the_vocabulary_file():
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(VOCABULARY), encoder(VOCABULARY)
    cases = ["", " ", "a  b\n\n c\t", "It's we'll 'S", "<|endoftext|> x", "ñandú  Žižek", "日本 ok", "a b", "\x1c x", "x\r\ny", "12 345a", "ſ"]
    cases += [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}" for c in range(1, 0x250)]
    cases += ["x" * 1_000_000, "ab " * 300_000]
    for x in [*cases, *reversed(cases)]:
        assert np.frombuffer(encode(x), dtype="<u4").tolist() == own.encode(x, add_special_tokens=False).ids


def test_words_are_forgotten(monkeypatch):
    from scorelake.llm import packing

    monkeypatch.setattr(packing, "WORDS", 3)
    asked = []
    words = packing.Words(lambda w: asked.append(w) or w.encode())
    assert [words[w] for w in "abcabcdd"] == [w.encode() for w in "abcabcdd"] and asked == list("abcd") and len(words) == 1
    assert words["x" * 41] == b"x" * 41 and len(words) == 1


def test_encoder_agrees_with_the_vocabulary_file_on_every_text(spark):
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(VOCABULARY), encoder(VOCABULARY)
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").toLocalIterator():
        assert np.frombuffer(encode(r["text"] or ""), dtype="<u4").tolist() == own.encode(r["text"] or "", add_special_tokens=False).ids


def test_repeated_rows_are_dealt_to_all_shards(spark):
    out = pack(spark.createDataFrame([(None, "same text")] * 1000, "doc_id long, text string"), VOCABULARY, shard_pieces=100).collect()
    assert len({r["sequence_id"] >> 32 for r in out}) == 10 and len(out) == 1000


def test_a_search_to_its_end_needs_fewer_sequences_than_best_fit(spark):
    """Texts of so many tokens, whose best fit isn't the least: nodes=None finds and proves it; without a search best fit stays, unproved."""
    rng = np.random.default_rng(8)
    while True:
        lengths = rng.integers(3, 30, 9).tolist()
        if len(best_fit(lengths, 40)) > least_bins(lengths, 40) and len(bin_completion(lengths, 40, None)[0]) < len(best_fit(lengths, 40)):
            break
    docs = spark.createDataFrame([(i, "a" + " a" * (n - 2)) for i, n in enumerate(lengths)], "doc_id long, text string")
    found = {nodes: pack(docs, VOCABULARY, 40, nodes=nodes).collect() for nodes in (None, -100)}
    assert sorted(r["length"] for r in found[None]) == sorted(lengths)
    assert len({r["sequence_id"] for r in found[None]}) == len(bin_completion(lengths, 40, None)[0]) < len({r["sequence_id"] for r in found[-100]}) == len(best_fit(lengths, 40))
    assert all(r["proved"] for r in found[None]) and not any(r["proved"] for r in found[-100])


def test_bin_completion_reaches_the_least_number_of_bins():
    rng = np.random.default_rng(3)
    for hi in (50, 100, 60):
        lengths = rng.integers(1, hi, 500)
        sequence, _, _ = complete_bins(lengths, 100)
        assert len(set(sequence)) <= least_bins(lengths.tolist(), 100) * 1.02
    sequence, _, _ = complete_bins(np.array([60, 60, 40, 40, 55, 45, 30, 30, 20, 20]), 100)
    assert len(set(sequence)) == 4


def test_substring_dedup(docs):
    rows = [(i, WORD.findall(t or "")) for i, t in rows_of(docs)]
    least = {}
    for i, w in rows:
        for p in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[p : p + 50])
            least[key] = min(i, least.get(key, i))
    expected = []
    for i, w in rows:
        gone = set()
        for p in range(len(w) - 49 if i is not None else 0):
            if least[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert Counter(map(tuple, substring_dedup(docs).collect())) == Counter(expected)
    assert sum(x[2] for x in expected) > 1000


def test_patterned_words_are_told_apart(spark):
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    one, other = ("".join("ab"[b ^ k] for b in bits) for k in (0, 1))
    tail = " ".join(f"t{i}" for i in range(49))
    docs = spark.createDataFrame([(1, f"{one} {tail}"), (2, f"{other} {tail}"), (3, f"{one} {tail}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(docs).collect()} == {1: 0, 2: 0, 3: 50}


def test_rows_of_one_id_with_different_texts_keep_their_own_spans(spark):
    passage, other = " ".join(f"p{i}" for i in range(60)), " ".join(f"q{i}" for i in range(55))
    docs = spark.createDataFrame([(1, passage), (2, f"a b {passage}"), (2, other), (2, f"a b {passage}"), (3, other)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect()) == [(1, 60, 0), (2, 55, 0), (2, 62, 60), (2, 62, 60), (3, 55, 55)]


def test_window_hashes_part_sequences():
    from scorelake.llm.substring import _HALVES, WINDOW, window_hash

    rng = np.random.default_rng(9)
    name = rng.integers(0, 3, 3000).astype(np.uint64)
    hashes = [window_hash(name, odd) for odd in _HALVES]
    windows = [tuple(name[i : i + WINDOW]) for i in range(len(name) - WINDOW + 1)]
    for h in hashes:
        assert len(h) == len(windows) and len(set(h.tolist())) == len(set(windows))
    assert window_hash(np.tile(name[:100], 2), _HALVES[0])[0] == window_hash(np.tile(name[:100], 2), _HALVES[0])[100]


def test_equal_stretches_have_equal_symbols_inside():
    from scorelake.llm.substring import recompress

    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    shared[20:24] = shared[20]
    kinds = 0
    for _ in range(200):
        a, b = (np.concatenate([rng.integers(0, 1 << 63, 80).astype(np.uint64), shared, rng.integers(0, 1 << 63, 80).astype(np.uint64)]) for _ in range(2))
        a[79], b[130] = shared[0], shared[49]
        found = []
        for x in (a, b):
            name, _, low, high = recompress(x, np.zeros(len(x), dtype=np.int64))
            inside = (low >= 80) & (high <= 130)
            found.append(set(zip(name[inside].tolist(), low[inside].tolist(), high[inside].tolist())))
        assert found[0] == found[1]
        kinds += len(found[0])
    assert kinds > 200


def test_empty_tables(empty):
    for out in (exact_dedup(empty), near_dedup(empty), mix(empty), pack(empty, VOCABULARY), substring_dedup(empty)):
        assert out.count() == 0


def test_bin_completion_holds_thousands_of_short_pieces():
    for lengths in ([2] * 4000 + [3], [2] * 3000 + [3] * 3 + [2047]):
        sequence, offset, _ = complete_bins(np.array(lengths), 2048)
        assert len(set(sequence)) == -(-sum(lengths) // 2048)
        assert len(set(zip(sequence, offset))) == len(lengths)


def test_bin_completion_by_brute_force():
    rng = np.random.default_rng(8)

    def least(lengths, capacity):
        best = [len(lengths)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(lengths):
                best[0] = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= lengths[i]:
                    place(i + 1, rooms[:k] + [rooms[k] - lengths[i]] + rooms[k + 1 :])
            place(i + 1, [*rooms, capacity - lengths[i]])

        place(0, [])
        return best[0]

    cases = [rng.integers(1, hi, n).tolist() for hi in (14, 30) for n in (5, 8, 9) for _ in range(25)]
    cases += [[23, 21, 15, 13, 12, 11, 10, 9, 6], [20, 14, 13, 12, 11, 10]]
    better = 0
    for lengths in cases:
        found, proved = bin_completion(lengths, 40, None)
        assert proved
        assert sorted(x for own in found for x in own) == sorted(lengths) and all(sum(own) <= 40 for own in found)
        assert least_bins(lengths, 40) <= len(found) == least(sorted(lengths, reverse=True), 40)
        better += len(found) < len(best_fit(lengths, 40))
    assert better


def test_fillings_leave_out_only_what_is_dominated():
    rng = np.random.default_rng(11)
    for _ in range(60):
        count, room = Counter(rng.integers(1, 12, rng.integers(1, 9)).tolist()), int(rng.integers(3, 25))
        every = {()}
        for x in sorted(count.elements()):
            every |= {(*f, x) for f in every if sum(f) + x <= room}
        got = [(w, tuple(sorted(f))) for w, f in fillings(sorted(count), count, room, room) if f is not None]
        assert [w for w, _ in got] == sorted(room - sum(f) for _, f in got) and {f for _, f in got} <= every and len(got) == len(set(got))
        kept = {f for _, f in got}
        for f in every - kept:
            assert dominated(list(f), sorted(count), count, room - sum(f))
