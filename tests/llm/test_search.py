"""Line dedup, license scan and top-k search against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scorelake.llm.licenses import FACTOR, SMALLEST, TEMPLATES, layout, license_scan, template_table
from scorelake.llm.line_dedup import line_dedup
from scorelake.llm.topk import cuts, embedding_search, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_lines(rows):
    """(doc_id, text) -> for each the numbers of its lines in runs of five words or more that begin earlier, and the longest such run. Equal rows are one."""
    order = sorted({(i is None, i or 0, t) for i, t in rows}, key=lambda r: (r[0], r[1], r[2] or ""))
    first, gone, longest = {}, defaultdict(set), Counter()
    for null, i, t in order:
        name = (None if null else i, t)
        lines = [] if t is None else t.split("\n")
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = tuple(lines[a:b])
                if first.setdefault(run, (name, a)) != (name, a) and sum(len(WORD.findall(x)) for x in run) >= 5:
                    gone[name].update(range(a, b))
                    longest[name] = max(longest[name], b - a)
    return gone, longest


def held_against(rows, out):
    gone, longest = repeated_lines(rows)
    expected = Counter()
    for name in rows:
        lines = [] if name[1] is None else name[1].split("\n")
        kept = None if name[1] is None else "\n".join(x for k, x in enumerate(lines) if k not in gone[name])
        if name[0] is not None:
            expected[name[0], kept, len(lines), len(gone[name]), longest[name]] += 1
    assert Counter((r["doc_id"], r["text"], *r["line_dedup"]) for r in out if r["doc_id"] is not None) == expected and len(out) == len(rows)
    return gone, longest


def test_line_dedup(spark, odd):
    base = [f"line {i} of some text here" for i in range(9)]
    texts = ["\n".join(base), "\n".join(base), "\n".join(base[:4] + ["x"] + base[3:]), "a\nb\nc d e f\nq", "z\na\nb\nc d e f", "\n\n\n\n", "", None, "one two three four five\none two three four five"]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    docs = odd.select("doc_id", "text", "digest").unionByName(more, allowMissingColumns=True)
    _, longest = held_against([(r["doc_id"], r["text"]) for r in docs.collect()], line_dedup(docs).collect())
    assert max(longest.values()) == 9 and line_dedup(docs).columns == ["doc_id", "text", "digest", "line_dedup"]


def test_line_dedup_judges_whole_runs(spark):
    import random

    r = random.Random(6)
    base = [f"line {i} of some text here" for i in range(9)]
    texts = ["a\nb\nc d e f\nq", "z\na\nb\nc d e f", "\n".join(base[:7]), "x\n" + "\n".join(base[:7]) + "\ny", "m n\no\np q\n1", "2\nm n\no\np q", None, "", "s\n" * 9]
    texts += ["\n".join(r.choice(("a", "b b", "c", "d d d")) for _ in range(r.randint(1, 30))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (3, texts[3])]
    gone, longest = held_against(rows, line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert gone[1, texts[1]] == {1, 2, 3} and longest[3, texts[3]] == 7 and len(gone[5, texts[5]]) == 3


def license_words(t):
    return re.sub(r"[\W_]+", " ", t.lower()).split()


def by_hand(rows, templates):
    """Every window of every text against every template, without bands."""
    found = {}
    for k, (i, t) in enumerate(rows):
        own = license_words(t or "")
        held = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
        for name, family, template in templates:
            words = license_words(template)
            wanted = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
            number = next(c for c in range(9) if len(words) <= SMALLEST * FACTOR**c)
            inside, step, _ = layout(number)
            for at in range(0, max(len(held) - inside + step, 1), step) if held and wanted else ():
                share = len(wanted & set(held[at : at + inside])) / len(wanted)
                if share >= 0.8:
                    found.setdefault((k, i, number, at, family), []).append((share, name))
    out = {}
    for (_, i, *_), shares in found.items():
        for share, name in shares:
            if share == max(shares)[0]:
                out[i, name] = max(share, out.get((i, name), 0))
    return out


def test_license_scan(spark, odd):
    texts_of = {name: t for name, _, t in TEMPLATES}
    notice = license_words(texts_of["MIT notice"])
    changed = " ".join(w if i != 40 else "CHANGED" for i, w in enumerate(notice))
    longer = " ".join(w + (" really" if i in (50, 60) else "") for i, w in enumerate(notice))
    texts = [texts_of["MIT"], "bla " * 300 + texts_of["GPL-3.0"].upper() + " foo" * 70, f"x {changed} y", " ".join(notice[:60]), "released under the mit", texts_of["CC-BY-NC-4.0"] + "\n" + texts_of["MIT"] + " " + texts_of["MIT"]]
    texts += ["bla " * n + longer for n in range(0, 300, 25)]
    docs = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd, allowMissingColumns=True)
    got = {(r["doc_id"], r["license"]): r["containment"] for r in license_scan(docs).collect()}
    assert got == pytest.approx(by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], TEMPLATES))
    assert (1001, "GPL-3.0") in got and (1001, "GPL-2.0") not in got and (1002, "MIT notice") in got and (1003, "MIT notice") not in got and (1005, "CC-BY-NC-4.0") in got
    assert all((1006 + k, "MIT notice") in got for k in range(12))
    assert license_scan(docs, template_table(spark, TEMPLATES).limit(0)).count() == 0


def test_every_license_template_is_found_in_itself(spark):
    rows = [(i, "some words before " * 9 + t + " and some behind" * 9) for i, (_, _, t) in enumerate(TEMPLATES)]
    got = {(r["doc_id"], r["license"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got >= {(i, name) for i, (name, _, _) in enumerate(TEMPLATES)}


def test_license_templates_go_in_parts_where_they_are_many(spark, monkeypatch):
    from scorelake.llm import licenses

    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(TEMPLATES)], "doc_id long, text string")
    whole = sorted(map(tuple, license_scan(docs).collect()))
    monkeypatch.setattr(licenses, "BROADCAST_SHINGLES", 700)
    assert sorted(map(tuple, license_scan(docs).collect())) == whole


def test_top_k(spark):
    import random

    r = random.Random(4)
    codes = {i: r.getrandbits(64) for i in range(300)} | {300 + i: 77 for i in range(30)}
    for i in range(40):
        codes[400 + i] = codes[i] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(i, signed(c)) for i, c in codes.items()] + [(5, signed(codes[5])), (None, 3), (900, None)]
    vectors = spark.createDataFrame(rows, "id long, code long")
    queries = vectors.where("id % 37 = 0 or id in (301, 900)")
    found = [{(x["query_id"], x["rank"]): (x["neighbour_id"], x["distance"]) for x in top_k(vectors, queries, 5, segments).collect()} for segments in (4, 5)]
    got = found[0]
    expected = {}
    for q in codes:
        if q % 37 == 0 or q == 301:
            near = sorted(((codes[q] ^ c).bit_count(), i) for i, c in codes.items() if i != q)[:5]
            expected |= {(q, k + 1): (i, d) for k, (d, i) in enumerate(near)}
    assert got == expected == found[1]


def test_codes_of_long_and_short_embeddings(spark):
    from pyspark.sql import functions as F

    from scorelake.llm.topk import sign_code

    rng = np.random.default_rng(3)
    rows = [rng.normal(size=n).tolist() for n in (64, 64, 3, 130, 200, 0)] + [[1.0, None, -1.0, None], None]
    got = [r["c"] for r in spark.createDataFrame([(i, e) for i, e in enumerate(rows)], "i int, e array<double>").select("i", sign_code(F.col("e")).alias("c")).orderBy("i").collect()]

    def code(e):
        sums = [sum(x or 0 for x in e[b::64]) for b in range(64)]
        return sum(1 << b for b in range(64) if sums[b] > 0)

    assert [None if c is None else c % (1 << 64) for c in got] == [None if e is None else code(e) for e in rows]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 16])
def test_cuts_cover_a_code(n):
    layout = cuts(n)
    assert sum(w for _, w in layout) == 64 and all(a + w == b for (a, w), (b, _) in zip(layout, layout[1:])) and len(layout) == n


def test_empty_tables(spark, empty):
    assert line_dedup(empty).count() == 0 and license_scan(empty).count() == 0
    assert embedding_search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
