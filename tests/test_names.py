"""Lookups of names against plain loops."""

import math
import random

from pyspark.sql import functions as F

from scorelake.operators import identity

TOP, NEAR = 8, 5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def people(r, n):
    word = lambda k: "".join(r.choice("abcdeo") for _ in range(k))
    out = [(i, f"{word(r.randint(1, 6))} {(last := word(r.randint(2, 9)))}", f"{last}, {word(3)}", [word(5)] if i % 3 == 0 else None, r.randint(0, 40)) for i in range(n)]
    return [*out, (n, "x" * 70, None, None, 1), (n + 1, "", "", [""], 0), (n + 2, None, None, None, 3)]


def frames(spark, rows, asked):
    composers = spark.createDataFrame([(str(i), a, b, c, d) for i, a, b, c, d in rows], "composer_id string, name string, sort string, aliases array<string>, n int")
    return composers, spark.createDataFrame(list(enumerate(asked)), "query_id int, text string")


def folded(x):
    return " ".join("".join(c if c.isalnum() else " " for c in (x or "").lower()).split())


def mangled(r, text):
    for _ in range(r.randint(0, 3)):
        i = r.randrange(len(text) + 1)
        text = r.choice((text[:i] + r.choice("abz") + text[i:], text[:i] + text[i + 1 :], text[:i] + "z" + text[i + 1 :]))
    return text


def test_near_names_by_hand(spark, monkeypatch):
    r = random.Random(3)
    rows = people(r, 150)
    asked = [mangled(r, r.choice(rows)[1] or "") for _ in range(60)] + ["abc", "ab", "", None, "abc", "x" * 60]
    composers, queries = frames(spark, rows, asked)
    expected = set()
    for k, text in enumerate(asked):
        q, found = folded(text), []
        for i, name, sort, _, n in rows:
            least = min(distance(q, folded(name)), distance(q, folded((sort or "").split(",")[0])))
            if len(q) >= 3 and least <= max(2, len(q) // 3):
                found.append((least, -n, str(i)))
        expected |= {(k, c, d, place + 1) for place, (d, _, c) in enumerate(sorted(found)[:NEAR])}
    assert {tuple(x) for x in identity.near_names(composers, queries).collect()} == expected and len(expected) > 50
    monkeypatch.setattr(identity, "QUERY_TEXTS", 3)
    assert {tuple(x) for x in identity.near_names(composers, queries).collect()} == expected
    assert identity.near_names(composers.limit(0), queries).count() == 0 and identity.near_names(composers, queries.limit(0)).count() == 0


def test_candidates_grow_more_slowly_than_pairs(spark):
    r, found = random.Random(5), []
    for n in (300, 1200):
        word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(8, 14)))
        names = [word() for _ in range(n)]
        forms, texts = spark.createDataFrame([(x,) for x in names], "form string"), spark.createDataFrame([(mangled(r, x),) for x in names[: n // 3]], "q string").distinct()
        pairs = forms.join(texts, F.abs(F.length("form") - F.length("q")) <= identity.edits(F.length("q"))).count()
        found.append((identity.near_candidates(forms, texts).distinct().count(), pairs))
    (few, few_pairs), (many, many_pairs) = found
    assert many < 0.2 * many_pairs and many / few < 1.2 * many_pairs / few_pairs


def test_name_lookup_by_hand(spark, monkeypatch):
    r = random.Random(4)
    rows = people(r, 120)
    asked = ["a", "ab", "x" * 40, "x" * 70, "x" * 71, "", None, "AB"] + [(x := folded(r.choice(rows)[1]))[(i := r.randrange(len(x) + 1)) : i + r.randint(1, 9)] for _ in range(50)] + [(r.choice(rows)[3] or ["q"])[0][:4] for _ in range(20)]
    composers, queries = frames(spark, rows, asked)
    expected = set()
    for k, text in enumerate(asked):
        q, found = folded(text), []
        for i, name, sort, aliases, n in rows if q else ():
            full, s, last, names = folded(name), folded(sort), folded((sort or "").split(",")[0]), [folded(a) for a in aliases or ()]
            score = next((p for p, holds in ((100, last == q or q in names), (95, q in (full, s)), (80, last.startswith(q)), (75, any(a.startswith(q) for a in names)), (70, full.startswith(q) or s.startswith(q)), (40, q in s), (35, q in full)) if holds), None)
            if score and (name is not None or score > 0):
                found.append((-round(score + min(12, 2 * math.log2(n + 1)), 6), s, str(i)))
        expected |= {(k, c, -m, place + 1) for place, (m, _, c) in enumerate(sorted(found)[:TOP])}
    assert {tuple(x) for x in identity.name_lookup(composers, queries).collect()} == expected and len(expected) > 100
    monkeypatch.setattr(identity, "QUERY_TEXTS", 3)
    assert {tuple(x) for x in identity.name_lookup(composers, queries).collect()} == expected
    assert identity.name_lookup(composers, queries.limit(0)).count() == 0


def test_dates_of_namesakes(spark):
    composers = spark.createDataFrame([("a", "Bach, Johann Sebastian"), ("b", "Bach, Zeno"), ("c", "Bach, Anna"), ("d", None), ("e", ", Jan")], "composer_id string, sort string")
    dates = spark.createDataFrame([(2, "Bach, Johann", 1, 2, None), (1, "Bach, Sebastian X", 3, 4, None), (3, "Bach, Q", 5, 6, ["zeno"]), (4, "Bach, Anna", 7, 8, None), (0, "Bach, Anna M", 9, 9, None), (5, "Jan", 1, 1, ["jan"])], "ord int, sort string, born int, died int, alt array<string>")
    found = {x["composer_id"]: (x["born"], x["via_variant"]) for x in identity.composer_dates(composers, dates).collect()}
    assert found == {"a": (3, True), "b": (5, True), "c": (7, False), "d": (None, False), "e": (None, False)}
