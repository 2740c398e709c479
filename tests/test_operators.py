"""Operators over catalogues, on small tables and against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions import keys, text, years
from scorelake.operators import chronology, dedupe, identity, search
from scorelake.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names_and_keys(spark):
    lit = F.lit
    assert one(spark, text.fold(lit("  Dvořák, Antonín—ÉTUDE №5 "))) == "dvorak antonin etude 5"
    assert one(spark, text.fold(text.fold(lit("Ünïcode X")))) == one(spark, text.fold(lit("Ünïcode X")))
    assert one(spark, text.fold(lit(None).cast("string"))) == "" and one(spark, text.fold(lit("Чайковский"))) == ""
    assert one(spark, text.sort_form(lit("Pyotr Ilyich Tchaikovsky"))) == "Tchaikovsky, Pyotr Ilyich"
    assert one(spark, text.display_name(lit("Tchaikovsky, Pyotr"))) == "Pyotr Tchaikovsky"
    assert one(spark, text.title_composer(lit("Missa (Anonymous)"))).asDict() == {"title": "Missa", "composer": "Anonymous"}
    assert one(spark, text.title_composer(lit("Petrushka (1947 version)")))["composer"] is None
    assert one(spark, keys.form_key(lit("c"), lit("Piano Concerto No. 2 in C minor"))) == "c::form::piano-concerto-2"
    assert one(spark, keys.form_key(lit("c"), lit("Boléro"))) is None
    assert one(spark, keys.catalogue_parts(lit("K.161/141a"))) == ["K.161/141a", "K.161", "K.141a"]
    assert one(spark, keys.catalogue_parts(lit("H.5905/4"))) == ["H.5905/4"]
    extra = one(spark, keys.extra_keys(lit("c"), lit("Boléro, M.81"), lit(None).cast("string")))
    assert extra["register"] == ["c::cat::m81"] and extra["query"] == ["c::cat::m81", "c::bare::bolero"]
    assert one(spark, keys.extra_keys(lit("c"), lit("Mass in C"), lit(None).cast("string")))["query"] == []


@pytest.mark.parametrize(
    ("field", "year"),
    [("1924–25", 1925), ("1946–1951/53", 1953), ("{{start date|1795}}–1800", 1795), ("1899", 1899), ("1950-1940", 1950), ("prose", None), ("12345", 1234), ("0900", None)],
)
def test_field_year(spark, field, year):
    assert one(spark, years.field_year(F.lit(field), 2030)) == year


def test_sort_years(spark):
    rows = [(n, "c", f"Symphony No. {n}", None, {5: 1937, 8: 1943, 10: 1953}.get(n), False) for n in [*range(1, 14), 15]]
    rows += [(20, "c", "Trifle", "Op. 5", None, False), (21, "c", "Other", "op.10", 1940, False), (22, "c", "Bach", "BWV 5", None, False), (23, "d", "Symphony No. 6", None, None, False), (24, "c", "Symphony No. 7", None, None, True)]
    out = {r["ord"]: r["sy"] for r in chronology.assign_sort_years(spark.createDataFrame(rows, "ord int, c string, t string, cat string, y int, arr boolean")).collect()}
    assert out[6] == 1939 and out[4] == pytest.approx(1936.999) and out[15] == pytest.approx(1953.005)
    assert [k for k, _ in sorted(((k, v) for k, v in out.items() if k < 16), key=lambda x: x[1])] == [*range(1, 14), 15]
    assert out[20] == pytest.approx(1939.995) and out[22] is None and out[23] is None and out[24] is None


def test_first_wins_against_a_plain_loop(spark):
    r = random.Random(2)
    rows = []
    for i in range(120):
        register = [f"k{r.randrange(40)}" for _ in range(r.randrange(1, 3))]
        rows.append((i, i, sorted(set(register)), sorted({*register, f"k{r.randrange(40)}"})))
    seen, kept = set(), set()
    for i, _, register, query in rows:
        if not seen & set(query):
            kept.add(i)
            seen |= set(register)
    df = spark.createDataFrame(rows, "id int, ord int, register array<string>, query array<string>")
    assert {x["id"] for x in dedupe.first_wins(df).collect()} == kept
    assert {x["id"] for x in dedupe.first_wins(df.orderBy(F.rand(1)).repartition(5)).collect()} == kept
    assert {x["id"] for x in dedupe.first_wins(dedupe.first_wins(df)).collect()} == kept


def test_dedupe_across_sources(spark):
    schema = "id int, rank int, ord int, c string, t string, cat string, y int"
    rows = [(1, 0, 1, "c", "Boléro", "M. 81", None), (2, 0, 2, "c", "Bolero", None, None), (3, 2, 3, "c", "Bolero, M.81", None, 1928), (4, 2, 4, "c", "Symphony No. 9, from the New World", None, None), (5, 3, 5, "c", "Symphony No. 9", None, 1893), (6, 3, 6, "c", "Мелодия", None, None), (7, 3, 7, "c", "Другая", None, None)]
    df = spark.createDataFrame(rows, schema)
    parts = [dedupe.with_keys(df.where(F.col("rank") == k), s) for k, s in ((0, "curated"), (2, "encyclopaedia"), (3, "library"))]
    ranked = dedupe.dedupe_works(parts[0].unionByName(parts[1]).unionByName(parts[2]), [0, 2, 3])
    assert {r["id"] for r in ranked.where("kept").collect()} == {1, 2, 4, 6}
    assert {(r["id"], r["y"]) for r in dedupe.backfill_years(ranked).collect()} == {(1, 1928), (4, 1893)} or {(r["id"], r["y"]) for r in dedupe.backfill_years(ranked).collect()} == {(2, 1928), (4, 1893)}


def test_composers(spark):
    schema = "rank int, ord int, name string, id string, sort string, dates string, aliases array<string>"
    rows = [(0, 1, "Alexander Glazunov", "glazunov", "Glazunov, Alexander", None, ["Sasha"]), (1, 2, "Aleksandr Glazunov", None, None, "1865–1936", None), (1, 3, "Ana Bea", None, None, None, None), (2, 4, "ÁNA BEA", "other", None, "1900–", None)]
    linked, composers = identity.resolve_composers(spark.createDataFrame(rows, schema), spark.createDataFrame([("Aleksandr Glazunov", "Alexander Glazunov")], "variant string, canonical string"))
    out = {r["composer_id"]: r for r in composers.collect()}
    assert set(out) == {"glazunov", "bea-ana"} and out["glazunov"]["dates"] == "1865–1936" and set(out["glazunov"]["aliases"]) == {"Sasha", "Aleksandr Glazunov"}
    assert out["bea-ana"]["dates"] == "1900–" and linked.count() == 4


PEOPLE = [
    ("a", "Johann Sebastian Bach", "Bach, Johann Sebastian", ["JSB", "Old Bach"], 100), ("b", "Burt Bacharach", "Bacharach, Burt", None, 3), ("c", "Anna Zobach", "Zobach, Anna", [], 1),
    ("d", "Joseph Haydn", "Haydn, Joseph", ["Papa"], 50), ("e", "Ludwig van Beethoven", "Beethoven, Ludwig van", None, 9), ("f", "Papageno", None, None, 0),
]


def ladder(q, name, sort, aliases):
    """Points of a name for a query, all folded."""
    last, aliases = sort.split(",")[0] if sort else "", aliases or []
    plain = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    full, sort, last, aliases = plain(name), plain(sort or ""), plain(last), [plain(x) for x in aliases]
    tests = [(100, last == q or q in aliases), (95, q in (full, sort)), (80, last.startswith(q)), (75, any(x.startswith(q) for x in aliases)), (70, full.startswith(q) or sort.startswith(q)), (40, q in sort), (35, q in full)]
    return next((n for n, holds in tests if holds), None), sort


def test_name_lookup(spark, monkeypatch):
    import math

    people = spark.createDataFrame(PEOPLE, "composer_id string, name string, sort string, aliases array<string>, n int")
    texts = ["bach", "joseph haydn", "haydn joseph", "", "b", "ach", "sebastian b", "jsb", "ol", "papa", "n bach", "van", "zz", "ludwig van beethoven and more", "h, j", "Bach"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")
    expected = {}
    for i, t in enumerate(texts):
        q = " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
        found = [(-round(points + min(12, 2 * math.log2(n + 1)), 6), sort, c) for c, name, s, aliases, n in PEOPLE for points, sort in [ladder(q, name, s, aliases)] if q and points]
        expected |= {(i, k + 1): c for k, (_, _, c) in enumerate(sorted(found)[:8])}
    for most in (200_000, 3):
        monkeypatch.setattr(identity, "QUERY_TEXTS", most)
        assert {(r["query_id"], r["rank"]): r["composer_id"] for r in identity.name_lookup(people, asked).collect()} == expected
    assert identity.name_lookup(people, asked.limit(0)).count() == 0


def test_near_names(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _next(row, x, b, i)
        return row[-1]

    def _next(row, x, b, i):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
        return out

    people = spark.createDataFrame(PEOPLE, "composer_id string, name string, sort string, aliases array<string>, n int")
    texts = ["beethovn", "Hadyn", "bach", "ba", "zobak anna", "joseph hyden", "papageni"]
    got = {(r["query_id"], r["composer_id"]): r["distance"] for r in identity.near_names(people, spark.createDataFrame(list(enumerate(texts)), "query_id int, text string"), 99).collect()}
    expected = {}
    for i, q in enumerate(map(str.lower, texts)):
        for c, name, sort, _, _ in PEOPLE:
            near = min(distance(q, name.lower()), distance(q, (sort or "").split(",")[0].lower()))
            if len(q) >= 3 and near <= max(2, len(q) // 3):
                expected[i, c] = near
    assert got == expected and got[0, "e"] == 1 and (1, "d") in got


def test_places(spark):
    from scorelake.functions.text import natural_key

    titles = ["Suite 2", "suite 10", "Suite 2b", "Étude 7", "Suite 123456789012345", "Suite 99999999999999", "suite 002 x", ""]
    df = spark.createDataFrame([(t,) for t in titles], "t string").repartition(3).withColumn("k", natural_key(F.col("t")))
    assert [r["t"] for r in search.placed(df, "k").orderBy("place").collect()] == ["", "Étude 7", "Suite 2", "suite 002 x", "Suite 2b", "suite 10", "Suite 99999999999999", "Suite 123456789012345"]


def test_arrangements_only_meet_each_other(spark):
    rows = [(1, 2, 1, "c", "Boléro", "M. 81", False), (2, 3, 2, "c", "Boléro", "M. 81", True), (3, 3, 3, "c", "Boléro", "M. 81", True), (4, 3, 4, "c", "Boléro", None, False)]
    df = spark.createDataFrame(rows, "id int, rank int, ord int, c string, t string, cat string, arr boolean")
    ranked = dedupe.with_keys(df.where("rank = 2"), "encyclopaedia").unionByName(dedupe.with_keys(df.where("rank = 3"), "library"))
    assert {r["id"] for r in dedupe.dedupe_works(ranked, [2, 3]).where("kept").collect()} == {1, 2}


def test_year_nought_is_no_year(spark):
    rows = [(1, 0, 1, 0, True, ["k"]), (2, 3, 2, 0, False, ["k"]), (3, 3, 3, 1900, False, ["k"])]
    df = spark.createDataFrame(rows, "id int, rank int, ord int, y int, kept boolean, register array<string>").withColumn("query", F.col("register"))
    assert [tuple(r) for r in dedupe.backfill_years(df).collect()] == [(1, 1900)]


def test_display_names(spark):
    for sort, name in (("Bach, Johann, Jr", "Johann, Jr Bach"), ("Bach, Anna", "Anna Bach"), ("Bach", "Bach"), (None, None)):
        assert one(spark, text.display_name(F.lit(sort).cast("string"))) == name
    assert one(spark, keys.page_url(F.lit("A B (É)"), "https://x.org/wiki/")) == "https://x.org/wiki/A_B_(%C3%89)"


def test_saved_searches(spark):
    works = spark.createDataFrame([(1, {"trumpet": 2}, ["trumpet"]), (2, {"trumpet": 2}, ["trumpet", "cornet"]), (3, {"cornet": 4}, ["cornet"]), (4, {}, [])], "ord int, counts map<string,int>, req array<string>")
    searches = spark.createDataFrame([(1, "trumpet:eq2"), (2, "trumpet:eq2,cornet:eq0"), (3, "cornet:ge2"), (4, "cornet:eq1,trumpet"), (5, "trumpet:eq0,cornet:eq0"), (6, "tuba,cornet:ge9")], "search_id int, tokens string")
    got = {(r["search_id"], r["ord"]) for r in search.run_saved_searches(works, searches, ("trumpet", "cornet")).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (3, 3), (4, 2), (5, 4), (6, 1), (6, 2), (6, 3), (6, 4)}


def test_publishing(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', None, True), (2, "a,b", "x", False)], "ord int, t string, cat string, arr boolean")
    assert tables.write_if_changed(df, f"{tmp_path}/t", ["ord", "t"]) and not tables.write_if_changed(df.repartition(2), f"{tmp_path}/t", ["ord", "t"])
    assert tables.write_if_changed(df.where("ord = 1"), f"{tmp_path}/t", ["ord", "t"])
    tables.export_csv(df.coalesce(1), f"{tmp_path}/csv")
    raw = next(p for p in (tmp_path / "csv").iterdir() if p.suffix == ".csv").read_bytes().decode()
    assert raw == '"ord","t","cat","arr"\r\n"1","say ""hi""","","yes"\r\n"2","a,b","x","no"\r\n'
    works = spark.createDataFrame([("c", 'say "hi"', None, 1900, "Suite", "two trumpets", "2 trumpets,\tharp", True), ("d", "t", "Op. 1", None, "Mass", "s", None, False)], "c string, t string, cat string, y int, g string, s string, full string, arr boolean")
    tables.export_matches(works.coalesce(1), spark.createDataFrame([("c", "Ana B")], "composer_id string, name string"), f"{tmp_path}/matches")
    raw = next(p for p in (tmp_path / "matches").iterdir() if p.suffix == ".txt").read_bytes()
    assert raw.startswith(b'\xef\xbb\xbf"Composer","Work"') and b'"Ana B","say ""hi""","","1900","Suite","two trumpets","2 trumpets,\tharp","yes"\r\n' in raw and b'"Unknown","t"' in raw
    assert tables.append_new(df, f"{tmp_path}/done", "ord").count() == 2 and tables.append_new(df.unionByName(df.withColumn("ord", F.lit(9))), f"{tmp_path}/done", "ord").count() == 3
    assert tables.load_source(spark, f"{tmp_path}/none", "a int").count() == 0
    tables.export_matches(works.where("c = 'none'"), spark.createDataFrame([("c", "Ana B")], "composer_id string, name string"), f"{tmp_path}/nothing")
    (raw,) = [p.read_bytes() for p in (tmp_path / "nothing").iterdir() if p.suffix == ".txt"]
    assert raw.startswith(b'\xef\xbb\xbf"Composer","Work"') and raw.endswith(b'"Arrangement"\r\n') and raw.count(b"\r\n") == 1
