"""The composed jobs on a small catalogue."""

import pytest

from pyspark.sql import functions as F

from scorelake.plans import jobs
from scorelake.sources import publishing


@pytest.fixture(scope="module")
def index(spark):
    schema = "ord long, composer string, composer_id string, composer_sort string, dates string, title string, cat string, year int, text string, also array<string>, arr boolean, page string, full string, note string"
    curated = [(1, "Igor Stravinsky", "stravinsky", "Stravinsky, Igor", "1882–1971", "Petrushka (1911)", None, 1911, "2 trumpets, 2 cornets", ["Petrushka"], False, None, "2 flutes, 2 trumpets, 2 cornets, violins, violas, cellos, double basses", "First version"), (2, "Nobody", None, None, None, "No brass", None, None, "2 oboes", None, False, None, None, None)]
    publisher = [(1, "Living Person", None, None, None, "Fanfare", None, 2005, "*3222 – 4231 – trumpet 1-3", None, False, None, None, None)]
    publisher += [(2, "Living Person", None, None, None, "Concerto", None, 2006, "solo trumpet; 2 trumpets, strings", None, False, None, None, None), (3, "Living Person", None, None, None, "Digits", None, 2007, "*3222 – 4231 – hp", None, False, None, None, None)]
    pages = [(1, "Maurice Ravel", None, None, None, "Boléro (Ravel)", None, None, "The work is scored for 2 flutes, 3 trumpets and strings. It is notable and lasts 15 minutes", None, False, "Boléro (Ravel)", None, None), (2, "Igor Stravinsky", None, None, None, "Petrushka", None, None, "flute, 2 trumpets", None, False, "Petrushka", None, None)]
    library = [
        (1, "Maurice Ravel", "ravel", "Ravel, Maurice", None, "Boléro, M.81", None, None, "4 trumpets", None, False, "Bolero", None, None), (2, "Maurice Ravel", "ravel", "Ravel, Maurice", None, "Boléro, M.81", None, None, "2 trumpets", None, True, "arr", None, None),
        (3, "Maurice Ravel", "ravel", "Ravel, Maurice", None, "Late piece", None, None, "trumpet", None, False, "late", None, None), (4, "No Id", None, None, None, "X", None, None, "trumpet", None, False, "x", None, None),
    ]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    years = spark.createDataFrame([("library", "Bolero", 1928), ("library", "late", 1999)], "src string, page string, year int")
    dates = spark.createDataFrame([(1, "Ravel, Joseph Maurice", 1875, 1937, None), (2, "Person, Living", 1969, None, None)], "ord int, sort string, born int, died int, alt array<string>")
    return jobs.build_index({"curated": frame(curated), "publisher": frame(publisher), "encyclopaedia": frame(pages), "library": frame(library)}, years, dates)


def test_build(index):
    works = {r["id"]: r for r in index.works.collect()}
    assert set(works) == {"curated:1", "publisher:1", "publisher:2", "publisher:3", "encyclopaedia:1", "library:2", "library:3"}
    ravel = works["encyclopaedia:1"]
    assert (ravel["t"], ravel["y"], ravel["s"], ravel["full"]) == ("Boléro", 1928, "three trumpets", "2 flutes, 3 trumpets and strings")
    assert works["library:3"]["y"] is None and works["curated:1"]["y"] == 1911 and works["library:2"]["arr"]
    assert works["publisher:1"]["full"].startswith("3 flutes, 2 oboes, 2 clarinets, 2 bassoons, 4 horns, 2 trumpets")
    assert [works[f"publisher:{i}"]["s"] for i in (1, 2, 3)] == ["three trumpets", "three trumpets", "two trumpets"] and works["publisher:2"]["full"] == "solo trumpet, 2 trumpets, strings"
    assert (works["curated:1"]["full"], works["curated:1"]["note"]) == ("2 flutes, 2 trumpets, 2 cornets, strings", "First version") and works["curated:1"]["s"] == "two trumpets, two cornets"
    people = {r["name"]: r for r in index.composers.collect()}
    assert people["Maurice Ravel"]["dates"] == "1875–1937" and (people["Maurice Ravel"]["n"], people["Maurice Ravel"]["n_arr"]) == (2, 1)
    assert people["Living Person"]["dates"] == "b. 1969" and people["Igor Stravinsky"]["dates"] == "1882–1971" and "Nobody" not in people
    s = index.statistics.first()
    assert (s["works"], s["years_kept"], s["years_rejected"], s["composers"], s["living"]) == (7, 1, 1, 3, 1)


def test_publish_and_answer(spark, index, tmp_path):
    path = str(tmp_path / "index")
    assert index.publish(path).outcome == "published" and index.publish(path).outcome == "unchanged"
    assert publishing.load(spark, path, "composers").count() == 3 and publishing.load(spark, path, "statistics").first()["works"] == 7
    batch, counts, tally = jobs.answer(index, [("trumpet", "ge", 2)], by="composer")
    assert [r["t"] for r in batch.collect()] == ["Concerto", "Digits", "Fanfare", "Boléro", "Petrushka (1911)"]
    assert counts.first()["works"] == 5 and {r["key"]: r["works"] for r in tally.collect()}["cornet"] == 1


def test_a_change_in_any_column_is_published(spark, index, tmp_path):
    path = str(tmp_path / "index")
    index.publish(path)
    one = index.works["id"] == "library:3"
    changes = {"counts": F.create_map(F.lit("trumpet"), F.lit(9)), "req": F.array(F.lit("cornet")), "g": F.lit("Other one"), "sy": F.lit(1.5), "arr": F.lit(True), "est": F.lit(True), "size": F.lit(9)}
    for name, value in changes.items():
        works = index.works.withColumn(name, F.when(one, value.cast(index.works.schema[name].dataType)).otherwise(F.col(name)))
        found = jobs.Index(works, index.composers, index.statistics).publish(path)
        assert (found.outcome, found.written) == ("published", 1), name
    index.publish(path)
    for name in ("aliases", "n", "n_arr", "born", "died", "dates", "sort"):
        kind = index.composers.schema[name].dataType
        other = F.array(F.lit("else")) if name == "aliases" else F.lit("7").cast(kind)
        people = index.composers.withColumn(name, F.when(F.col("name") == "Maurice Ravel", other).otherwise(F.col(name)))
        assert jobs.Index(index.works, people, index.statistics).publish(path).written == 1, name
    index.publish(path)
    lost = jobs.Index(index.works.where(~one), index.composers.limit(2), index.statistics)
    assert lost.publish(path).outcome == "refused" and publishing.load(spark, path, "works").count() == 7
    assert lost.publish(path, force=True).outcome == "published" and publishing.load(spark, path, "works").count() == 6


def test_unknown_sources_are_refused(spark):
    with pytest.raises(ValueError):
        jobs.build_index({"elsewhere": spark.range(1)}, spark.range(0), spark.range(0))


def test_empty_sources(spark, index):
    none = spark.createDataFrame([], "ord long, composer string, title string, text string")
    years = spark.createDataFrame([], "src string, page string, year int")
    dates = spark.createDataFrame([], "ord int, sort string, born int, died int, alt array<string>")
    built = jobs.build_index({"curated": none, "library": none}, years, dates)
    assert built.works.count() == 0 and built.composers.count() == 0
