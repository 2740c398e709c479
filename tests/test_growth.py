"""What must not grow: reads of a row, tasks of a file, rows that move."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import markup
from scorelake.plans import queries
from scorelake.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture
def articles_read(spark, monkeypatch):
    """Counts the articles that are read for their scoring."""
    seen = spark.sparkContext.accumulator(0)

    def article_scoring(wikitext, family=None):
        @F.pandas_udf("text string, how string")
        def found(texts):
            import pandas as pd

            seen.add(len(texts))
            return pd.DataFrame({"text": "2 trumpets", "how": "section"}, index=texts.index)

        return found(wikitext)

    monkeypatch.setattr(markup, "article_scoring", article_scoring)
    return seen


def test_the_funnel_reads_an_article_once(spark, articles_read):
    articles = spark.read.parquet(f"{SF}/part.parquet").count()
    assert queries.agg8_funnel(spark, SF).first()["n"] == articles
    assert articles_read.value == articles


def test_article_scorings_read_an_article_once(spark, articles_read):
    articles = spark.read.parquet(f"{SF}/part.parquet").count()
    assert queries.m6_article_scoring(spark, SF).count() == articles
    assert articles_read.value == articles


def test_the_walk_reads_an_article_once(spark, articles_read):
    articles = spark.read.parquet(f"{SF}/part.parquet").count()
    assert queries.w2_read_articles(spark, SF).where("how = 'section'").count() == articles
    assert articles_read.value == articles


def test_one_file_becomes_many_tasks(spark):
    rows = spark.range(50_000).coalesce(1)
    assert tables.spread(rows).rdd.getNumPartitions() == max(3, -(-50_000 // tables.ROWS_A_TASK))


def test_an_index_has_few_ranges_however_much_it_holds(spark, monkeypatch):
    from scorelake.operators import search

    monkeypatch.setattr(search, "MOST_RANGES", 4)
    rows = spark.range(3000).select("id", (F.col("id") * 7919 % 613).alias("k"))
    index = search.OrderIndex(rows, [F.col("k"), F.col("id")], 100)
    assert index.ranges.count() <= 4
    expected = sorted((r["k"], r["id"]) for r in rows.collect())
    for number in (0, 7, 19):
        got = sorted((r["place"], r["k"], r["id"]) for r in index.batch(number).collect())
        assert got == [(number * 150 + i + 1, *x) for i, x in enumerate(expected[number * 150 : number * 150 + 150])]


def test_keys_of_works_are_made_once(spark):
    from scorelake.operators import dedupe

    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def key(i):
        made.add(1)
        return [str(i % 7)]

    ranked = spark.range(60).select("id", F.lit(0).alias("rank"), F.col("id").alias("ord"), key("id").alias("register"), F.array(F.lit("x")).alias("query"))
    assert len(dedupe.dedupe_works(ranked, [0]).collect()) == 60
    assert made.value == 60


def test_namesakes_are_compared_few_at_a_time(spark, monkeypatch):
    from scorelake.operators import identity

    rows = spark.range(900).select(F.col("id").alias("composer_id"), F.lit("Ana Bach").alias("name"), F.lit("Bach, Ana").alias("sort"), F.lit(None).cast("array<string>").alias("aliases"), (F.col("id") % 3).alias("n"))
    seen, settle = [], identity.settled
    monkeypatch.setattr(identity, "settled", lambda df: seen.append(settle(df)) or seen[-1])
    got = identity.name_lookup(rows, spark.createDataFrame([(1, "bach")], "query_id int, text string"), 4).collect()
    assert sorted((r["rank"], r["composer_id"]) for r in got) == [(1, 2), (2, 5), (3, 8), (4, 11)]
    assert [t.count() for t in seen if "composer_id" in t.columns] == [12]


def test_places_in_all_orders_from_one_shuffle(spark):
    from scorelake.operators import search

    works = spark.createDataFrame([(1, "a", "Suite No. 10", "g", 1900, 2), (2, "a", "Suite No. 9", "h", None, 3), (3, "b", "Mass", "g", 1800, 1)], "ord int, c string, t string, g string, sy int, size int")
    found = search.places_within(works, ("genre", "title", "date", "size"))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    places = {(r["by"], r["ord"]): r["place"] for r in found.collect()}
    assert {k: v for k, v in places.items() if k[1] < 3} == {("genre", 1): 1, ("genre", 2): 2, ("title", 1): 2, ("title", 2): 1, ("date", 1): 1, ("date", 2): 2, ("size", 1): 2, ("size", 2): 1}


def test_years_are_read_by_many_tasks(spark, monkeypatch, tmp_path):
    from scorelake.plans import harvests

    asked = spark.createDataFrame([("encyclopaedia", "A"), ("encyclopaedia", "B")], "src string, page string")
    articles = spark.createDataFrame([("A", "[[Category:1900 compositions]]"), ("B", "#REDIRECT [[A]]"), ("C", "")], "title string, wikitext string")
    dealt, spread = [], tables.spread
    monkeypatch.setattr(tables, "spread", lambda df: dealt.append(spread(df)) or dealt[-1])
    got = harvests.read_years(asked, spark.createDataFrame([], "page string, wikitext string"), articles, str(tmp_path / "years"), 2030).collect()
    assert sorted((r["page"], r["year"], r["how"]) for r in got) == [("A", 1900, "category"), ("B", 1900, "category")]
    assert [df.rdd.getNumPartitions() for df in dealt] == [3]


def test_works_named_alike_are_keyed_and_decided_once(spark, monkeypatch):
    import random

    from scorelake.operators import dedupe

    r, sources = random.Random(5), ["curated", "publisher", "library"]
    titles = ["Suite", "Suite No. 2", "Mass, Op.3", None, "Boléro (ballet)"]
    rows = [
        (f"w{i}", rank * (1 << 40) + i, rank, sources[rank], r.choice("ab"), r.choice(titles), r.choice([None, None, "Op. 3"]), ["Suite No. 2"] if rank == 0 and i % 4 == 0 else None, i % 5 == 0, r.choice([None, 0, 1800 + i]), False)
        for i in range(240) for rank in [i % 3 if i < 90 else 1 + i % 2]
    ]
    works = tables.settled(spark.createDataFrame(rows, "id string, ord long, rank int, src string, c string, t string, cat string, also array<string>, arr boolean, y int, harvested boolean"))
    plain = dedupe.with_keys(works.where("rank = 0"), "curated").unionByName(dedupe.with_keys(works.where("rank = 1"), "publisher")).unionByName(dedupe.with_keys(works.where("rank = 2"), "library"))
    ranked = tables.settled(dedupe.dedupe_works(plain, [0, 1, 2]))
    kept = {x["id"]: (x["y"], False) for x in ranked.where("kept").collect()}
    handed = dedupe.backfill_years(ranked.withColumn("y", F.when(F.col("kept") | (F.col("src") == "library"), F.col("y")))).collect()
    assert handed and len(kept) < 150
    kept |= {x["id"]: (x["y"], True) for x in handed}
    keyed, with_keys = [], dedupe.with_keys
    monkeypatch.setattr(dedupe, "with_keys", lambda df, name: keyed.append(df.count()) or with_keys(df, name))
    got = {x["id"]: (x["y"], x["harvested"]) for x in dedupe.merge_works(works, sources).collect()}
    assert got == kept
    assert sum(keyed) == len({(x[3], x[4], x[5], x[6], str(x[7]), x[8]) for x in rows}) < 150


def test_only_works_without_a_year_move_for_one(spark):
    from scorelake.operators import tallies

    works = tables.settled(spark.createDataFrame([(1, "a", 1900), (2, "b", None), (3, None, 0), (4, "c", 0)], "ord int, page string, y int"))
    years = spark.createDataFrame([("a", 1800), ("b", 1850), ("b", 1840)], "page string, year int")
    found = tallies.attach_years(works, years, ["page"])
    assert sorted((r["ord"], r["y"], r["harvested"]) for r in found.collect()) == [(1, 1900, False), (2, 1840, True), (3, None, False), (4, None, False)]
    left = [p for p in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in p and "ord" not in p and "isnotnull(page" in p]
    assert any("= 0" in p for p in left)


def test_names_are_folded_once_each(spark, monkeypatch):
    from scorelake.operators import identity

    seen, settle = [], identity.settled
    monkeypatch.setattr(identity, "settled", lambda df: seen.append(settle(df)) or seen[-1])
    rows = spark.range(400).selectExpr("0 AS rank", "id AS ord", "CASE WHEN id % 2 = 0 THEN 'Ána Bach' WHEN id < 300 THEN 'Ana Bach' END AS name", "CAST(NULL AS STRING) AS id", "CAST(NULL AS STRING) AS sort", "CAST(NULL AS STRING) AS dates", "CAST(NULL AS ARRAY<STRING>) AS aliases")
    linked, composers = identity.resolve_composers(rows)
    assert {(r["composer_id"], r["n"]) for r in linked.groupBy("composer_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {("bach-ana", 350), ("", 50)}
    assert [r["name"] for r in composers.where("composer_id = 'bach-ana'").collect()] == ["Ána Bach"]
    assert max(t.count() for t in seen) == 3
