"""Scorings that stay parsed."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import scoring as S
from scorelake.operators.parsing import ParsedTexts, changes

TEXTS = ["2 trumpets", "3 trumpets, 2 cornets", "2 trumpets", "strings", "", None, "cornet", "bass trumpet", "flute (doubling cornet)"]
NO_CORNETS = S.Family({k: v for k, v in S.TRUMPETS.members.items() if k != "cornet"}, tuple(x for x in S.TRUMPETS.names if x[0] != "cornet"), S.TRUMPETS.out_of_scope, S.TRUMPETS.words)


@pytest.fixture
def df(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string").withColumn("text", F.lit("x")).withColumn("_n", F.lit(1))


def test_only_unseen_texts_are_parsed(spark, df, tmp_path):
    kept = ParsedTexts(spark, str(tmp_path))
    assert [kept.add(df.where("id < 2"), "t"), kept.add(df, "t"), kept.add(df, "t")] == [2, 3, 0]
    kept.forget()
    again = ParsedTexts(spark, str(tmp_path))
    assert again.add(df, "t") == 0 and again.rows().count() == 5
    out, plain = again.parse(df, "t"), S.parse_scoring(df, "t")
    key = lambda x: sorted((r["id"], str(r["scoring"].asDict(True))) for r in x.collect())
    assert out.columns == plain.columns and key(out) == key(plain)
    assert ParsedTexts(spark, str(tmp_path), grammar="another").version != again.version
    assert ParsedTexts(spark, str(tmp_path / "none")).add(df.limit(0), "t") == 0


def test_changes_between_families(spark, df, tmp_path):
    old, new = ParsedTexts(spark, str(tmp_path)), ParsedTexts(spark, str(tmp_path), NO_CORNETS)
    old.add(df, "t")
    new.add(df, "t")
    found = {r["text"]: (r["before"]["counts"], r["after"] and r["after"]["counts"]) for r in changes(old, new).collect()}
    assert found == {"3 trumpets, 2 cornets": ({"trumpet": 3, "cornet": 2}, {"trumpet": 3}), "cornet": ({"cornet": 1}, None), "flute (doubling cornet)": ({"cornet": 0}, None)}


def test_known_texts_are_not_shuffled(spark, df, tmp_path):
    kept = ParsedTexts(spark, str(tmp_path))
    kept.add(df, "t")
    plan = kept.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
