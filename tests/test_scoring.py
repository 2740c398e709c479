"""The scoring grammar on what is known of it, and its Column forms."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import scoring as S

GRAMMAR = S.Grammar(S.TRUMPETS)

COUNTS = [
    ("2 trumpets", {"trumpet": 2}),
    ("Three Trumpets", {"trumpet": 3}),
    ("4 tpt.", {"trumpet": 4}),
    ("trumpets", {"trumpet": 2}),
    ("3 B-flat trumpets", {"trumpet": 3}),
    ("4 trumpets in F or B-flat", {"trumpet": 4}),
    ("trumpet in C, E-flat clarinet, 2 cornets", {"trumpet": 1, "cornet": 2}),
    ("Trumpet 1-4", {"trumpet": 4}),
    ("Trumpet 1", {"trumpet": 1}),
    ("Trumpet 4-1", {"trumpet": 1}),
    ("Trumpet 1-99", {"trumpet": 1}),
    ("french horn 1-4, Bb trumpet 1-3, B flugelhorn, trombone 1-3", {"trumpet": 3, "flugelhorn": 1}),
    ("3 trumpets, bass trumpet", {"trumpet": 3}),
    ("2 Kornette, 3 Trompeten", {"trumpet": 3, "cornet": 2}),
    ("3 trumpets and 3 trumpets", {"trumpet": 3}),
    ("3 trumpets (3rd doubling flugelhorn)", {"trumpet": 3}),
    ("2 trumpets or 2 flugelhorns", {"trumpet": 2}),
    ("bass trumpet 4 cornet 1-2", {"cornet": 2}),
    ("trumpet 1-3 bass trumpet", {"trumpet": 3}),
    ("trumpet 1-3 flugelhorn", {"trumpet": 3, "flugelhorn": 1}),
    ("3 trumpets cornet", {"trumpet": 3, "cornet": 1}),
    ("trumpet in B-flat 1 cornet 1-2", {"trumpet": 1, "cornet": 2}),
    ("piccolo trumpet, 2 Flügelhörner", {"piccoloTrumpet": 1, "flugelhorn": 2}),
    ("string quartet", {}),
    ("", {}),
    (None, {}),
]


@pytest.mark.parametrize(("text", "counts"), COUNTS)
def test_counts(text, counts):
    assert GRAMMAR.parse(text)["counts"] == counts


def test_doublings():
    parsed = GRAMMAR.parse("5 trumpets (2nd, 3rd and 4th doubling cornet)")
    assert [(x["instrument"], x["parent"], x["player"]) for x in parsed["doublings"]] == [("cornet", "trumpet", "2nd, 3rd and 4th")]
    both = GRAMMAR.parse("3 trumpets (2nd doubling flugelhorn, third doubling cornet)")
    assert [(x["instrument"], x["player"]) for x in both["doublings"]] == [("flugelhorn", "2nd"), ("cornet", "3rd")]
    assert GRAMMAR.parse("2 trumpets (or cornets)")["doublings"] == []
    assert GRAMMAR.parse("trumpets")["uncertain"] == ["trumpet"] and GRAMMAR.parse("trumpet")["uncertain"] == []


def test_columns(spark):
    rows = [(i, t) for i, (t, _) in enumerate(COUNTS)] + [(100, "5 trumpets (1st doubling cornet), flugelhorn"), (101, "flute (doubling cornet)")]
    df = S.parse_scoring(spark.createDataFrame(rows, "id int, text string"), "text")
    s = F.col("scoring")
    out = {r["id"]: r for r in df.select("id", s.alias("s"), S.format_scoring(s).alias("f"), S.required(s).alias("req"), S.scoring_key(s).alias("k"), S.section_size(s).alias("n"), S.mentions_family(F.col("text")).alias("m")).collect()}
    for i, (t, counts) in enumerate(COUNTS):
        assert {k: v for k, v in out[i]["s"]["counts"].items()} == counts and out[i]["n"] == sum(counts.values())
        assert out[i]["m"] == GRAMMAR.mentions(t)
    assert out[1]["f"] == "three trumpets" and out[6]["f"] == "trumpet, two cornets"
    assert out[15]["f"] == "three trumpets (3rd doubling flugelhorn)" and out[15]["req"] == ["trumpet", "flugelhorn"]
    assert out[100]["f"] == "five trumpets (1st doubling cornet), flugelhorn" and out[101]["f"] == "doubling cornet" and out[101]["req"] == ["cornet"]
    assert out[1]["k"] == "piccoloTrumpet:0|trumpet:3|cornet:0|flugelhorn:0"


def test_a_formatted_scoring_parses_to_the_same_counts(spark):
    df = S.parse_scoring(spark.createDataFrame([(t,) for t, _ in COUNTS], "text string"), "text")
    again = S.parse_scoring(df.select(F.col("scoring.counts").alias("before"), S.format_scoring(F.col("scoring")).alias("f")), "f")
    for r in again.collect():
        assert r["scoring"]["counts"] == {k: v for k, v in r["before"].items() if v}
