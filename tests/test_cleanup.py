"""Display text and years of articles."""

import pytest
from pyspark.sql import functions as F

from scorelake.functions import cleanup, years

STRINGS = [
    ("cornet, 2 bassoons, violins I, violins II, violas, cellos and double basses", "cornet, 2 bassoons, strings"),
    ("3 trumpets, Violins (1st and 2nd), Violas, Cellos, Double basses", "3 trumpets, Strings"),
    ("harp, strings (1st & 2nd violins, violas, cellos, double basses)", "harp, strings"),
    ("drums and the usual string section of first and second violins, violas, cellos and double basses", "drums and the usual string section"),
    ("Harp, Strings:, 1st violins, 2nd violins, violas, cellos, double basses", "Harp, Strings"),
    ("Organ, Strings, 3 Harps, Violins (1st and 2nd), Violas, Cellos, Double basses", "Organ, Strings, 3 Harps"),
    ("Keyboard: organ, Strings: harp, violins, violas, cellos, double basses", "Keyboard: organ, Strings, harp"),
    ("cornet, and a string section consisting of four violins, three violas, two cellos and one double bass", None),
    ("Soli: 2 violins, 1 viola, 1 cello, 1 contrabass, Tutti: 6 violins, 3 violas, 2 celli, 2 contrabasses", None),
    ("cornet, violin, viola, cello, double bass", None),
    ("harp, violins, violas (with a long solo viola part), cellos, double basses", None),
    ("violins, violas, cellos, double basses (placed apart)", None),
]


@pytest.mark.parametrize(("text", "expected"), STRINGS)
def test_strings(text, expected):
    assert cleanup.plain_strings(text) == (expected or text)


def test_article_years(spark):
    rows = [("{{Infobox x|a={{b}}\n| year = {{start date|1795}}–1800\n}}", 1800, "infobox"), ("{{Infobox x}}\n| date = 2001\n[[Category:1797 compositions]]", 1797, "category"), ("[[Category:1876 compositions]][[Category:1853 operas]]", 1853, "category"), ("Written in 1832.", None, None), (None, None, None)]
    out = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", years.article_year(F.col("t"), 2030).alias("y")).collect()
    assert {r["i"]: (r["y"]["year"], r["y"]["how"]) for r in out} == {i: r[1:] for i, r in enumerate(rows)}


def test_tidy(spark):
    out = spark.range(1).select(cleanup.tidy(F.lit("a , ,b\n=== Band ===\nc\n==Music==\nd")).alias("x")).first()["x"]
    assert out == "a, b Band, c"


def test_lead_in_and_captions():
    from scorelake.functions.scoring import TRUMPETS, Grammar

    g = Grammar(TRUMPETS)
    lead = cleanup.without_lead_in
    assert lead("The work calls for 2 flutes and 2 trumpets", g) == "2 flutes and 2 trumpets"
    assert lead("It is for large orchestra and when the soprano sings. The instrumentation consists of: brass, strings", g) == "brass, strings"
    assert lead("It was written in 1910 in Paris", g) is None and lead("2 trumpets", g) == "2 trumpets"
    assert cleanup.without_captions("thumb|360px|x, 1928, 2 flutes, 1930s horn", g) == "2 flutes, 1930s horn"
    assert cleanup.without_captions("a|b 2 trumpets, c", g) == "a|b 2 trumpets, c"
    assert cleanup.before_prose("2 trumpets Commissioned by X", g) == "2 trumpets"
    assert cleanup.before_prose("flutes commissioned for 2 trumpets", g) == "flutes commissioned for 2 trumpets"


REMARKS = [
    ("3 flutes, 2 cornets, harp. The premiere took place in Leipzig in 1904", "3 flutes, 2 cornets, harp"),
    ("4 horns, trumpet, strings. It has five movements. Performances usually take about an hour", "4 horns, trumpet, strings"),
    ("2 oboes, 2 horns, trumpet, strings. Duration: 14 minutes", "2 oboes, 2 horns, trumpet, strings"),
    ("flute, trumpet, celesta, Strings, This is a larger ensemble than in the early ballets. The celesta enters to imitate a music box", "flute, trumpet, celesta, Strings"),
    ("The orchestra was unusually large for its time. The piece is scored for the following forces: 4 horns, 3 trumpets, tuba", "4 horns, 3 trumpets, tuba"),
    ("Susp. Cymb., Tpt. 1-2, Hn., Perc., B.D., strings", None),
    ("2 trumpets, organ, This is one of the few works that critics praised", "2 trumpets, organ"),
    ("flute, trumpet (the composer recalled it later), piano", None),
    ("piano, strings. Two trumpet parts were added for the revised version", None),
    ("organ, harp. For the concert in Turin the composer added a cornet part", None),
    ("harp. It has been transcribed by pupils for flute, cornet and viola", None),
    ("trumpet, piano. It was dedicated to a friend. An arrangement for cornet, organ", "trumpet, piano. An arrangement for cornet, organ"),
    ("a lively fanfare opens the work. The melody returns in the strings", ""),
    ('The finale, "Storm", contrasts an oboe melody with drums. The coda begins with trumpet fanfares', ""),
    ("{| class=wikitable, x", ""),
    ("2 cornets, drums; Click here to listen", "2 cornets, drums"),
    ("Brass: 4 horns, 2 trumpets, Woodwind: 2 flutes", None),
    ("''Large:'' oboe, 2 trumpets + harp<br>''Small:'' oboe, cornet", None),
    ("tuba, cornet<!-- or was it a bugle? -->", "tuba, cornet"),
    ("It lasts 20 minutes. Horn, trumpet, harp", "Horn, trumpet, harp"),
    ("", ""),
]


@pytest.mark.parametrize(("text", "expected"), REMARKS)
def test_commentary(text, expected):
    from scorelake.functions.commentary import without_commentary
    from scorelake.functions.scoring import TRUMPETS, Grammar

    assert without_commentary(text, Grammar(TRUMPETS)) == (text if expected is None else expected)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("*2222 – 4331 – t+2 – hp – cel. – str", "2 flutes, 2 oboes, 2 clarinets, 2 bassoons, 4 horns, 3 trumpets, 3 trombones, tuba, timpani, 2 percussion, harp, celesta, strings"),
        ("3*333 (3rd dbl. picc) - 4000, pno", "3 flutes, 3 oboes, 3 clarinets, 3 bassoons, 4 horns, piano"),
        ("11010 – 0100 – 1p", "flute, oboe, bassoon, trumpet, 1 percussion"),
        ("Oboe 1-3, Bb trumpet 1-2, tenor sax. 1-2, Horn 1-4*", "3 Oboes, 2 trumpets, 2 tenor saxophones, 4 Horns"),
        ("C trumpet, E flat clarinet, F horn, tpts 1-2", "trumpet, clarinet, horn, 2 trumpets"),
        ("cornet 1-20, Bass 2-1, Bus 1-2", "cornet 1-20, Bass 2-1, 2 Buss"),
        ("3 options, 1) wind trio, 2) string orchestra", "wind trio (also published in other scorings)"),
        ("2 flutes, harp. Also available for choir", "2 flutes, harp (also published in other scorings)"),
        ("brass, organ; 12 player version, flute", "brass, organ (also published in other scorings)"),
        ("Full orchestra, oboe, reduced string ensemble instrumentation, viola", "full orchestra, oboe (also published in other scorings)"),
        ("2 cornets (would you please say which one is for you), str", "2 cornets, strings"),
        ("harp (perc. is cued in the second part), gtr.", "harp (percussion is cued in the second part), guitar"),
        ("perc (t, sus. cymb.), red. 2", "percussion (timpani, suspended cymbal), reduction 2"),
        (" , ;", ""),
    ],
)
def test_readable_scorings(text, expected):
    from scorelake.functions.publisher import readable

    assert readable(text) == expected


def test_infobox(spark):
    rows = ["{{Infobox x|a={{b}}\n}} rest {{c}}", "a {{ infobox y {{z}}", "none", None, "{{Infobox}}"]
    out = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string").select("i", years.infobox(F.col("t")).alias("x")).collect()
    assert {r["i"]: r["x"] for r in out} == {0: "{{Infobox x|a={{b}}\n}}", 1: "{{ infobox y {{z}}", 2: "", 3: None, 4: "{{Infobox}}"}
