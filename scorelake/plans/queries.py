"""The registered queries for the operators over catalogues, and DuckDB SQL for what they should return."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import cleanup, commentary, keys, markup, publisher, scoring, text, years
from ..operators import chronology, dedupe, harvest, identity, parsing, search, tallies
from ..sources import publishing, tables
from . import derived as d
from . import harvests, jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}
FAMILY = scoring.TRUMPETS
KEYS = FAMILY.keys


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, text, scoring) of every order."""
    return scoring.parse_scoring(tables.settled(d.derive(spark, sf_dir, d.SPARK_TEXTS)), "text")


# ── scalar functions ──────────────────────────────────────────────────────────

_DUCK_FOLD = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"


@query("k1_fold", f"SELECT doc_id, sha256({_DUCK_FOLD.format('text')}) AS folded FROM documents")
def k1_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("folded"))


@query("k2_slug", f"SELECT p_partkey, replace({_DUCK_FOLD.format(chr(39) + 'É ' + chr(39) + ' || p_name')}, ' ', '-') AS slug FROM part")
def k2_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(F.concat(F.lit("É "), "p_name")).alias("slug"))


@query("k3_sort_form", "SELECT p_partkey, string_split(p_name, ' ')[-1] || ', Ann' || CASE WHEN len(string_split(p_name, ' ')) > 1 THEN ' ' || array_to_string(string_split(p_name, ' ')[1:-2], ' ') ELSE '' END AS sort FROM part")
def k3_sort_form(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.sort_form(F.concat(F.lit("Ann "), "p_name")).alias("sort"))


@query("k4_display_name", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || ' ' || p_name WHEN 1 THEN p_brand || ', Jr ' || p_name ELSE p_name END AS display FROM part")
def k4_display_name(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(k == 0, F.concat(F.lit(", "), "p_brand")).when(k == 1, F.concat(F.lit(", "), "p_brand", F.lit(", Jr"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.display_name(name).alias("display"))


@query(
    "k5_title_composer",
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name || ' (' || p_type || ')' ELSE p_name END AS title,
       CASE p_partkey % 3 WHEN 0 THEN p_type || ', ' || p_brand WHEN 1 THEN 'Anonymous' END AS composer FROM part""",
)
def k5_title_composer(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    inside = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit(", "), "p_brand")).when(F.col("p_partkey") % 3 == 1, "Anonymous").otherwise(F.col("p_type"))
    page = F.concat("p_name", F.lit(" ("), inside, F.lit(")"))
    return part.select("p_partkey", text.title_composer(page).alias("x")).select("p_partkey", "x.*")


@query("k6_without_disambiguator", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '(' || p_brand || ')' ELSE p_name END AS title FROM part")
def k6_without_disambiguator(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    full = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("("), "p_brand", F.lit(")"))).otherwise(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")))
    return part.select("p_partkey", text.without_disambiguator(full).alias("title"))


@query(
    "k8_work_key",
    f"SELECT ord, c || '::' || replace(regexp_replace({_DUCK_FOLD.format('t')}, '\\b(no|op|the|a|in|major|minor|for)\\b', '', 'g'), ' ', '') AS work_key FROM ({d.WORKS}) w",
)
def k8_work_key(spark, sf_dir):
    return d.derive(spark, sf_dir, d.WORKS).select("ord", keys.work_key(F.col("c"), F.col("t")).alias("work_key"))


@query("k9_catalogue_key", f"SELECT ord, c || '::cat::' || replace({_DUCK_FOLD.format('cat')}, ' ', '') AS catalogue_key FROM ({d.WORKS}) w")
def k9_catalogue_key(spark, sf_dir):
    return d.derive(spark, sf_dir, d.WORKS).select("ord", keys.catalogue_key(F.col("c"), F.col("cat")).alias("catalogue_key"))


@query(
    "k10_form_key",
    f"SELECT ord, c || '::form::' || CASE form WHEN 'Symphony' THEN '-symphony-' WHEN 'Suite' THEN '-suite-' ELSE 'piano-concerto-' END || n AS form_key FROM ({d.WORKS}) w",
)
def k10_form_key(spark, sf_dir):
    return d.derive(spark, sf_dir, d.WORKS).select("ord", keys.form_key(F.col("c"), F.col("t")).alias("form_key"))


@query(
    "k11_catalogue_parts",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'K.' || p_partkey || '/' || p_size || 'a;K.' || p_partkey || ';K.' || p_size || 'a'
       WHEN 1 THEN 'K. ' || p_partkey || '+' || p_size || ';K. ' || p_partkey || ';K. ' || p_size WHEN 2 THEN 'H.' || p_partkey || '/' || p_size
       ELSE 'K.' || p_partkey || '/' || p_size || ';K.' || p_partkey END AS parts FROM part""",
)
def k11_catalogue_parts(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    cat = (
        F.when(k == 0, F.concat(F.lit("K."), "p_partkey", F.lit("/"), "p_size", F.lit("a"))).when(k == 1, F.concat(F.lit("K. "), "p_partkey", F.lit("+"), "p_size"))
        .when(k == 2, F.concat(F.lit("H."), "p_partkey", F.lit("/"), "p_size")).otherwise(F.concat(F.lit("K."), "p_partkey", F.lit("/"), "p_size"))
    )
    return part.select("p_partkey", F.array_join(keys.catalogue_parts(cat), ";").alias("parts"))


@query(
    "k12_extra_keys",
    """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x::cat::m' || p_size || ';' ELSE '' END || 'x::bare::' || replace(p_name, ' ', '') AS query,
       CASE WHEN p_partkey % 2 = 0 THEN 'x::cat::m' || p_size ELSE 'x::bare::' || replace(p_name, ' ', '') END AS register FROM part""",
)
def k12_extra_keys(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(", M."), "p_size")).otherwise(F.concat("p_name", F.lit(" (ballet)")))
    both = keys.extra_keys(F.lit("x"), title, F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(both["query"], ";").alias("query"), F.array_join(both["register"], ";").alias("register"))


@query(
    "k13_arrangement_scope",
    f"SELECT ord, row_number() OVER (PARTITION BY c, form, ord % 2, arr ORDER BY ord) = 1 AS kept FROM ({d.WORKS}) w",
)
def k13_arrangement_scope(spark, sf_dir):
    """Works of one title: an arrangement drops for an arrangement, an original for an original."""
    works = d.derive(spark, sf_dir, d.WORKS).select(F.col("ord").alias("id"), "ord", F.lit(3).alias("rank"), "c", "arr", F.concat("form", F.when(F.col("ord") % 2 == 0, " even").otherwise(" odd")).alias("t"), F.lit(None).cast("string").alias("cat"))
    none = works.where("false").withColumn("rank", F.lit(0))
    ranked = dedupe.with_keys(works, "library").unionByName(dedupe.with_keys(none, "curated"))
    return dedupe.dedupe_works(ranked, [0, 3]).select(F.col("id").alias("ord"), "kept")


@query(
    "k15_genre_from_title",
    f"SELECT genre, count(*) AS works FROM (SELECT CASE form WHEN 'Symphony' THEN 'Symphony' WHEN 'Suite' THEN 'Suite' ELSE 'Concerto' END AS genre FROM ({d.WORKS}) w) g GROUP BY genre",
)
def k15_genre_from_title(spark, sf_dir):
    return d.derive(spark, sf_dir, d.WORKS).groupBy(keys.genre_from_title(F.col("t"), F.lit("Orchestral")).alias("genre")).agg(F.count(F.lit(1)).alias("works"))


@query("k19_page_id", "SELECT p_partkey, replace(p_name, ' ', '_') || '_(É)' AS page_id, 'https://x.org/wiki/' || replace(p_name, ' ', '_') || '_(%C3%89)' AS url FROM part")
def k19_page_id(spark, sf_dir):
    title = F.concat("p_name", F.lit(" (É)"))
    return table(spark, sf_dir, "part").select("p_partkey", keys.page_id(title).alias("page_id"), keys.page_url(title, "https://x.org/wiki").alias("url"))


_SUFFIX_ORDER = "CASE ord % 4 WHEN 2 THEN 1 WHEN 1 THEN 2 ELSE 0 END"


@query("srt3_natural_key", f"SELECT t, row_number() OVER (ORDER BY form, n, suffix) AS place FROM (SELECT DISTINCT form, n, {_SUFFIX_ORDER} AS suffix, t FROM ({d.WORKS}) w) x")
def srt3_natural_key(spark, sf_dir):
    titles = d.derive(spark, sf_dir, d.WORKS).select("t").distinct()
    return search.placed(titles.withColumn("k", text.natural_key(F.col("t"))), "k").select("t", "place")


# ── scorings ──────────────────────────────────────────────────────────────────


@query("p_parse_scoring", f"SELECT ord, n0, n1, n2, n3, total, guessed FROM ({d.COUNTS}) c")
def p_parse_scoring(spark, sf_dir):
    s = F.col("scoring")
    return scored(spark, sf_dir).select("ord", *[scoring.count_of(s, k).alias(f"n{i}") for i, k in enumerate(KEYS)], s["total"].alias("total"), F.size(s["uncertain"]).alias("guessed"))


#: The family without cornets.
_NO_CORNETS = scoring.Family({k: v for k, v in FAMILY.members.items() if k != "cornet"}, tuple(x for x in FAMILY.names if x[0] != "cornet"), FAMILY.out_of_scope, FAMILY.words)
#: Each order's text, whether it names the family, and whether it names a cornet.
_NAMING = f"SELECT ord, string_agg(segment, ', ' ORDER BY i) AS text, bool_or(i < 4 OR i = 5) AS named, bool_or(i = 2) AS cornet FROM ({d.SEGMENTS}) GROUP BY ord"


@query(
    "p_parsed_texts",
    f"""WITH t AS ({_NAMING}), k AS (SELECT text, min(CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END) AS batch, bool_or(cornet) AS cornet FROM t WHERE named GROUP BY text)
    SELECT 'first batch' AS what, count(CASE WHEN batch = 0 THEN 1 END) AS texts FROM k UNION ALL SELECT 'second batch', count(CASE WHEN batch = 1 THEN 1 END) FROM k
    UNION ALL SELECT 'again', 0 UNION ALL SELECT 'changed without cornets', count(CASE WHEN cornet THEN 1 END) FROM k UNION ALL SELECT 'players', sum(total) FROM ({d.COUNTS}) c""",
)
def p_parsed_texts(spark, sf_dir):
    texts, path = tables.settled(d.derive(spark, sf_dir, d.SPARK_TEXTS)), _folder(spark, "parsed")
    kept, other = parsing.ParsedTexts(spark, path), parsing.ParsedTexts(spark, path, _NO_CORNETS)
    rows = [("first batch", kept.add(texts.where("ord % 3 = 0"), "text")), ("second batch", kept.add(texts, "text")), ("again", parsing.ParsedTexts(spark, path).add(texts, "text"))]
    other.add(texts, "text")
    rows += [("changed without cornets", parsing.changes(kept, other).count()), ("players", kept.parse(texts, "text").agg(F.sum("scoring.total")).first()[0])]
    for t in (kept, other):
        t.forget()
    return spark.createDataFrame(rows, "what string, texts long")


_WORD = "CASE WHEN {n} = 1 THEN '{one}' WHEN {n} > 0 THEN ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve'][{n} + 1] || ' {one}s' END"
_FORMAT = "concat_ws(', ', " + ", ".join(_WORD.format(n=f"n{i}", one=one) for i, (one, _) in enumerate(FAMILY.members.values())) + ")"


@query("p13_format_scoring", f"SELECT {_FORMAT} AS s, count(*) AS works FROM ({d.COUNTS}) c GROUP BY 1")
def p13_format_scoring(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(scoring.format_scoring(F.col("scoring")).alias("s")).agg(F.count(F.lit(1)).alias("works"))


_REQ = "concat_ws(',', " + ", ".join(f"CASE WHEN n{i} > 0 THEN '{k}' END" for i, k in enumerate(KEYS)) + ")"


@query("p14_required_instruments", f"SELECT ord, {_REQ} AS req FROM ({d.COUNTS}) c")
def p14_required(spark, sf_dir):
    return scored(spark, sf_dir).select("ord", F.array_join(scoring.required(F.col("scoring")), ",").alias("req"))


@query("p15_scoring_key", "SELECT " + " || '|' || ".join(f"'{k}:' || n{i}" for i, k in enumerate(KEYS)) + f" AS scoring_key, count(*) AS works FROM ({d.COUNTS}) c GROUP BY 1")
def p15_scoring_key(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(scoring.scoring_key(F.col("scoring")).alias("scoring_key")).agg(F.count(F.lit(1)).alias("works"))


@query("p16_from_category", f"SELECT ord, text, ord % 2 = 0 AS arrangement FROM ({d.DUCK_TEXTS}) t")
def p16_from_category(spark, sf_dir):
    texts = d.derive(spark, sf_dir, d.SPARK_TEXTS)
    name = F.concat(F.lit("For "), "text", F.when(F.col("ord") % 2 == 0, " (arr)").otherwise(""))
    return texts.select("ord", scoring.from_category(name).alias("x")).select("ord", "x.*")


@query("flt1_mentions_family", f"SELECT ord, count(CASE WHEN i < 4 THEN 1 END) > 0 AS mentions FROM ({d.PARTS}) p GROUP BY ord")
def flt1_mentions_family(spark, sf_dir):
    return d.derive(spark, sf_dir, d.SPARK_TEXTS).select("ord", scoring.mentions_family(F.col("text")).alias("mentions"))


@query(
    "flt2_first_mention",
    f"SELECT ord, least(nullif(instr(text, 'piccolo trumpet'), 0), nullif(instr(text, 'trumpet'), 0), nullif(instr(replace(text, 'cornetto', 'xxxxxxxx'), 'cornet'), 0), nullif(instr(text, 'flugelhorn'), 0)) - 1 AS place FROM ({d.DUCK_TEXTS}) t",
)
def flt2_first_mention(spark, sf_dir):
    place = scoring.first_mention(F.col("text"))
    return d.derive(spark, sf_dir, d.SPARK_TEXTS).select("ord", F.when(place >= 0, place).cast("long").alias("place"))


def index(spark, sf_dir) -> DataFrame:
    """Works with counts, required members and section size."""
    s = F.col("scoring")
    parts = scored(spark, sf_dir).select(F.col("ord").alias("_o"), s["counts"].alias("counts"), scoring.required(s).alias("req"), scoring.section_size(s).alias("size"))
    works = d.derive(spark, sf_dir, d.WORKS)
    return works.join(parts, works["ord"] == parts["_o"]).drop("_o")


_INDEX = f"SELECT w.*, n0, n1, n2, n3, total FROM ({d.WORKS}) w JOIN ({d.COUNTS}) k ON w.ord = k.ord"


@query("flt7_match_instruments", f"SELECT c, count(*) AS works FROM ({_INDEX}) x WHERE n1 = 2 AND n2 = 0 GROUP BY c")
def flt7_match_instruments(spark, sf_dir):
    rules = [("trumpet", "eq", 2), ("cornet", "eq", 0)]
    works = index(spark, sf_dir).where(search.match_instruments(rules, F.col("counts"), F.col("req")))
    return works.groupBy("c").agg(F.count(F.lit(1)).alias("works"))


_SAVED = "SELECT n_nationkey AS search_id, CASE n_nationkey % 4 WHEN 0 THEN 'trumpet:eq2,cornet' WHEN 1 THEN 'flugelhorn:ge3,tuba' WHEN 2 THEN 'trumpet:eq4,cornet:eq0' ELSE 'cornet:eq9,piccoloTrumpet,trumpet:ge2' END AS tokens FROM nation"


@query(
    "flt8_saved_searches",
    f"""SELECT search_id, count(*) AS works FROM (SELECT n_nationkey AS search_id, n_nationkey % 4 AS k FROM nation) s JOIN ({_INDEX}) x
        ON CASE k WHEN 0 THEN n1 = 2 AND n2 > 0 WHEN 1 THEN n3 >= 3 WHEN 2 THEN n1 = 4 AND n2 = 0 ELSE n0 > 0 AND n1 >= 2 END GROUP BY search_id""",
)
def flt8_saved_searches(spark, sf_dir):
    searches = d.derive(spark, sf_dir, _SAVED)
    return search.run_saved_searches(index(spark, sf_dir), searches, KEYS).groupBy("search_id").agg(F.count(F.lit(1)).alias("works"))


@query("flt6_toggles", f"SELECT count(*) AS works FROM ({d.WORKS}) w WHERE NOT arr AND NOT est")
def flt6_toggles(spark, sf_dir):
    return search.toggles(d.derive(spark, sf_dir, d.WORKS), inferred=False).agg(F.count(F.lit(1)).alias("works"))


@query("flt10_plausibility_report", f"SELECT ord, total AS size FROM ({_INDEX}) x WHERE NOT arr AND total > 6 AND ord % 3 > 0 ORDER BY total DESC, ord LIMIT 20")
def flt10_plausibility(spark, sf_dir):
    works = index(spark, sf_dir).withColumn("src", F.when(F.col("ord") % 3 == 0, "curated").otherwise("library"))
    return tallies.plausibility_report(works).select("ord", "size")


# ── aggregations, orders ──────────────────────────────────────────────────────


@query("agg1_works_per_composer", f"SELECT c, count(CASE WHEN NOT arr THEN 1 END) AS n, count(CASE WHEN arr THEN 1 END) AS n_arr FROM ({d.WORKS}) w GROUP BY c")
def agg1_works_per_composer(spark, sf_dir):
    return tallies.works_per_composer(d.derive(spark, sf_dir, d.WORKS))


@query(
    "agg3_instrument_tally",
    " UNION ALL ".join(f"SELECT '{k}' AS key, count(*) AS works FROM ({d.COUNTS}) c WHERE n{i} > 0" for i, k in enumerate(KEYS)),
)
def agg3_instrument_tally(spark, sf_dir):
    return search.instrument_tally(index(spark, sf_dir), KEYS)


@query("agg4_matches", f"SELECT count(*) AS works, count(DISTINCT c) AS composers FROM ({d.WORKS}) w WHERE NOT arr")
def agg4_matches(spark, sf_dir):
    return tallies.match_counts(search.toggles(d.derive(spark, sf_dir, d.WORKS)))


@query("agg6_by_genre", f"SELECT form AS g, count(*) AS works FROM ({d.WORKS}) w GROUP BY form")
def agg6_by_genre(spark, sf_dir):
    return tallies.works_by(d.derive(spark, sf_dir, d.WORKS).withColumn("g", F.col("form")), "g")


@query("agg11_data_date", "SELECT max(greatest(o_orderdate, l.shipped)) AS stamp FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey")
def agg11_data_date(spark, sf_dir):
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    return table(spark, sf_dir, "orders").join(shipped, "o_orderkey").agg(tallies.data_date(F.col("o_orderdate"), F.col("shipped")).alias("stamp"))


@query(
    "agg12_greater_count",
    f"""WITH p AS (SELECT ord % 5000 AS id, ord, n1, c, form FROM ({_INDEX}) x), f AS (SELECT id, min(ord) AS ord FROM p GROUP BY id),
    o AS (SELECT p.* FROM p JOIN f USING (id, ord)) SELECT max(n1) AS trumpets, arg_min(ord, (-n1, ord)) AS ord FROM o GROUP BY c, form""",
)
def agg12_greater_count(spark, sf_dir):
    n = F.coalesce(F.element_at("counts", F.lit("trumpet")), F.lit(0)).alias("trumpets")
    title = F.concat("c", F.lit(" "), "form", F.when(F.col("ord") % 2 == 0, " – PDF download").otherwise("!"))
    products = index(spark, sf_dir).select((F.col("ord") % 5000).alias("id"), "ord", title.alias("title"), n)
    return tallies.merge_products(products).select("trumpets", "ord")


@query("agg13_section_size", f"SELECT total AS size, count(*) AS works FROM ({d.COUNTS}) c GROUP BY total")
def agg13_section_size(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(scoring.section_size(F.col("scoring")).alias("size")).agg(F.count(F.lit(1)).alias("works"))


#: A search of every customer: up to four rules, by the digits of the customer's number.
_CUSTOMER_RULES = " UNION ALL ".join(
    f"SELECT c_custkey AS id, '{k}' AS key, (c_custkey // {10**i}) % 8 AS r, {i} AS i FROM customer" for i, k in enumerate(("trumpet", "cornet", "flugelhorn", "piccoloTrumpet"))
)


@query(
    "flt8_count_searches",
    f"""WITH r AS (SELECT id, key, CASE r WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 2 END AS lo, CASE WHEN r IN (1, 2, 3, 4) THEN r - 1 ELSE 1000000 END AS hi FROM ({_CUSTOMER_RULES}) c WHERE r < 6),
    x AS ({_INDEX}), k AS (SELECT n0, n1, n2, n3, count(*) AS n FROM x GROUP BY n0, n1, n2, n3),
    s AS (SELECT c_custkey AS id FROM customer), m AS (SELECT r.id, n0, n1, n2, n3, max(n) AS n FROM r, k WHERE CASE key WHEN 'piccoloTrumpet' THEN n0 WHEN 'trumpet' THEN n1 WHEN 'cornet' THEN n2 ELSE n3 END BETWEEN lo AND hi
      GROUP BY r.id, n0, n1, n2, n3 HAVING count(*) = (SELECT count(*) FROM r q WHERE q.id = r.id))
    SELECT s.id AS search_id, CAST(CASE WHEN s.id IN (SELECT id FROM r) THEN coalesce((SELECT sum(n) FROM m WHERE m.id = s.id), 0) ELSE (SELECT count(*) FROM x) END AS BIGINT) AS works FROM s""",
)
def flt8_count_searches(spark, sf_dir):
    tests = F.array(*map(F.lit, ("", ":eq0", ":eq1", ":eq2", ":eq3", ":ge2")))
    said = [F.when((d_ := F.floor(F.col("c_custkey") / 10**i).cast("long") % 8) < 6, F.concat(F.lit(k), F.get(tests, d_.cast("int")))) for i, k in enumerate(("trumpet", "cornet", "flugelhorn", "piccoloTrumpet"))]
    searches = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("search_id"), F.concat_ws(",", *said).alias("tokens"))
    return search.count_saved_searches(index(spark, sf_dir), searches, KEYS)


@query("srt2_page_by_size", f"SELECT ord, total AS size FROM ({_INDEX}) x ORDER BY total DESC, c, ord LIMIT 150 OFFSET 150")
def srt2_page_by_size(spark, sf_dir):
    works = index(spark, sf_dir).withColumn("composer_sort", F.col("c"))
    return search.page(works, search.ordering("size"), 1).select("ord", "size")


@query("srt4_top_composers", f"SELECT c, count(*) AS n FROM ({d.WORKS}) w GROUP BY c ORDER BY n DESC, c LIMIT 40")
def srt4_top_composers(spark, sf_dir):
    return tallies.top_composers(d.derive(spark, sf_dir, d.WORKS), 40)


@query("set2_not_yet_read", "SELECT o_orderkey AS title FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3")
def set2_not_yet_read(spark, sf_dir):
    read = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_orderkey").alias("title"))
    return harvest.unread(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("title")), read)


@query(
    "win1_best_candidate",
    """SELECT l_orderkey AS page, raw, CAST(alternate AS BIGINT) AS alternate FROM (SELECT *, CASE WHEN n = 1 THEN 0 WHEN raw <> first THEN sum(CASE WHEN n > 1 AND raw <> first THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n) END AS alternate
       FROM (SELECT *, first_value(raw) OVER (PARTITION BY l_orderkey ORDER BY n) AS first FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, raw, l_partkey, l_suppkey, l_extendedprice, l_linenumber) AS n
       FROM (SELECT *, l_shipdate || '|' || l_linenumber AS raw0, concat(CAST(l_quantity AS INT) % 5, '-', l_linenumber) AS raw, CAST(l_quantity AS INT) % 5 AS score FROM lineitem) a) b) c) e WHERE alternate <= 4""",
)
def win1_best_candidate(spark, sf_dir):
    score = F.col("l_quantity").cast("int") % 5
    lines = table(spark, sf_dir, "lineitem").withColumn("score", score).withColumn("raw", F.concat(score, F.lit("-"), "l_linenumber"))
    best = [F.desc("score"), F.col("raw"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"), F.col("l_linenumber")]
    return search.alternates(lines, "l_orderkey", best).select(F.col("l_orderkey").alias("page"), "raw", F.col("alternate").cast("long").alias("alternate"))


# ── time ──────────────────────────────────────────────────────────────────────

_NEIGHBOURS = """{0}_a AS (SELECT ord, max_by(struct_pack(n := n, y := y), n) FILTER (WHERE y IS NOT NULL AND NOT arr) OVER (PARTITION BY c, {1} ORDER BY n RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
  min_by(struct_pack(n := n, y := y), n) FILTER (WHERE y IS NOT NULL AND NOT arr) OVER (PARTITION BY c, {1} ORDER BY n RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f, n, arr FROM w WHERE {2}),
{0} AS (SELECT ord, CASE WHEN arr THEN NULL WHEN p IS NOT NULL AND f IS NOT NULL THEN CASE WHEN p.y >= f.y THEN p.y + 0.001::DOUBLE * (n - p.n) ELSE p.y + (f.y - p.y) * (n - p.n)::DOUBLE / (f.n - p.n) END
  WHEN p IS NOT NULL THEN p.y + 0.001::DOUBLE * (n - p.n) WHEN f IS NOT NULL THEN f.y - 0.001::DOUBLE * (f.n - n) END AS e FROM {0}_a)"""


@query(
    "win3_sort_years",
    f"""WITH w AS ({d.WORKS}), {_NEIGHBOURS.format('s', 'form', 'true')}, {_NEIGHBOURS.format('k', "'op'", "cat LIKE 'Op.%'")}
    SELECT w.ord, floor(coalesce(w.y, s.e, k.e) * 1000 + 0.5) / 1000 AS sy FROM w LEFT JOIN s ON w.ord = s.ord LEFT JOIN k ON w.ord = k.ord""",
)
def win3_sort_years(spark, sf_dir):
    return chronology.assign_sort_years(d.derive(spark, sf_dir, d.WORKS)).select("ord", "sy")


#: A two-digit end belongs to the century of the start; across centuries the start counts.
_FIELD_YEAR = f"""SELECT ord, CAST(CASE WHEN ord % 6 = 4 THEN NULL WHEN ord % 6 = 2 AND yr // 100 > (yr - 1) // 100 THEN yr - 1
    WHEN ord % 6 = 5 AND yr // 100 > (yr - 5) // 100 THEN yr - 5 ELSE yr END AS INT) AS year FROM ({d.YEAR_FIELDS}) f"""


@query("d1_field_year", _FIELD_YEAR)
def d1_field_year(spark, sf_dir):
    return d.derive(spark, sf_dir, d.YEAR_FIELDS).select("ord", years.field_year(F.col("text"), 2100).alias("year"))


@query("d2_page_year", _FIELD_YEAR)
def d2_page_year(spark, sf_dir):
    wiki = F.concat(F.lit("{{Work\n|Title=1234\n|Year="), "text", F.lit("\n|Key=C 1999\n}}"))
    return d.derive(spark, sf_dir, d.YEAR_FIELDS).select("ord", years.page_year(wiki, "Year", 2100).alias("year"))


@query("d4_product_year", "SELECT o_orderkey AS ord, CAST(CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE year(o_orderdate) END AS INT) AS year FROM orders")
def d4_product_year(spark, sf_dir):
    yr, k = F.year("o_orderdate"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.concat(F.lit("Premiered in 1985. Composed in "), yr)).when(k == 1, F.concat(F.lit("Fanfare ("), yr, F.lit(")"))).when(k == 2, F.concat(F.lit("written in "), yr)).otherwise(F.lit("composed in 1979"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), years.product_year(said, 2100).alias("year"))


_LIVES = "SELECT s_suppkey AS id, CAST(1700 + s_suppkey % 290 AS INT) AS b, CAST(1700 + s_suppkey % 290 + 50 AS INT) AS e, s_suppkey % 4 AS k FROM supplier"


@query(
    "d9_show_dates",
    f"""SELECT id, CASE WHEN k = 0 THEN b || '–' || e WHEN k = 1 THEN CASE WHEN b >= 1900 THEN 'b. ' || b ELSE b || '–?' END WHEN k = 2 THEN 'd. ' || e END AS dates,
        CASE WHEN k = 0 THEN 'both' WHEN k = 1 THEN CASE WHEN b >= 1900 THEN 'living' ELSE 'death unrecorded' END WHEN k = 2 THEN 'death only' ELSE 'none' END AS form FROM ({_LIVES}) l""",
)
def d9_show_dates(spark, sf_dir):
    lives = d.derive(spark, sf_dir, _LIVES)
    born, died = F.when(F.col("k") < 2, F.col("b")), F.when(F.col("k").isin(0, 2), F.col("e"))
    return lives.select("id", years.show_dates(born, died).alias("dates"), years.date_form(born, died).alias("form"))


@query("d8_lifespan", f"SELECT id, CASE WHEN k < 2 THEN b END AS born, CASE WHEN k IN (0, 2) THEN e END AS died FROM ({_LIVES}) l")
def d8_lifespan(spark, sf_dir):
    lives = d.derive(spark, sf_dir, _LIVES)
    born, died = F.when(F.col("k") < 2, F.col("b")), F.when(F.col("k").isin(0, 2), F.col("e"))
    return lives.select("id", years.lifespan(years.show_dates(born, died)).alias("x")).select("id", "x.*")


@query("agg10_date_forms", f"SELECT CASE WHEN k = 0 THEN 'both' WHEN k = 1 THEN CASE WHEN b >= 1900 THEN 'living' ELSE 'death unrecorded' END WHEN k = 2 THEN 'death only' ELSE 'none' END AS form, count(*) AS n FROM ({_LIVES}) l GROUP BY 1")
def agg10_date_forms(spark, sf_dir):
    return d9_show_dates(spark, sf_dir).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


@query("d5_person", f"SELECT id, b AS born, CASE WHEN k < 3 THEN e END AS died, k = 3 AS suspect FROM ({_LIVES}) l")
def d5_person(spark, sf_dir):
    lives = d.derive(spark, sf_dir, _LIVES)
    died = F.when(F.col("k") < 3, F.concat(F.lit("Vienna, "), "e")).otherwise(F.concat(F.lit("c. "), F.col("b") - 9))
    return lives.select("id", years.person(F.concat(F.lit("around "), "b"), died, 2100).alias("x")).select("id", "x.*")


@query("flt9_plausible_year", f"SELECT ord, CASE WHEN y < 1990 + 5 OR y > 1999 THEN NULL ELSE y END AS y FROM ({d.WORKS}) w")
def flt9_plausible_year(spark, sf_dir):
    return d.derive(spark, sf_dir, d.WORKS).select("ord", years.plausible_year(F.col("y"), F.lit(1990), F.lit(1999)).alias("y"))


# ── identity and duplicates ───────────────────────────────────────────────────

_FOLDED = _DUCK_FOLD.format("name")
_SORT = "string_split_regex(trim(name), '\\s+')"


#: Of the names with "Bea", those with certain numbers are known to be other spellings.
_VARIANT = "name LIKE 'Maria Bea Kund%' AND TRY_CAST(substr(name, 15) AS INT) % 10 = 3"


@query(
    "jn1_resolve_composers",
    f"""WITH v AS (SELECT *, {_VARIANT} AS other FROM ({d.PEOPLE}) x),
    r AS (SELECT rank, ord, CASE WHEN other THEN replace(name, 'Bea', 'Ana') ELSE name END AS name, CASE WHEN other THEN NULL ELSE id END AS id, dates, CASE WHEN other THEN name END AS alias FROM v),
    p AS (SELECT *, {_FOLDED} AS key, list_last({_SORT}) || ', ' || array_to_string({_SORT}[1:len({_SORT}) - 1], ' ') AS sort FROM r),
    k AS (SELECT key, arg_min(coalesce(id, replace({_DUCK_FOLD.format('sort')}, ' ', '-')), (rank, ord)) AS composer_id FROM p GROUP BY key)
    SELECT composer_id, arg_min(name, (rank, ord)) AS name, arg_min(sort, (rank, ord)) AS sort, arg_min(dates, (rank, ord)) FILTER (WHERE dates IS NOT NULL) AS dates, coalesce(string_agg(DISTINCT alias, ';'), '') AS aliases
    FROM p JOIN k USING (key) GROUP BY composer_id""",
)
def jn1_resolve_composers(spark, sf_dir):
    people = d.derive(spark, sf_dir, d.PEOPLE)
    records = people.withColumn("sort", F.lit(None).cast("string")).withColumn("aliases", F.lit(None).cast("array<string>"))
    variants = people.where("name LIKE 'Maria Bea Kund%' AND TRY_CAST(substr(name, 15) AS INT) % 10 = 3").select(F.col("name").alias("variant"), F.replace("name", F.lit("Bea"), F.lit("Ana")).alias("canonical")).distinct()
    _, composers = identity.resolve_composers(records, variants)
    return composers.select("composer_id", "name", "sort", "dates", F.array_join("aliases", ";").alias("aliases"))


_KEYED = f"SELECT *, c || '::' || replace(regexp_replace({_DUCK_FOLD.format('t')}, '\\b(no|op|the|a|in|major|minor|for)\\b', '', 'g'), ' ', '') AS key FROM ({d.RANKED}) r"


@query(
    "jn2_dedupe_works",
    f"SELECT id, rank = 0 OR (NOT held AND n = 1) AS kept FROM (SELECT id, rank, max(CASE WHEN rank = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key) = 1 AS held, row_number() OVER (PARTITION BY key ORDER BY rank, ord) AS n FROM ({_KEYED}) k) x",
)
def jn2_dedupe_works(spark, sf_dir):
    rows = d.derive(spark, sf_dir, d.RANKED)
    key = F.array(keys.work_key(F.col("c"), F.col("t")))
    return dedupe.dedupe_works(rows.withColumn("register", key).withColumn("query", key), [0, 1, 2]).select("id", "kept")


@query(
    "jn3_backfill_years",
    f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, ord) AS n, max(CASE WHEN rank = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key) = 1 AS held FROM ({_KEYED}) k),
    x AS (SELECT *, rank = 0 OR (NOT held AND n = 1) AS kept FROM k),
    o AS (SELECT key, arg_min(id, (rank, ord)) AS id, arg_min(coalesce(y, 0), (rank, ord)) AS y FROM x WHERE kept GROUP BY key)
    SELECT o.id, arg_min(x.y, (x.rank, x.ord)) AS y FROM x JOIN o USING (key) WHERE NOT x.kept AND x.y IS NOT NULL AND o.y = 0 GROUP BY o.id""",
)
def jn3_backfill_years(spark, sf_dir):
    rows = d.derive(spark, sf_dir, d.RANKED)
    key = F.array(keys.work_key(F.col("c"), F.col("t")))
    rows = rows.withColumn("register", key).withColumn("query", key)
    return dedupe.backfill_years(tables.settled(dedupe.dedupe_works(rows, [0, 1, 2])))


@query("jn4_attach_years", f"SELECT w.ord, coalesce(w.y, CAST(f.yr AS INT)) AS y, w.y IS NULL AND f.yr IS NOT NULL AS harvested FROM ({d.WORKS}) w LEFT JOIN ({d.YEAR_FIELDS}) f ON w.ord = f.ord AND f.ord % 2 = 0")
def jn4_attach_years(spark, sf_dir):
    found = d.derive(spark, sf_dir, d.YEAR_FIELDS).where("ord % 2 = 0").select("ord", F.col("yr").alias("year"))
    return tallies.attach_years(d.derive(spark, sf_dir, d.WORKS), found, ["ord"]).select("ord", F.col("y").cast("int").alias("y"), "harvested")


@query(
    "jn5_composer_dates",
    """WITH c AS (SELECT c_custkey AS id, 'Kund' || c_custkey % 60 AS sur, CASE WHEN c_custkey % 2 = 0 THEN 'Ana' ELSE 'Bea' END AS fore FROM customer),
    p AS (SELECT s_suppkey AS ord, 'Kund' || s_suppkey % 60 AS sur, CASE WHEN s_suppkey % 3 = 0 THEN 'Ana' ELSE 'Cia Ana' END AS fore, CAST(1700 + s_suppkey AS INT) AS born FROM supplier),
    e AS (SELECT c.id, arg_min(p.born, p.ord) AS born FROM c JOIN p ON c.sur = p.sur AND c.fore = p.fore GROUP BY c.id),
    v AS (SELECT c.id, arg_min(p.born, p.ord) AS born FROM c JOIN p ON c.sur = p.sur AND list_has_any(string_split(c.fore, ' '), string_split(p.fore, ' ')) GROUP BY c.id)
    SELECT c.id, coalesce(e.born, v.born) AS born, e.born IS NULL AND v.born IS NOT NULL AS via_variant FROM c LEFT JOIN e ON c.id = e.id LEFT JOIN v ON c.id = v.id""",
)
def jn5_composer_dates(spark, sf_dir):
    c = F.col("c_custkey")
    composers = table(spark, sf_dir, "customer").select(c.alias("composer_id"), F.concat(F.lit("Kund"), c % 60, F.lit(", "), F.when(c % 2 == 0, "Ana").otherwise("Bea")).alias("sort"))
    s = F.col("s_suppkey")
    dates = table(spark, sf_dir, "supplier").select(s.alias("ord"), F.concat(F.lit("Kund"), s % 60, F.lit(", "), F.when(s % 3 == 0, "Ana").otherwise("Cia Ana")).alias("sort"), (s + 1700).cast("int").alias("born"), F.lit(None).cast("int").alias("died"), F.lit(None).cast("array<string>").alias("alt"))
    return identity.composer_dates(composers, dates).select(F.col("composer_id").alias("id"), "born", "via_variant")


_NEAR = "CASE c % 3 WHEN 0 THEN 'Brand#' || c % 60 WHEN 1 THEN 'Anna Brand#' || c % 60 ELSE 'Brant ' || c % 90 END"


@query(
    "jn11_near_names",
    f"""WITH q AS (SELECT p_partkey AS query_id, lower(p_brand) || 'x' AS text FROM part), n AS (SELECT c_custkey AS id, c_custkey % 7 AS n, {_NEAR.replace('c %', 'c_custkey %')} AS name FROM customer),
    f AS (SELECT DISTINCT trim(regexp_replace(text, '[^a-z0-9]+', ' ', 'g')) AS q FROM q),
    g AS (SELECT id, n, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS f, trim(regexp_replace(lower(CASE WHEN id % 3 = 1 THEN substr(name, 6) ELSE name END), '[^a-z0-9]+', ' ', 'g')) AS l FROM n),
    x AS (SELECT q, id, n, least(levenshtein(f, q), levenshtein(l, q)) AS distance FROM f, g),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY distance, n DESC, id) AS rank FROM x WHERE distance <= greatest(2, len(q) // 3))
    SELECT query_id, id AS composer_id, CAST(distance AS INT) AS distance, CAST(rank AS INT) AS rank FROM q JOIN r ON r.q = trim(regexp_replace(q.text, '[^a-z0-9]+', ' ', 'g')) WHERE rank <= 5""",
)
def jn11_near_names(spark, sf_dir):
    queries = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.concat("p_brand", F.lit("x")).alias("text"))
    c = F.col("c_custkey")
    number = F.when(c % 3 == 2, c % 90).otherwise(c % 60)
    name = F.concat(F.when(c % 3 == 0, "Brand#").when(c % 3 == 1, "Anna Brand#").otherwise("Brant "), number)
    sort = F.concat(F.when(c % 3 == 2, "Brant ").otherwise("Brand#"), number, F.when(c % 3 == 1, ", Anna").otherwise(""))
    return identity.near_names(table(spark, sf_dir, "customer").select(c.alias("composer_id"), name.alias("name"), sort.alias("sort"), (c % 7).alias("n")), queries)


def _shaped(spark, sf_dir, shapes: list[tuple]) -> DataFrame:
    """(id, n, raw): each part's number in one of the shapes of text, whose {n} is the part's size."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = F.element_at(F.array(*[F.lit(x[0]) for x in shapes]), (k % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_size").alias("n"), F.replace(raw, F.lit("{n}"), n).alias("raw"))


def _literal(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _shaped_sql(shapes: list[tuple], *names: str) -> str:
    """What the shapes should become: each name's text of the part's shape, its {n} filled in."""
    pick = lambda i: f"replace(([{', '.join(_literal(x[i]) for x in shapes)}])[p_partkey % {len(shapes)} + 1], '{{n}}', CAST(p_size AS VARCHAR))"
    return f"SELECT p_partkey AS id, {', '.join(f'{pick(i + 1)} AS {name}' for i, name in enumerate(names))} FROM part"


# ── sources and sinks ─────────────────────────────────────────────────────────


def _folder(spark, name: str) -> str:
    return f"{tables.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("src1_load_source", "SELECT n_nationkey, n_name FROM nation")
def src1_load_source(spark, sf_dir):
    nation = tables.load_source(spark, f"{sf_dir}/nation.parquet", "n_nationkey int, n_name string, n_regionkey int")
    missing = tables.load_source(spark, f"{sf_dir}/no-such-table.parquet", "n_nationkey int, n_name string, n_regionkey int")
    return nation.unionByName(missing).select("n_nationkey", "n_name")


@query("snk2_write_if_changed", "SELECT * FROM (VALUES (0, true), (1, false), (2, true)) t(attempt, wrote)")
def snk2_write_if_changed(spark, sf_dir):
    works, path = d.derive(spark, sf_dir, d.WORKS).select("ord", "t", "y"), _folder(spark, "works")
    changed = works.withColumn("y", F.coalesce("y", F.lit(0)))
    wrote = [tables.write_if_changed(x, path, ["ord", "t", "y"]) for x in (works, works.repartition(3).withColumn("at", F.current_timestamp()), changed)]
    return spark.createDataFrame(list(enumerate(wrote)), "attempt int, wrote boolean")


@query("snk3_build_manifest", f"SELECT true AS same, count(*) AS works, count(DISTINCT c) AS composers FROM ({d.WORKS}) w")
def snk3_build_manifest(spark, sf_dir):
    works = d.derive(spark, sf_dir, d.WORKS)
    make = lambda w: tables.build_manifest(w, w.select("c").distinct())
    return make(works).join(make(works.repartition(5)).select("build", F.lit(True).alias("same")), "build").select("same", "works", "composers")


@query(
    "snk4_export_csv",
    f"""SELECT CASE WHEN ck % 5 > 0 THEN 'Say "' || ck || '"' ELSE 'Unknown' END AS "Composer", t AS "Work", coalesce(cat, '') AS "Catalogue", coalesce(CAST(y AS VARCHAR), '') AS "Year", form AS "Genre",
    form || ', x' AS "Trumpet-family scoring", '' AS "Full instrumentation", CASE WHEN arr THEN 'yes' ELSE 'no' END AS "Arrangement" FROM (SELECT *, CAST(substr(c, 2) AS BIGINT) AS ck FROM ({d.WORKS}) w) x""",
)
def snk4_export_csv(spark, sf_dir):
    path = _folder(spark, "csv")
    works = d.derive(spark, sf_dir, d.WORKS).withColumns({"g": F.col("form"), "s": F.concat("form", F.lit(", x")), "full": F.lit(None).cast("string")})
    key = F.col("c_custkey")
    composers = table(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select(F.concat(F.lit("c"), key).alias("composer_id"), F.concat(F.lit('Say "'), key, F.lit('"')).alias("name"))
    tables.export_matches(works, composers, path)
    back = spark.read.csv(path, header=True, escape='"', lineSep="\r\n", encoding="UTF-8")
    return back.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in tables.EXPORT])


@query("snk5_export_list", f"SELECT c || ' — ' || t || CASE WHEN cat IS NULL THEN '' ELSE ', ' || cat END || ' — ' || form AS line FROM ({d.WORKS}) w")
def snk5_export_list(spark, sf_dir):
    path = _folder(spark, "list")
    tables.export_list(d.derive(spark, sf_dir, d.WORKS).withColumn("composer", F.col("c")).withColumn("s", F.col("form")), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("snk6_resume", "SELECT o_orderkey, o_orderkey % 3 > 0 AS late FROM orders")
def snk6_resume(spark, sf_dir):
    path = _folder(spark, "harvest")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    tables.append_new(orders.where("o_orderkey % 3 = 0").withColumn("late", F.lit(False)), path, "o_orderkey")
    return tables.append_new(orders.withColumn("late", F.lit(True)), path, "o_orderkey")


@query("snk7_partial_refresh", "SELECT o_orderkey % 3 AS source, count(*) AS n, max(CASE WHEN o_orderkey % 3 = 1 THEN 2 ELSE 1 END) AS version FROM orders GROUP BY 1")
def snk7_partial_refresh(spark, sf_dir):
    path = _folder(spark, "years")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 3).alias("source"), "o_orderkey")
    tables.refresh_partition(rows.withColumn("version", F.lit(1)), path)
    tables.refresh_partition(rows.where("source = 1").withColumn("version", F.lit(2)), path)
    out = spark.read.schema("o_orderkey long, version int, source long").parquet(path)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("version").alias("version"))




# ── crawled pages ─────────────────────────────────────────────────────────────

_ENTITY_STEPS = "".join(["replace("] * 15) + "{0}" + "".join(f", '{k}', '{v if v != chr(39) else chr(39) * 2}')" for k, v in markup.ENTITIES.items())
_HTML = "regexp_replace(regexp_replace(html, '<\\s*(?:br|/p|/li|/div|/tr|/h[1-6])\\s*/?>', ', ', 'gi'), '<[^>]+>', ' ', 'g')"


@query(
    "m1_html_text",
    f"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace({_ENTITY_STEPS.format(_HTML)}, '\\s+', ' ', 'g'), '(?:\\s*,\\s*)+', ', ', 'g'), '^[,\\s]+|[,\\s]+$', '', 'g'))) AS text FROM pages",
)
def m1_html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(markup.html_text(F.col("html")), 256).alias("text"))


def _wiki(spark, sf_dir) -> DataFrame:
    """Articles made of parts: every form of page that states a scoring, or none."""
    p = F.col("p_partkey")
    n = (p % 4 + 2).cast("string")
    list_ = F.concat(F.lit("{{col-float|1=\n* 2 [[Western concert flute|flutes]]\n* "), n, F.lit(" [[trumpet]]s{{music|flat}}\n* timpani\n}}"))
    prose = F.concat(F.lit("Intro.\nIt is scored for 2 flutes, oboe, bassoon, "), n, F.lit(" [[trumpet]]s and strings. The trumpets are silent later.\n==Notes==\n9 trumpets"))
    text_ = F.when(p % 3 == 0, F.concat(F.lit("A.\n==Instrumentation==\n"), list_, F.lit("\n===Strings===\nviolins\n==History==\n7 trumpets"))).when(p % 3 == 1, prose).otherwise(F.lit("Written for Diaghilev, with trumpets."))
    return table(spark, sf_dir, "part").select(p.alias("id"), text_.alias("wikitext"))


@query("m6_article_scoring", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'prose' END AS how, CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 4 + 2 ELSE 0 END AS trumpets FROM part")
def m6_article_scoring(spark, sf_dir):
    found = markup.read_passages(_wiki(spark, sf_dir)).select("id", "how", markup.first_sentence(F.col("text")).alias("text"))
    return scoring.parse_scoring(found, "text").select("id", "how", scoring.count_of(F.col("scoring"), "trumpet").cast("long").alias("trumpets"))


@query(
    "m2_clean_wikitext",
    """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN replace('A.|==Instrumentation==|||* 2 flutes|* ' || (p_partkey % 4 + 2) || ' trumpets |* timpani|||===Strings===|violins|==History==|7 trumpets', '|', chr(10))
       WHEN 1 THEN replace('Intro.|It is scored for 2 flutes, oboe, bassoon, ' || (p_partkey % 4 + 2) || ' trumpets and strings. The trumpets are silent later.|==Notes==|9 trumpets', '|', chr(10))
       ELSE 'Written for Diaghilev, with trumpets.' END AS t FROM part""",
)
def m2_clean_wikitext(spark, sf_dir):
    return _wiki(spark, sf_dir).select("id", markup.wikitext_text(F.col("wikitext")).alias("t"))


@query("m3_clean_detail", "SELECT p_partkey AS id, p_size || ' flutes, ' || p_name || ' horns' AS detail FROM part")
def m3_clean_detail(spark, sf_dir):
    raw = F.concat(F.lit("{{More {{x}}}} "), "p_size", F.lit(" flutes,<br>'''[[a|"), "p_name", F.lit("]] horns''' {{MoreEnd}}, "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), markup.clean_detail(raw).alias("detail"))


@query("m4_page_fields", "SELECT p_partkey AS id, p_name AS field, p_brand || '|x' AS detail FROM part")
def m4_page_fields(spark, sf_dir):
    page = F.concat(F.lit("{{W\n|Instrumentation= "), "p_name", F.lit(" |other=1\n| instrdetail ="), "p_brand", F.lit("|x\n}}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), markup.short_field(page, "Instrumentation").alias("field"), markup.page_field(page, "InstrDetail").alias("detail"))


@query("m5_flatten_lines", "SELECT p_partkey AS id, p_name || ', ' || p_brand || ', end' AS flat FROM part")
def m5_flatten_lines(spark, sf_dir):
    lines = F.concat(F.lit(":"), "p_name", F.lit(";\nand\n\n** "), "p_brand", F.lit("\nend."))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), markup.flatten_lines(lines).alias("flat"))


@query("m8_first_sentence", "SELECT conv_id, turn, sha256(regexp_replace(text, '\\.[ \\t\\n\\x0B\\f\\r]+[A-Z](.|\\n)*$', '')) AS first FROM conversations")
def m8_first_sentence(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(markup.first_sentence(F.col("text")), 256).alias("first"))


@query("m9_product_scoring", "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ', 3 trumpets' ELSE p_brand || ' band' END AS scoring, CASE WHEN p_partkey % 2 = 0 THEN 'instrumentation-line' ELSE 'short-description' END AS how FROM part")
def m9_product_scoring(spark, sf_dir):
    even = F.col("p_partkey") % 2 == 0
    long_ = F.when(even, F.concat(F.lit("<p>Good.</p><p>Instrumentation: "), "p_name", F.lit("<br/>3 trumpets Program notes by X</p>"))).otherwise("<p>None</p>")
    short = F.concat(F.lit("For "), "p_brand", F.lit(" band / 5 minutes"))
    products = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), long_.alias("description"), short.alias("short"))
    return markup.product_scoring(products, "description", "short").select("id", "scoring", "how")


@query("p18_shorthand", "SELECT p_partkey AS id, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size % 5 + 1 WHEN 1 THEN 3 ELSE 4 END AS BIGINT) AS trumpets FROM part")
def p18_shorthand(spark, sf_dir):
    p = F.col("p_partkey") % 3
    text_ = F.when(p == 0, F.concat(F.lit("solo trumpet; 3332 – 4"), F.col("p_size") % 5, F.lit("31 – t+4 – str"))).when(p == 1, "solo trumpet; 2 trumpets, strings").otherwise("4 trumpets – 2222 – 4231")
    out = markup.with_soloists(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text_.alias("text")), "text")
    return out.select("id", F.coalesce(F.element_at("counts", F.lit("trumpet")), F.lit(0)).cast("long").alias("trumpets"))


@query(
    "src2_category_links",
    "SELECT n_regionkey AS page_id, 'subcategory' AS kind, 'Category:' || n_name AS title FROM nation UNION ALL SELECT n_regionkey, 'page', 'Work ' || n_nationkey FROM nation",
)
def src2_category_links(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    link = lambda t: F.concat(F.lit('<a href="/wiki/x" title="'), t, F.lit('">x</a>'))
    subs, own = link(F.concat(F.lit("Category:"), "n_name")), F.concat(link(F.concat(F.lit("Work "), "n_nationkey")), link(F.concat(F.lit("Help:"), "n_name")))
    html = F.concat(F.lit('<div id="mw-subcategories">'), F.array_join(F.collect_list(subs), ""), F.lit('</div><div id="mw-pages">'), F.array_join(F.collect_list(own), ""), F.lit('</div><div id="catlinks">'), F.first(link(F.lit("End"))), F.lit("</div>"))
    return markup.category_links(nation.groupBy(F.col("n_regionkey").alias("page_id")).agg(html.alias("html")))


#: Nations lie in regions. Each has a subcategory of its region's own, which is followed, and one that isn't; every fifth work is on the region's page too.
_WALK = """WITH w AS (SELECT 'r' || n_regionkey AS composer, n_nationkey AS n, c_custkey AS cust, o_orderkey AS ord FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey),
    f AS (SELECT composer, 'Work ' || ord AS title, NULL AS subcat, NULL AS parent, 0 AS depth, 0 AS a, 0 AS b, ord FROM w WHERE ord % 5 = 0
      UNION ALL SELECT composer, 'Work ' || ord, 'Category:N' || n, NULL, 1, n, 0, ord FROM w WHERE cust % 3 < 2
      UNION ALL SELECT composer, 'Work ' || ord, 'Category:M' || n || ' by ' || composer, 'Category:N' || n, 1, n, 1, ord FROM w WHERE cust % 3 > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY composer, title ORDER BY depth, a, b, ord) AS pick FROM f),
    c AS (SELECT *, row_number() OVER (PARTITION BY composer ORDER BY depth, a, b, ord, title) AS place FROM k WHERE pick = 1)"""


def _walk(spark, sf_dir, most: int) -> DataFrame:
    nation, customer, orders = (table(spark, sf_dir, n) for n in ("nation", "customer", "orders"))
    root, own = F.concat(F.lit("Category:r"), "n_regionkey"), F.concat(F.lit("Category:N"), "n_nationkey")
    deeper = F.concat(F.lit("Category:M"), "n_nationkey", F.lit(" by r"), "n_regionkey")
    edge = lambda df, parent, child, kind, ord_: df.select(parent.alias("parent"), child.alias("child"), F.lit(kind).alias("kind"), ord_.cast("long").alias("ord"))
    works = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    title, k, at = F.concat(F.lit("Work "), "o_orderkey"), F.col("c_custkey") % 3, F.col("o_orderkey")
    edges = [
        edge(nation, root, own, "subcategory", F.col("n_nationkey")), edge(nation, own, deeper, "subcategory", F.lit(1)),
        edge(nation, own, F.concat(F.lit("Category:X"), "n_nationkey", F.lit(" by others")), "subcategory", F.lit(2)),
        edge(works.where(at % 5 == 0), root, title, "page", at), edge(works.where(k < 2), own, title, "page", at), edge(works.where(k > 0), deeper, title, "page", at),
        edge(works, F.concat(F.lit("Category:X"), "n_nationkey", F.lit(" by others")), F.concat(F.lit("Never "), at), "page", at), edge(works, own, F.concat(F.lit("List of "), at), "page", at),
    ]
    every = edges[0]
    for more in edges[1:]:
        every = every.unionByName(more)
    roots = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("composer"), F.concat(F.lit("Category:r"), "r_regionkey").alias("category"))
    return harvest.walk(roots, every, most)


@query("jn7_category_walk", f"{_WALK} SELECT composer, title, subcat, parent FROM c")
def jn7_category_walk(spark, sf_dir):
    return _walk(spark, sf_dir, 1 << 40)


@query("win5_first_category_and_cap", f"{_WALK} SELECT composer, title, subcat FROM c WHERE place <= 1000")
def win5_first_category(spark, sf_dir):
    return _walk(spark, sf_dir, harvest.MOST_ARTICLES).select("composer", "title", "subcat")


@query("jn8_redirects", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 1 THEN 'text ' || (p_partkey - 1) WHEN 0 THEN 'text ' || p_partkey END AS wikitext FROM part")
def jn8_redirects(spark, sf_dir):
    p = F.col("p_partkey")
    text_ = F.when(p % 3 == 0, F.concat(F.lit("text "), p)).when(p % 3 == 1, F.concat(F.lit("#REDIRECT [["), p - 1, F.lit("|x]]"))).otherwise("#redirect [[Nowhere]]")
    pages = table(spark, sf_dir, "part").select(p.cast("string").alias("title"), text_.alias("wikitext"))
    return harvest.follow_redirects(pages).select(F.col("title").cast("long").alias("id"), "wikitext")


@query("agg8_funnel", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 3 = 2 THEN 'no scoring' ELSE 'kept' END AS outcome FROM part) x GROUP BY outcome")
def agg8_funnel(spark, sf_dir):
    found = markup.read_passages(_wiki(spark, sf_dir)).select(F.col("id").alias("title"), "text")
    parsed = scoring.parse_scoring(found, "text")
    return harvest.funnel(parsed.select("title", "text", F.col("scoring.total").alias("total")))


@query("agg8_product_funnel", "SELECT outcome, count(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'edition' WHEN 1 THEN 'no scoring' WHEN 2 THEN 'no family' ELSE 'kept' END AS outcome FROM part) x GROUP BY outcome")
def agg8_product_funnel(spark, sf_dir):
    k = F.col("p_partkey") % 5
    said = F.when(k == 1, "<p>A piece.</p>").when(k == 2, "<p>Instrumentation: 2 oboes</p>").when(k > 2, F.concat(F.lit("<p>Instrumentation: 2 oboes, "), k, F.lit(" trumpets</p>"))).otherwise("")
    found = markup.product_scoring(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("description"), F.lit("").alias("short")), "description", "short")
    parsed = scoring.parse_scoring(found.select("description", F.col("scoring").alias("text")), "text")
    return tallies.product_funnel(parsed.select((F.col("description") != "").alias("described"), F.col("text").alias("scoring"), F.col("scoring.total").alias("total"), scoring.mentions_family(F.col("text")).alias("mentions")))


# ── display text ──────────────────────────────────────────────────────────────


@query("c1_tidy", "SELECT p_partkey AS id, p_name || ', 2 trumpets Band version, ' || p_brand AS text FROM part")
def c1_tidy(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" , ,2 trumpets\n=== Band version ===\n"), "p_brand", F.lit("\n==Structure==\n9 trumpets"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cleanup.tidy(raw).alias("text"))


@query(
    "c5_collapse_strings",
    "SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ', strings' WHEN 1 THEN ', Strings, 2 harps' WHEN 2 THEN ', 5 violins, violas, cellos, double basses' ELSE ' and a string section' END AS text FROM part",
)
def c5_collapse_strings(spark, sf_dir):
    k = F.col("p_partkey") % 4
    tail = (
        F.when(k == 0, ", violins I, violins II, violas, cellos and double basses").when(k == 1, ", Strings: 2 harps, 1st Violins, 2nd Violins, Violas, Celli, Basses")
        .when(k == 2, ", 5 violins, violas, cellos, double basses").otherwise(" and a string section of first and second violins, violas, cellos & contrabasses")
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cleanup.collapse_strings(F.concat("p_name", tail)).alias("text"))


@query("c7_shipped_text", "SELECT p_partkey AS id, p_size || ' trumpets, strings' || CASE WHEN p_partkey % 2 = 0 THEN '. It is in ' || p_size || ' movements and ' || p_name ELSE '' END AS text FROM part")
def c7_shipped_text(spark, sf_dir):
    raw = F.concat("p_size", F.lit(" trumpets, violins, violas, cellos, basses. It is in "), "p_size", F.lit(" movements and "), "p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cleanup.shipped(raw, F.when(F.col("p_partkey") % 2 == 0, "curated").otherwise("library")).alias("text"))


#: Texts, and what is left without remarks.
_REMARKS = [
    ("{n} flutes, trumpet, timpani and strings. It is in four movements. A typical performance lasts about {n} minutes", "{n} flutes, trumpet, timpani and strings"),
    ("harp, organ, {n} violins, Strings, This is a slightly larger orchestra than for the earlier dances", "harp, organ, {n} violins, Strings"),
    ("S.D., B.D., Xylo., {n} cornets, Guiro<!-- {n} -->", "S.D., B.D., Xylo., {n} cornets, Guiro"),
    ("harp, strings. For a performance in May the composer added horn and trumpet parts", "harp, strings. For a performance in May the composer added horn and trumpet parts"),
    ("a bassoon theme played against plucked strings. The musical material comes from a gavotte", None),
    ("{n} oboes, 2 horns, trumpet. Duration: {n} minutes", "{n} oboes, 2 horns, trumpet"),
    ("The orchestra was unusually large for its time. The piece is scored for the following forces: {n} horns, 3 trumpets, tuba", "{n} horns, 3 trumpets, tuba"),
    ("{n} trumpets, organ, This is one of the few works that critics praised", "{n} trumpets, organ"),
    ("piano, {n} violas. Two trumpet parts were added for the revised version", "piano, {n} violas. Two trumpet parts were added for the revised version"),
    ("trumpet, piano. It was dedicated to a friend. An arrangement for cornet, {n} violins", "trumpet, piano. An arrangement for cornet, {n} violins"),
    ("a lively fanfare opens the work. The melody returns in the strings after {n} bars", None),
    ("{n} cornets, drums; Click here to listen", "{n} cornets, drums"),
    ("Brass: 4 horns, {n} trumpets, Woodwind: 2 flutes", "Brass: 4 horns, {n} trumpets, Woodwind: 2 flutes"),
]


@query("c4_strip_commentary", _shaped_sql(_REMARKS, "text"))
def c4_strip_commentary(spark, sf_dir):
    return _shaped(spark, sf_dir, _REMARKS).select("id", commentary.strip_commentary(F.col("raw")).alias("text"))


#: A publisher's scorings, and how they read.
_PUBLISHED = [
    ("*3222 – 4231 – t+{n} – hp – str", "3 flutes, 2 oboes, 2 clarinets, 2 bassoons, 4 horns, 2 trumpets, 3 trombones, tuba, timpani, {n} percussion, harp, strings"),
    ("Flute 1-3; Bb clarinet 1-3; {n} violas", "3 Flutes, 3 clarinets, {n} violas"),
    ("2 options, 1) brass quintet, 2) full orchestra and {n} horns", "brass quintet (also published in other scorings)"),
    ("Solo trumpet – cel. – sax (please indicate which one would be preferred), gtr. – {n} horns", "solo trumpet, celesta, saxophones, guitar, {n} horns"),
    ("3*333 (3rd dbl. picc) - 4000, {n} bells, pno", "3 flutes, 3 oboes, 3 clarinets, 3 bassoons, 4 horns, {n} bells, piano"),
    ("11010 – 0100 – {n}p", "flute, oboe, bassoon, trumpet, {n} percussion"),
    ("C trumpet, E flat clarinet, F horn, tpts 1-2, {n} violins", "trumpet, clarinet, horn, 2 trumpets, {n} violins"),
    ("cornet 1-20, Bass 2-1, {n} drums", "cornet 1-20, Bass 2-1, {n} drums"),
    ("{n} flutes, harp. Also available for choir", "{n} flutes, harp (also published in other scorings)"),
    ("brass, organ; {n} player version, flute", "brass, organ (also published in other scorings)"),
    ("Full orchestra, {n} oboes, reduced string ensemble instrumentation, viola", "full orchestra, {n} oboes (also published in other scorings)"),
    ("perc (t, sus. cymb.), opt. harp, {n} bells", "percussion (timpani, suspended cymbal), optional harp, {n} bells"),
]


@query("c6_readable_scoring", _shaped_sql(_PUBLISHED, "text"))
def c6_readable_scoring(spark, sf_dir):
    return _shaped(spark, sf_dir, _PUBLISHED).select("id", publisher.readable_scoring(F.col("raw")).alias("text"))


@query("d3_article_year", "SELECT o_orderkey AS ord, CAST(year(o_orderdate) AS INT) AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'infobox' ELSE 'category' END AS how FROM orders")
def d3_article_year(spark, sf_dir):
    yr = F.year("o_orderdate")
    boxed = F.concat(F.lit("{{Infobox work\n| name = {{x}} 1700\n| composed = {{start date|"), yr - 4, F.lit("}}–"), yr, F.lit("<ref>1650</ref>\n}}\n| date = 1600\n[[Category:1500 operas]]"))
    filed = F.concat(F.lit("{{cite\n| date = 1600\n}}[[Category:"), yr + 7, F.lit(" compositions]] [[Category:"), yr, F.lit(" operas|x]]"))
    text_ = F.when(F.col("o_orderkey") % 2 == 0, boxed).otherwise(filed)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), years.article_year(text_, 2100).alias("x")).select("ord", "x.*")


# ── further tallies, unions and orders ────────────────────────────────────────


@query("agg2_per_composer_of_a_source", "SELECT o_custkey AS c, count(*) AS works FROM orders WHERE o_orderkey % 4 = 2 GROUP BY o_custkey")
def agg2_per_composer_of_a_source(spark, sf_dir):
    works = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), F.element_at(F.array(*map(F.lit, ("curated", "publisher", "library", "encyclopaedia"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("src"))
    return tallies.works_of_source(works, "library")


@query("agg5_by_source", f"SELECT rank, count(*) AS works FROM ({d.RANKED}) r GROUP BY rank")
def agg5_by_source(spark, sf_dir):
    return tallies.works_by(d.derive(spark, sf_dir, d.RANKED), "rank")


@query(
    "agg7_build_statistics",
    f"""WITH w AS (SELECT *, y IS NOT NULL AND ord % 2 = 0 AS h FROM ({d.WORKS}) w), p AS (SELECT count(*) AS composers, count(CASE WHEN k < 3 THEN 1 END) AS dates_added, count(CASE WHEN k < 3 AND id % 2 = 0 THEN 1 END) AS via_variant,
    count(CASE WHEN k = 1 AND b >= 1900 THEN 1 END) AS living FROM (SELECT s_suppkey AS id, 1700 + s_suppkey % 290 AS b, s_suppkey % 4 AS k FROM supplier) l)
    SELECT count(*) AS works, count(CASE WHEN NOT (h AND (y < 1995 OR y > 1999)) THEN y END) AS dated, count(CASE WHEN (y IS NULL OR (h AND (y < 1995 OR y > 1999))) AND ord % 3 = 0 THEN 1 END) AS placed,
    count(CASE WHEN h AND y BETWEEN 1995 AND 1999 THEN 1 END) AS years_kept, count(CASE WHEN h AND (y < 1995 OR y > 1999) THEN 1 END) AS years_rejected,
    any_value(composers) AS composers, any_value(dates_added) AS dates_added, any_value(via_variant) AS via_variant, any_value(living) AS living FROM w, p""",
)
def agg7_build_statistics(spark, sf_dir):
    harvested = F.col("y").isNotNull() & (F.col("ord") % 2 == 0)
    works = d.derive(spark, sf_dir, d.WORKS).withColumn("harvested", harvested).withColumn("ok", years.plausible_year(F.col("y"), F.lit(1990), F.lit(1999)))
    works = works.withColumn("rejected", F.col("harvested") & F.col("ok").isNull()).withColumn("y", F.when(~F.col("rejected"), F.col("y"))).withColumn("sy", F.when(F.col("ord") % 3 == 0, F.lit(1.0)))
    lives = d.derive(spark, sf_dir, _LIVES)
    born, died = F.when(F.col("k") < 2, F.col("b")), F.when(F.col("k").isin(0, 2), F.col("e"))
    dates, form = years.show_dates(born, died), years.date_form(born, died)
    return tallies.build_statistics(works, lives.select(dates.isNotNull().alias("dates_added"), (F.col("id") % 2 == 0).alias("via_variant"), (form == "living").alias("living")))


#: Pages of people: a quarter is missing, some have no template, the template has one of two names.
_PAGES = "SELECT s_suppkey AS id, 1700 + s_suppkey % 290 AS b, 1750 + s_suppkey % 290 AS e, s_suppkey % 8 AS k FROM supplier"


def _person_pages(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    fields = F.concat(
        F.when(k != 3, F.concat(F.lit("|Born Year=ca. "), "b", F.lit("\n"))).otherwise(""),
        F.when(k.isin(0, 3, 5), F.concat(F.lit("|Died Year= "), F.when(k == 5, F.col("b") - 20).otherwise(F.col("e")), F.lit("\n"))).otherwise(""),
        F.lit("|Alternate Names=Ána, B, Zoe "), "id", F.lit("\n}}"),
    )
    page = F.when(k == 2, F.concat(F.lit("{{#fte:other\n"), fields)).when(k % 2 == 0, F.concat(F.lit("x {{#fte:person\n"), fields)).otherwise(F.concat(F.lit("{{#imslpcomposer:\n"), fields))
    return d.derive(spark, sf_dir, _PAGES).select("id", F.when(k < 6, page).alias("wikitext"))


def _people(spark, sf_dir) -> DataFrame:
    return _person_pages(spark, sf_dir).select("id", F.col("wikitext").isNull().alias("missing"), F.explode(F.array(years.person_record(F.col("wikitext"), 2100))).alias("r"))


@query(
    "d5_person_record",
    f"SELECT id, CASE WHEN k <> 3 THEN b END AS born, CASE WHEN k IN (0, 3) THEN e END AS died, k = 5 AS suspect, 'ana zoe' || CASE WHEN id > 9 THEN ' ' || id ELSE '' END AS alt FROM ({_PAGES}) p WHERE k < 6 AND k <> 2",
)
def d5_person_record(spark, sf_dir):
    found = _people(spark, sf_dir).where("r is not null")
    return found.select("id", F.col("r.born").cast("long").alias("born"), F.col("r.died").cast("long").alias("died"), "r.suspect", F.array_join("r.alt", " ").alias("alt"))


@query(
    "agg9_person_statistics",
    f"""SELECT count(*) AS looked_up, count(CASE WHEN k < 6 AND k <> 2 THEN 1 END) AS found, count(CASE WHEN k = 2 THEN 1 END) AS no_record, count(CASE WHEN k >= 6 THEN 1 END) AS page_missing,
    count(CASE WHEN k IN (0, 1, 4, 5) THEN 1 END) AS with_birth, count(CASE WHEN k IN (1, 4, 5) THEN 1 END) AS no_death FROM ({_PAGES}) p""",
)
def agg9_person_statistics(spark, sf_dir):
    return tallies.person_statistics(_people(spark, sf_dir).select("missing", "r.born", "r.died"))


@query("flt3_sane_category", f"SELECT ord, count(CASE WHEN i < 4 THEN 1 END) > 0 AND ord % 3 > 0 AS sane FROM ({d.PARTS}) p GROUP BY ord")
def flt3_sane_category(spark, sf_dir):
    texts = d.derive(spark, sf_dir, d.SPARK_TEXTS)
    return texts.select("ord", harvest.sane_category(F.concat(F.lit("For "), "text"), F.col("ord") % 3).alias("sane"))


@query("flt4_holds_works", "SELECT p_partkey AS id, p_partkey % 3 = 0 AS holds FROM part")
def flt4_holds_works(spark, sf_dir):
    k = F.col("p_partkey") % 3
    title = F.concat(F.when(k == 0, "Songs by ").when(k == 1, "List of ").otherwise("Category:Recordings of "), "p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), harvest.holds_works(title).alias("holds"))


@query("flt5_complete_rows", f"SELECT w.ord FROM ({d.WORKS}) w JOIN ({d.COUNTS}) k ON w.ord = k.ord WHERE total > 0 AND cat IS NOT NULL")
def flt5_complete_rows(spark, sf_dir):
    return tallies.complete_rows(index(spark, sf_dir), F.col("size"), "cat", "c").select("ord")


@query("flt11_composers_with_works", "SELECT c_custkey AS composer_id, n, n_arr FROM customer JOIN (SELECT o_custkey, count(CASE WHEN o_orderkey % 7 > 0 THEN 1 END) AS n, count(CASE WHEN o_orderkey % 7 = 0 THEN 1 END) AS n_arr FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey")
def flt11_composers_with_works(spark, sf_dir):
    counts = tallies.works_per_composer(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), (F.col("o_orderkey") % 7 == 0).alias("arr")))
    return tallies.composers_with_works(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("composer_id")), counts)


@query("jn6_with_composers", f"SELECT ord, coalesce(c_name, 'Unknown') AS composer FROM ({d.WORKS}) w LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 > 0) x ON w.c = concat('c', x.c_custkey)")
def jn6_with_composers(spark, sf_dir):
    composers = table(spark, sf_dir, "customer").where("c_custkey % 5 > 0").select(F.concat(F.lit("c"), "c_custkey").alias("composer_id"), F.col("c_name").alias("name"), F.col("c_name").alias("sort"))
    return search.with_composers(d.derive(spark, sf_dir, d.WORKS), composers).select("ord", "composer")


@query(
    "set1_union_of_sources",
    """SELECT src, rank, count(*) AS n, count(extra) AS with_extra FROM (SELECT 'curated' AS src, 0 AS rank, c_mktsegment AS extra FROM customer UNION ALL SELECT 'publisher', 1, NULL FROM supplier
    UNION ALL SELECT 'encyclopaedia', 2, NULL FROM part UNION ALL SELECT 'library', 3, o_orderpriority FROM orders) u GROUP BY src, rank""",
)
def set1_union_of_sources(spark, sf_dir):
    named = {"curated": ("customer", "c_custkey", "c_mktsegment"), "publisher": ("supplier", "s_suppkey", None), "encyclopaedia": ("part", "p_partkey", None), "library": ("orders", "o_orderkey", "o_orderpriority")}
    sources = {}
    for src, (name, key, extra) in named.items():
        sources[src] = table(spark, sf_dir, name).select(F.col(key).alias("ord"), *([F.col(extra).alias("extra")] if extra else []))
    return tallies.union_sources(sources).groupBy("src", "rank").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("with_extra"))


@query("set3_distinct_pages", "SELECT o_custkey AS title FROM orders UNION SELECT c_custkey FROM customer UNION SELECT s_suppkey FROM supplier")
def set3_distinct_pages(spark, sf_dir):
    return tallies.distinct_pages(*[table(spark, sf_dir, n).select(F.col(k).alias("title")) for n, k in (("orders", "o_custkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"))])


@query("set4_alias_union", "SELECT o_custkey AS c, array_to_string(list_sort(list_distinct(flatten(list(CASE WHEN o_orderkey % 4 = 0 THEN [] ELSE [o_orderpriority, o_orderstatus] END)))), ';') AS aliases FROM orders GROUP BY o_custkey")
def set4_alias_union(spark, sf_dir):
    names = F.when(F.col("o_orderkey") % 4 > 0, F.array("o_orderpriority", "o_orderstatus"))
    merged = tallies.merged_names(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c"), names.alias("aliases")), "c", "aliases")
    return merged.select("c", F.array_join("aliases", ";").alias("aliases"))


_WITHIN = {"genre": "form, coalesce(y, 9999), form, n, suffix", "title": "form, n, suffix", "date": "coalesce(y, 9999), form, n, suffix", "size": "total DESC, form, n, suffix"}


@query("srt1_within_composer", " UNION ALL ".join(f"SELECT '{by}' AS by, ord, CAST(row_number() OVER (PARTITION BY c ORDER BY {keys_}, ord) AS INT) AS place FROM (SELECT *, {_SUFFIX_ORDER} AS suffix FROM (SELECT w.*, total FROM ({d.WORKS}) w JOIN ({d.COUNTS}) k ON w.ord = k.ord) v) x" for by, keys_ in _WITHIN.items()))
def srt1_within_composer(spark, sf_dir):
    works = index(spark, sf_dir).withColumn("g", F.col("form")).withColumn("sy", F.col("y"))
    return search.places_within(works, tuple(_WITHIN))


@query("win4_second_page", f"SELECT ord FROM ({d.WORKS}) w ORDER BY coalesce(y, 9999), c, ord LIMIT 150 OFFSET 150")
def win4_second_page(spark, sf_dir):
    works = d.derive(spark, sf_dir, d.WORKS)
    return search.page(works, [F.coalesce("y", F.lit(search.UNDATED)), F.col("c"), F.col("ord")], 1).select("ord")


@query(
    "win4_deep_batches",
    f"""SELECT ord, place FROM (SELECT ord, row_number() OVER (ORDER BY coalesce(y, 9999), c, ord) AS place, count(*) OVER () AS n FROM ({d.WORKS}) w) x
    WHERE (place - 1) // 150 IN (0, n // 300, n // 150)""",
)
def win4_deep_batches(spark, sf_dir):
    """The first, the middle and the last batch."""
    works = tables.settled(d.derive(spark, sf_dir, d.WORKS))
    ordered = search.OrderIndex(works, [F.coalesce("y", F.lit(search.UNDATED)), F.col("c"), F.col("ord")], 1000)
    n = works.count()
    out = [ordered.batch(k).select("ord", "place") for k in sorted({0, n // 300, n // 150})]
    return reduce(lambda a, b: a.unionByName(b), out)


@query("srt2_by_composer", f"SELECT ord, place FROM (SELECT ord, row_number() OVER (ORDER BY c, form, n, suffix, ord) AS place FROM (SELECT *, {_SUFFIX_ORDER} AS suffix FROM ({d.WORKS}) w) v) x WHERE place BETWEEN 151 AND 300")
def srt2_by_composer(spark, sf_dir):
    works = d.derive(spark, sf_dir, d.WORKS).withColumn("composer_sort", F.col("c"))
    return search.OrderIndex(works, search.ordering("composer"), 1000).batch(1).select("ord", "place")


@query("srt2_by_title", f"SELECT ord, place FROM (SELECT ord, row_number() OVER (ORDER BY form, n, suffix, c, ord) AS place FROM (SELECT *, {_SUFFIX_ORDER} AS suffix FROM ({d.WORKS}) w) v) x WHERE place BETWEEN 301 AND 450")
def srt2_by_title(spark, sf_dir):
    works = d.derive(spark, sf_dir, d.WORKS).withColumn("composer_sort", F.col("c"))
    return search.OrderIndex(works, search.ordering("title"), 1000).batch(2).select("ord", "place")


@query(
    "agg6_works_under_genres",
    f"""SELECT g, chunk, count(*) AS works, sha256(string_agg(CAST(ord AS VARCHAR), ',' ORDER BY place)) AS listed FROM (SELECT g, ord, place, (place - 1) // 150 AS chunk FROM
    (SELECT CASE WHEN ord % 4 > 0 THEN form END AS g, ord, row_number() OVER (PARTITION BY CASE WHEN ord % 4 > 0 THEN form END ORDER BY coalesce(y, 9999), ord) AS place FROM ({d.WORKS}) w) x) y GROUP BY g, chunk""",
)
def agg6_works_under_genres(spark, sf_dir):
    works = d.derive(spark, sf_dir, d.WORKS).withColumn("g", F.when(F.col("ord") % 4 > 0, F.col("form")))
    found = search.chunks(works, "g", [F.coalesce("y", F.lit(search.UNDATED)), F.col("ord")], F.col("ord").cast("string"))
    return found.select("g", F.col("chunk").cast("long").alias("chunk"), "works", F.sha2(F.array_join("items", ","), 256).alias("listed"))


@query(
    "agg_facets",
    f"""WITH x AS ({_INDEX}) SELECT 'all' AS facet, '' AS value, count(*) AS works FROM x UNION ALL SELECT 'composers', NULL, count(DISTINCT c) FROM x
    UNION ALL SELECT 'genre', form, count(*) FROM x GROUP BY form UNION ALL SELECT 'size', CAST(total AS VARCHAR), count(*) FROM x GROUP BY total
    UNION ALL SELECT * FROM (SELECT 'member', k, count(CASE WHEN n > 0 THEN 1 END) AS m FROM (SELECT unnest(['piccoloTrumpet', 'trumpet', 'cornet', 'flugelhorn']) AS k, unnest([n0, n1, n2, n3]) AS n FROM x) u GROUP BY k) v WHERE m > 0""",
)
def agg_facets(spark, sf_dir):
    return search.facets(index(spark, sf_dir).withColumn("g", F.col("form")), KEYS)


@query("k18_is_arrangement", "SELECT p_partkey AS id, p_partkey % 2 = 0 AS arrangement FROM part")
def k18_is_arrangement(spark, sf_dir):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " (arr. X)").when(F.col("p_partkey") % 4 == 2, ", arranged").otherwise(" arrow"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), keys.is_arrangement(name).alias("arrangement"))


@query("snk8_loss_guard", "SELECT kept, CASE WHEN kept = 0 THEN true ELSE new >= old * 0.8 END AS publish FROM (SELECT count(*) AS old FROM orders) a, (SELECT m AS kept, count(o_orderkey) AS new FROM (VALUES (0), (10), (3)) v(m) LEFT JOIN orders ON m = 0 OR o_orderkey % m > 0 GROUP BY m) b")
def snk8_loss_guard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old, most, few = orders.agg(F.count(F.lit(1)), F.count_if(F.col("o_orderkey") % 10 > 0), F.count_if(F.col("o_orderkey") % 3 > 0)).first()
    return spark.createDataFrame([(kept, publishing.guard_loss(old, new)) for kept, new in ((0, old), (10, most), (3, few))], "kept int, publish boolean")


@query(
    "snk1_publish_index",
    f"""SELECT 'work' AS kind, ord AS id, t AS label, NULL AS place FROM ({d.WORKS}) w UNION ALL SELECT 'composer', c_custkey, c_name, row_number() OVER (ORDER BY c_name DESC, c_custkey) FROM customer
    UNION ALL SELECT 'stats', (SELECT count(*) FROM orders), NULL, count(*) FROM customer""",
)
def snk1_publish_index(spark, sf_dir):
    path = _folder(spark, "index")
    works = d.derive(spark, sf_dir, d.WORKS).withColumn("src", F.lit("x")).withColumn("url", F.lit("y"))
    backwards = F.lpad((10**9 - F.regexp_extract("c_name", r"(\d+)", 1).cast("long")).cast("string"), 12, "0")
    composers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("composer_id"), F.col("c_name").alias("name"), backwards.alias("sort"))
    numbers = works.agg(F.count(F.lit(1)).alias("works")).join(composers.agg(F.count(F.lit(1)).alias("composers")), F.lit(True))  # one row each
    tables.publish_index(works, composers, numbers, path)
    read = lambda name: publishing.load(spark, path, name)
    none = F.lit(None).cast("string")
    shown = read("works")
    assert "src" not in shown.columns and "url" not in shown.columns
    out = shown.select(F.lit("work").alias("kind"), F.col("ord").alias("id"), F.col("t").alias("label"), F.lit(None).cast("long").alias("place"))
    listed = search.placed(read("composers"), "sort").select(F.lit("composer").alias("kind"), F.col("composer_id").alias("id"), F.col("name").alias("label"), F.col("place").cast("long").alias("place"))
    return out.unionByName(listed).unionByName(read("statistics").select(F.lit("stats").alias("kind"), F.col("works").alias("id"), none.alias("label"), F.col("composers").alias("place")))


#: Versions of the works: all; the same again; one composer's years moved; a failure before the switch; a loss of a third; the same loss, forced.
_VERSIONS = "(VALUES (1, 'published', 'all', 0, 1), (2, 'unchanged', 'none', 0, 1), (3, 'published', 'one', 1, 1), (4, 'failed', 'none', 1, 1), (5, 'refused', 'none', 1, 1), (6, 'published', 'all', 1, 3))"


@query(
    "snk1_versions",
    f"""WITH w AS ({d.WORKS}) SELECT step, outcome, written, count(*) AS works, CAST(sum(y + CASE WHEN moved = 1 AND c = 'c1' THEN 1 ELSE 0 END) AS BIGINT) AS years
    FROM {_VERSIONS} v(step, outcome, written, moved, lost), w WHERE lost = 1 OR ord % lost > 0 GROUP BY step, outcome, written""",
)
def snk1_versions(spark, sf_dir):
    works, path = tables.settled(d.derive(spark, sf_dir, d.WORKS)), _folder(spark, "versions")
    moved = works.withColumn("y", F.when(F.col("c") == "c1", F.col("y") + 1).otherwise(F.col("y")))
    fewer = moved.where("ord % 3 > 0")

    def stop(_):
        raise InterruptedError

    out = None
    for step, (rows, verify, force) in enumerate(((works, None, False), (works.repartition(3), None, False), (moved, None, False), (moved.withColumn("t", F.lit("?")), stop, False), (fewer, None, False), (fewer, None, True)), 1):
        try:
            found = publishing.publish({"works": publishing.Table(rows, "c")}, path, verify, force)
            outcome, wrote, buckets = found.outcome, found.written, found.buckets
        except InterruptedError:
            outcome, wrote, buckets = "failed", 0, 1
        written = {0: "none", 1: "one", buckets: "all"}.get(wrote, "some")
        seen = publishing.load(spark, path, "works").agg(F.count(F.lit(1)).alias("works"), F.sum("y").alias("years"))
        row = seen.select(F.lit(step).alias("step"), F.lit(outcome).alias("outcome"), F.lit(written).alias("written"), "works", "years")
        out = row if out is None else out.unionByName(row)
    return out


@query("k7_split_catalogue", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 2 THEN p_name || ', Xy.' || p_size ELSE p_name END AS title, CASE p_partkey % 3 WHEN 0 THEN 'Op.' || p_size || ' No.2' WHEN 1 THEN 'BWV ' || p_size END AS catalogue FROM part")
def k7_split_catalogue(spark, sf_dir):
    k = F.col("p_partkey") % 3
    full = F.concat("p_name", F.when(k == 0, F.concat(F.lit(", Op."), "p_size", F.lit(" No.2"))).when(k == 1, F.concat(F.lit(" BWV "), "p_size")).otherwise(F.concat(F.lit(", Xy."), "p_size")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), keys.split_catalogue(full).alias("x")).select("id", "x.*")


@query("k14_product_title", "SELECT p_partkey AS id, p_name AS title FROM part")
def k14_product_title(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(k == 0, " – PDF download").when(k == 1, " (Rental parts)").otherwise(" "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), keys.product_title(name).alias("title"))


@query("k16_genre_from_category", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Symphony' WHEN 1 THEN 'Concerto' WHEN 2 THEN 'Chamber' ELSE 'Orchestral' END AS genre FROM part")
def k16_genre_from_category(spark, sf_dir):
    k = F.col("p_partkey") % 4
    category = F.concat(F.when(k == 0, "Category:Symphonies by ").when(k == 1, "Piano concertos by ").otherwise("Serenades by "), "p_name")
    parent = F.when(k == 2, F.concat(F.lit("Category:Chamber music by "), "p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), keys.genre_from_category(category, parent).alias("genre"))


@query("k17_genre_from_products", "SELECT o_custkey AS id, CASE WHEN bool_or(o_orderkey % 5 = 0) THEN 'Concerto' WHEN bool_or(o_orderkey % 5 = 1) THEN 'Ballet' WHEN bool_or(o_orderkey % 5 = 2) THEN 'Chamber' ELSE 'Other' END AS genre FROM orders GROUP BY o_custkey")
def k17_genre_from_products(spark, sf_dir):
    k = F.col("o_orderkey") % 5
    name = F.when(k == 0, "Concertos (with Orchestra)").when(k == 1, "Ballet").when(k == 2, "Chamber Music").otherwise("New")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(name).alias("names")).select("id", keys.genre_from_products(F.col("names")).alias("genre"))


@query(
    "c3_scoring_display",
    "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '2 flutes, ' || p_size || ' trumpets' WHEN 1 THEN 'brass and strings, ' || p_name WHEN 2 THEN NULL ELSE 'three cornets, oboe' END AS text FROM part",
)
def c3_scoring_display(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = (
        F.when(k == 0, F.concat(F.lit("thumb|360px|A "), "p_name", F.lit(", 1928, The work is scored for 2 flutes, "), "p_size", F.lit(" trumpets\n==Form==\n9 horns")))
        .when(k == 1, F.concat(F.lit("The ensemble consists of brass and strings, "), "p_name")).when(k == 2, F.concat(F.lit("It was written in "), "p_size", F.lit(" days")))
        .otherwise("It calls for three cornets, oboe")
    )
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cleanup.scoring_display(raw).alias("text"))


@query("m10_cut_at_prose", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'flute (note: 2), ' || p_size || ' trumpets' WHEN 1 THEN 'flute premiered by ' || p_size || ' trumpets' ELSE p_name END AS text FROM part")
def m10_cut_at_prose(spark, sf_dir):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit("flute (note: 2), "), "p_size", F.lit(" trumpets Program notes by 3 cornets"))).when(k == 1, F.concat(F.lit("flute premiered by "), "p_size", F.lit(" trumpets"))).otherwise(F.concat("p_name", F.lit(" commissioned by X")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), cleanup.cut_at_prose(raw).alias("text"))


# ── the rest of the inventory ─────────────────────────────────────────────────


@query("jn9_requested_titles", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'p ' || p_partkey ELSE 'P_' || p_partkey END AS requested FROM part")
def jn9_requested_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    title = F.concat(F.lit("P_"), "p_partkey").alias("title")
    aliases = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("p "), "p_partkey").alias("asked"), title)
    return harvest.requested_titles(part.select(F.col("p_partkey").alias("id"), title), aliases).select("id", "requested")


@query(
    "jn10_name_lookup",
    f"""WITH c AS (SELECT c_custkey AS id, 'maria kund' || c_custkey % 300 AS f, 'kund' || c_custkey % 300 || ' maria' AS s, 'kund' || c_custkey % 300 AS l, CASE WHEN c_custkey % 11 = 0 THEN 'zett ' || c_custkey % 90 END AS a, c_custkey % 7 AS n FROM customer),
    p AS (SELECT p_partkey AS query_id, CASE p_partkey % 7 WHEN 0 THEN 'kund' || p_size WHEN 1 THEN 'maria kund' || p_size WHEN 2 THEN 'und' || p_size WHEN 3 THEN 'zett ' || p_size WHEN 4 THEN 'zet' WHEN 5 THEN 'kund' || p_size || ' maria' ELSE 'ia kund' || p_size END AS q FROM part),
    q AS (SELECT DISTINCT q FROM p),
    x AS (SELECT q, id, s, CASE WHEN l = q OR coalesce(a = q, false) THEN 100 WHEN f = q OR s = q THEN 95 WHEN starts_with(l, q) THEN 80 WHEN coalesce(starts_with(a, q), false) THEN 75 WHEN starts_with(f, q) OR starts_with(s, q) THEN 70
      WHEN contains(s, q) THEN 40 WHEN contains(f, q) THEN 35 END + least(12, 2 * log2(n + 1)) AS x FROM c, q),
    r AS (SELECT q, id, round(x, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(x, 6) DESC, s, id) AS rank FROM x WHERE x IS NOT NULL)
    SELECT query_id, id AS composer_id, score, CAST(rank AS INT) AS rank FROM p JOIN r USING (q) WHERE rank <= 8""",
)
def jn10_name_lookup(spark, sf_dir):
    c, k = F.col("c_custkey"), F.col("p_partkey") % 7
    kund = F.concat(F.lit("Kund"), c % 300)
    composers = table(spark, sf_dir, "customer").select(
        c.alias("composer_id"), F.concat(F.lit("Maria "), kund).alias("name"), F.concat(kund, F.lit(", Maria")).alias("sort"),
        F.when(c % 11 == 0, F.array(F.concat(F.lit("Zett-"), c % 90))).alias("aliases"), (c % 7).alias("n"),
    )
    size = F.col("p_size").cast("string")
    said = (
        F.when(k == 0, F.concat(F.lit("KUND"), size)).when(k == 1, F.concat(F.lit("Maria Kund"), size)).when(k == 2, F.concat(F.lit("und"), size)).when(k == 3, F.concat(F.lit("zett "), size))
        .when(k == 4, "Zet").when(k == 5, F.concat(F.lit("Kund"), size, F.lit(", Maria"))).otherwise(F.concat(F.lit("ia kund"), size))
    )
    return identity.name_lookup(composers, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), said.alias("text")))


@query(
    "jn12_alternate_titles",
    """SELECT -p_partkey - 1 AS id, true AS kept FROM part WHERE p_partkey % 97 = 0 UNION ALL
    SELECT p_partkey, p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 97 = 0) AND row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 FROM part""",
)
def jn12_alternate_titles(spark, sf_dir):
    part, none = table(spark, sf_dir, "part"), F.lit(None).cast("string")
    own = part.where("p_partkey % 97 = 0").select((-F.col("p_partkey") - 1).alias("id"), F.lit(0).alias("rank"), F.col("p_partkey").alias("ord"), F.lit("x").alias("c"), F.concat("p_name", F.lit(" version "), "p_partkey").alias("t"), none.alias("cat"), F.array("p_name").alias("also"))
    library = part.select(F.col("p_partkey").alias("id"), F.lit(3).alias("rank"), F.col("p_partkey").alias("ord"), F.lit("x").alias("c"), F.col("p_name").alias("t"), none.alias("cat"))
    ranked = dedupe.with_keys(own, "curated").drop("also").unionByName(dedupe.with_keys(library, "library"))
    return dedupe.dedupe_works(ranked, [0, 3]).select("id", "kept")


@query("srt5_listing_order", "SELECT s_suppkey FROM supplier ORDER BY CASE WHEN s_suppkey % 5 = 0 THEN 'zz' ELSE s_name END, s_suppkey LIMIT 5 OFFSET 5")
def srt5_listing_order(spark, sf_dir):
    sort = F.when(F.col("s_suppkey") % 5 != 0, text.fold(F.col("s_name")))
    return search.page(table(spark, sf_dir, "supplier"), [F.coalesce(sort, F.lit("zz")), F.col("s_suppkey")], 1, 5).select("s_suppkey")


#: Texts with asides, and their counts, and who doubles what.
_ASIDES = [
    ("6 trumpets (1st doubling cornet), {n} harps", "trumpet 6", "cornet/trumpet/1st"),
    ("6 trumpets (2nd and third dbl. cornet)", "trumpet 6", "cornet/trumpet/2nd and 3rd"),
    ("6 trumpets (4 also 2nd cornet)", "trumpet 6", "cornet/trumpet/4th"),
    ("4 trumpets (or cornets), {n} oboes", "trumpet 4", ""),
    ("3 trumpets (1st doubling piccolo trumpet, 2nd doubling flugelhorn)", "trumpet 3", "piccoloTrumpet/trumpet/1st;flugelhorn/trumpet/2nd"),
    ("3 trumpets (3rd doubling cornet; 2 flugelhorns offstage)", "trumpet 3, flugelhorn 2", "cornet/trumpet/3rd"),
    ("oboe (doubling cornet)", "cornet 0", "cornet//"),
    ("3 trumpets (1st, 2nd and 3rd = flugelhorn)", "trumpet 3", "flugelhorn/trumpet/1st, 2nd and 3rd"),
    ("5 trumpets (including 2 cornets)", "trumpet 5", "cornet/trumpet/"),
    ("2 cornets (2nd doubling trumpet in C, also trumpet in D)", "cornet 2", "trumpet/cornet/2nd"),
    ("3 trumpets (11th doubling cornet, muted)", "trumpet 3", "cornet/trumpet/11th"),
    ("2 cornets [1st alternating with piccolo trumpet], 3 trumpets", "trumpet 3, cornet 2", "piccoloTrumpet/cornet/1st"),
]
#: Texts that name a member more than once: the first number that is given counts, and numbers are never added up.
_TWICE = [
    ("{n} trumpets, oboe, {n} trumpets", "trumpet {n}", ""),
    ("{n} trumpets, trumpet", "trumpet {n}", ""),
    ("trumpets, harp, {n} trumpets", "trumpet {n}", ""),
    ("trumpets, harp, trumpets offstage", "trumpet 2", ""),
    ("2 cornets, {n} trumpets, 4 cornets", "trumpet {n}, cornet 2", ""),
    ("trumpet, trumpets", "trumpet 1", ""),
    ("{n} trumpets and {n} trumpets and cornet", "trumpet {n}, cornet 1", ""),
    ("trumpet 1-3, trumpet 4", "trumpet 3", ""),
    ("cornet, flute (doubling cornet)", "cornet 1", "cornet//"),
    ("{n} flugelhorns, horn, flugelhorn (optional)", "flugelhorn {n}", ""),
]


def _read(spark, sf_dir, shapes) -> DataFrame:
    x = scoring.parse_scoring(_shaped(spark, sf_dir, shapes), "raw")
    counts = F.array(*[F.when(F.map_contains_key("scoring.counts", F.lit(k)), F.concat(F.lit(f"{k} "), F.element_at("scoring.counts", F.lit(k)))) for k in KEYS])
    doubled = F.transform("scoring.doublings", lambda v: F.concat_ws("/", v["instrument"], F.coalesce(v["parent"], F.lit("")), F.coalesce(v["player"], F.lit(""))))
    return x.select("id", F.array_join(F.array_compact(counts), ", ").alias("counts"), F.array_join(doubled, ";").alias("doublings"))


@query("p9_named_twice", _shaped_sql(_TWICE, "counts", "doublings"))
def p9_named_twice(spark, sf_dir):
    return _read(spark, sf_dir, _TWICE)


@query("p10_asides", _shaped_sql(_ASIDES, "counts", "doublings"))
def p10_asides(spark, sf_dir):
    return _read(spark, sf_dir, _ASIDES)


#: Wikitext, and its words.
_WIKITEXTS = [
    ("{{nowrap|{n} [[trumpet]]s}} and ''harp''", "{n} trumpets and harp"),
    ("a<!-- {n} -->b <ref name=x/>c <ref>{{cite|{n}}}</ref>d", "ab c d"),
    ("{{ubl|{n} flutes|[[Oboe|oboes]]|style=x|20em}}", "{n} flutes oboes"),
    ("{{div col|colwidth=20em}}\n* {n} [[Horn (music)|horns]]\n{{div col end}}", "* {n} horns"),
    ("{| class=wikitable\n|-\n! Brass || {n} trumpets\n| style=\"a\" | tuba\n|}", "Brass {n} trumpets tuba"),
    ("{{cite|{{x|{n}}}}} harp&nbsp;{n}<br>bell", "harp {n} bell"),
    ("{{hanging indent|text={n} [[cornet]]s}}", "{n} cornets"),
    ("[https://example.org/s the score] of {n} [[bar]]s", "the score of {n} bars"),
    ("{{open {n} [[bar]]s", "{{open {n} bars"),
    ("{{lang|de|{n} Hörner}} {{unknown|y}} <small>x</small>", "de {n} Hörner x"),
    ("{{flatlist|\n* {n} [[flute]]s\n* [[B-flat|B]] cornet\n}}", "* {n} flutes * B cornet"),
    ("{{small|{{nowrap|{n} bells}} }} end", "{n} bells end"),
]


@query("m2_wikitext_shapes", _shaped_sql(_WIKITEXTS, "text"))
def m2_wikitext_shapes(spark, sf_dir):
    shown = markup.wikitext_text(F.col("raw"))
    return _shaped(spark, sf_dir, _WIKITEXTS).select("id", F.trim(F.regexp_replace(shown, r"\s+", " ")).alias("text"))


@query(
    "p10_doublings",
    "SELECT o_orderkey AS ord, 'cornet' AS instrument, 'trumpet' AS parent, CASE o_orderkey % 3 WHEN 0 THEN '1st' WHEN 1 THEN '2nd and 3rd' ELSE '4th' END AS player FROM orders",
)
def p10_doublings(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.when(k % 3 == 0, "1st doubling cornet").when(k % 3 == 1, "2nd and third dbl. cornet").otherwise("4 also 2nd cornet")
    texts = table(spark, sf_dir, "orders").select(k.alias("ord"), F.concat((k % 5 + 4).cast("string"), F.lit(" trumpets ("), said, F.lit("), harp")).alias("text"))
    return scoring.parse_scoring(texts, "text").select("ord", F.explode("scoring.doublings").alias("x")).select("ord", "x.instrument", "x.parent", "x.player")


@query(
    "p8_alternatives",
    "SELECT o_orderkey AS ord, CAST(o_orderkey % 6 + 2 AS INT) AS trumpets, CAST(CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 4 + 2 ELSE 0 END AS INT) AS cornets FROM orders",
)
def p8_alternatives(spark, sf_dir):
    k = F.col("o_orderkey")
    link = F.when(k % 3 == 0, " trumpets or cornets").when(k % 3 == 1, " trumpets oder cornets").otherwise(F.concat(F.lit(" trumpets, "), k % 4 + 2, F.lit(" cornets or flugelhorns")))
    texts = table(spark, sf_dir, "orders").select(k.alias("ord"), F.concat(F.lit("oboe, "), k % 6 + 2, link, F.lit(", harp")).alias("text"))
    return scoring.parse_scoring(texts, "text").select("ord", scoring.count_of(F.col("scoring"), "trumpet").alias("trumpets"), scoring.count_of(F.col("scoring"), "cornet").alias("cornets"))


@query(
    "p11_clauses_of_asides",
    """SELECT o_orderkey AS ord, CAST(o_orderkey % 5 + 3 AS INT) AS trumpets, CASE WHEN o_orderkey % 2 = 0 THEN 'piccoloTrumpet:1st;flugelhorn:2nd' ELSE 'cornet:3rd' END AS doublings,
    CAST(CASE WHEN o_orderkey % 2 = 1 THEN 2 ELSE 0 END AS INT) AS flugelhorns FROM orders""",
)
def p11_clauses_of_asides(spark, sf_dir):
    k = F.col("o_orderkey")
    aside = F.when(k % 2 == 0, "1st doubling piccolo trumpet, 2nd doubling flugelhorn").otherwise("3rd doubling cornet; 2 flugelhorns offstage")
    texts = table(spark, sf_dir, "orders").select(k.alias("ord"), F.concat(k % 5 + 3, F.lit(" trumpets ("), aside, F.lit(") and timpani")).alias("text"))
    x = scoring.parse_scoring(texts, "text")
    named = F.array_join(F.transform("scoring.doublings", lambda v: F.concat(v["instrument"], F.lit(":"), v["player"])), ";")
    return x.select("ord", scoring.count_of(F.col("scoring"), "trumpet").alias("trumpets"), named.alias("doublings"), scoring.count_of(F.col("scoring"), "flugelhorn").alias("flugelhorns"))


@query("m11_caps", "SELECT conv_id, turn, sha256(CASE WHEN length(text) > 400 THEN substr(text, 1, 399) || '…' ELSE text END) AS shown FROM conversations")
def m11_caps(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(markup.capped(F.col("text")), 256).alias("shown"))


@query("d7_sequences", f"SELECT ord, lower(form) AS stem, n, CASE WHEN ord % 3 = 0 THEN 'op' END AS system FROM ({d.WORKS}) w")
def d7_sequences(spark, sf_dir):
    both = d.derive(spark, sf_dir, d.WORKS).select("ord", chronology.series_of(F.col("t")).alias("s"), chronology.catalogue_of(F.col("cat")).alias("k"))
    return both.select("ord", "s.stem", F.col("s.n").alias("n"), F.col("k.stem").alias("system"))


# ── whole jobs ────────────────────────────────────────────────────────────────

#: Three sources of works by fifty composers; years of the library's works are harvested, lives of every second composer are known.
_BUILD = f"""WITH r AS (SELECT id AS ord, CASE WHEN rank = 2 THEN 2 ELSE rank END AS rank, CAST(substr(c, 2) AS BIGINT) AS k, key, y FROM ({_KEYED}) x),
    f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, ord) AS n, max(CASE WHEN rank = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY key) = 1 AS held FROM r),
    x AS (SELECT *, rank = 0 OR (NOT held AND n = 1) AS kept FROM f),
    o AS (SELECT key, min((rank, ord)) AS first FROM x WHERE kept GROUP BY key),
    b AS (SELECT key, arg_min(y, (rank, ord)) AS y FROM x WHERE NOT kept AND rank = 2 AND y IS NOT NULL GROUP BY key),
    w AS (SELECT x.ord, x.rank, x.k, coalesce(x.y, CASE WHEN (x.rank, x.ord) = o.first THEN b.y END) AS y, (x.y IS NOT NULL AND x.rank = 2) OR (x.y IS NULL AND (x.rank, x.ord) = o.first AND b.y IS NOT NULL) AS h
      FROM x JOIN o USING (key) LEFT JOIN b USING (key) WHERE x.kept),
    l AS (SELECT *, CASE WHEN k % 2 = 0 THEN 1984 + k % 10 END AS born, CASE WHEN k % 6 = 0 THEN 1996 END AS died FROM w),
    z AS (SELECT *, h AND (coalesce(y < born + 5, false) OR coalesce(y > died, false)) AS rejected FROM l)"""


def _index(spark, sf_dir) -> jobs.Index:
    rows = tables.settled(d.derive(spark, sf_dir, d.RANKED).withColumn("k", F.substring("c", F.lit(2), F.length("c")).cast("long")))
    ord_, k = F.col("ord"), F.col("k")
    trumpets = F.concat((ord_ % 5 + 2).cast("string"), F.lit(" trumpets, strings"))
    own = rows.select("ord", "rank", F.concat(F.lit("Ana Kund"), k).alias("composer"), F.concat(F.lit("Kund"), k, F.lit(", Ana")).alias("composer_sort"), F.concat(F.lit("k"), k).alias("composer_id"), F.col("t").alias("title"), "y", trumpets.alias("text"), ord_.cast("string").alias("page"), F.timestamp_seconds(ord_).alias("stamp"))
    given, n = own.withColumn("year", F.col("y")), (ord_ % 5 + 2).cast("string")
    # A curated row is counted by one text and shows another; a publisher names soloists, or writes digits.
    curated = given.where("rank = 0").withColumns({"full": F.col("text"), "text": F.concat(n, F.lit(" trumpets")), "note": F.concat(F.lit("See "), ord_)})
    soloist, digits = F.concat(F.lit("solo trumpet; "), ord_ % 5 + 1, F.lit(" trumpets, strings")), F.concat(F.lit("*3222 – 4"), n, F.lit("31 – hp – str"))
    published = given.where("rank = 1").withColumn("text", F.when(ord_ % 8 == 1, soloist).otherwise(digits))
    sources = {"curated": curated, "publisher": published, "library": own.where("rank = 2")}
    found_years = own.where("rank = 2 and y is not null").select(F.lit("library").alias("src"), "page", F.col("y").alias("year"))
    lives = rows.select("k").distinct().where("k % 2 = 0")
    found_dates = lives.select(k.alias("ord"), F.concat(F.lit("Kund"), k, F.lit(", Ana")).alias("sort"), (k % 10 + 1984).cast("int").alias("born"), F.when(k % 6 == 0, F.lit(1996)).alias("died"), F.lit(None).cast("array<string>").alias("alt"))
    return jobs.build_index(sources, found_years, found_dates)


@query(
    "w1_build_index",
    f"""{_BUILD} SELECT CASE rank WHEN 0 THEN 'curated' WHEN 1 THEN 'publisher' ELSE 'library' END AS src, ord, CASE WHEN rejected THEN NULL ELSE y END AS y,
    ['two', 'three', 'four', 'five', 'six'][ord % 5 + 1] || ' trumpets' AS s, CASE WHEN rank = 1 AND ord % 8 = 1 THEN 'solo trumpet, ' || (ord % 5 + 1) || ' trumpets, strings'
      WHEN rank = 1 THEN '3 flutes, 2 oboes, 2 clarinets, 2 bassoons, 4 horns, ' || (ord % 5 + 2) || ' trumpets, 3 trombones, tuba, harp, strings' ELSE (ord % 5 + 2) || ' trumpets, strings' END AS full_text,
    CASE WHEN rank = 0 THEN 'See ' || ord END AS note,
    CASE WHEN born IS NULL THEN NULL WHEN died IS NULL THEN 'b. ' || born ELSE born || '–' || died END AS dates, count(*) OVER (PARTITION BY k) AS n FROM z""",
)
def w1_build_index(spark, sf_dir):
    index = _index(spark, sf_dir)
    named = index.composers.select(F.col("composer_id").alias("c"), "dates", "n")
    return index.works.join(named, "c").select("src", (F.col("ord") % (1 << 40)).alias("ord"), "y", "s", F.col("full").alias("full_text"), "note", "dates", "n")


@query(
    "w1_build_statistics",
    f"""{_BUILD} SELECT count(*) AS works, count(CASE WHEN NOT rejected THEN y END) AS dated, CAST(0 AS BIGINT) AS placed, count(CASE WHEN h AND NOT rejected THEN 1 END) AS years_kept, count(CASE WHEN rejected THEN 1 END) AS years_rejected,
    count(DISTINCT k) AS composers, count(DISTINCT CASE WHEN born IS NOT NULL THEN k END) AS dates_added, CAST(0 AS BIGINT) AS via_variant, count(DISTINCT CASE WHEN born IS NOT NULL AND died IS NULL THEN k END) AS living, (SELECT max(ord) FROM f) AS data_date FROM z""",
)
def w1_build_statistics(spark, sf_dir):
    return _index(spark, sf_dir).statistics.withColumn("data_date", F.unix_timestamp("data_date"))


@query(
    "w2_read_articles",
    """SELECT 'r' || n_regionkey AS composer, 'Work ' || p_partkey AS title, CASE p_partkey % 3 WHEN 2 THEN 'no scoring' ELSE 'kept' END AS outcome, CASE p_partkey % 3 WHEN 0 THEN 'section' WHEN 1 THEN 'prose' END AS how,
    CASE WHEN p_partkey % 3 < 2 THEN p_partkey % 4 + 2 ELSE 0 END AS trumpets, CASE p_partkey % 2 WHEN 0 THEN 'Symphony' ELSE 'Orchestral' END AS genre FROM part JOIN nation ON n_nationkey = p_partkey % 25""",
)
def w2_read_articles(spark, sf_dir):
    nation, p = table(spark, sf_dir, "nation"), F.col("p_partkey")
    works = table(spark, sf_dir, "part").join(nation, p % 25 == F.col("n_nationkey")).select(p, F.concat(F.lit("Work "), p).alias("title"), F.concat(F.lit("r"), "n_regionkey").alias("composer"))
    root, sub = F.concat(F.lit("Category:"), "composer"), F.concat(F.lit("Category:Symphonies by "), "composer")
    roots = works.select("composer", root.alias("category")).distinct()
    edges = roots.select(root.alias("parent"), sub.alias("child"), F.lit("subcategory").alias("kind"), F.lit(0).cast("long").alias("ord"))
    edges = edges.unionByName(works.select(F.when(p % 2 == 0, sub).otherwise(root).alias("parent"), F.col("title").alias("child"), F.lit("page").alias("kind"), p.alias("ord")))
    texts = _wiki(spark, sf_dir)
    moved = texts.where("id % 5 = 0").select(F.concat(F.lit("Moved "), "id").alias("title"), "wikitext")
    own = texts.select(F.concat(F.lit("Work "), "id").alias("title"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("#REDIRECT [[Moved "), "id", F.lit("]]"))).otherwise(F.col("wikitext")).alias("wikitext"))
    out = jobs.read_articles(roots, edges, own.unionByName(moved), most=1 << 40)
    return out.select("composer", "title", "outcome", "how", F.coalesce(scoring.count_of(F.col("scoring"), "trumpet"), F.lit(0)).cast("long").alias("trumpets"), "genre")


@query("w3_answer", f"{_BUILD} SELECT count(*) AS works, count(DISTINCT k) AS composers FROM z WHERE ord % 5 + 2 >= 3")
def w3_answer(spark, sf_dir):
    _, counts, _ = jobs.answer(_index(spark, sf_dir), [("trumpet", "ge", 3)])
    return counts


@query(
    "w3_first_batch",
    f"""{_BUILD} SELECT ord, place FROM (SELECT ord, row_number() OVER (ORDER BY coalesce(CASE WHEN rejected THEN NULL ELSE y END, 9999), 'kund' || k || ' ana', {_DUCK_FOLD.format('t')}, rank, ord) AS place FROM z JOIN (SELECT id AS tid, t FROM ({d.RANKED}) q) q ON tid = ord WHERE ord % 5 + 2 >= 3) v WHERE place <= 150""",
)
def w3_first_batch(spark, sf_dir):
    batch, _, _ = jobs.answer(_index(spark, sf_dir), [("trumpet", "ge", 3)], by="date")
    placed = batch.withColumn("place", F.row_number().over(W.orderBy(*search.ordering("date"))).cast("long"))  # a batch of 150
    return placed.select((F.col("ord") % (1 << 40)).alias("ord"), "place")


#: Products of parts: a soloist beside a section, digits, a short description with a second edition, an edition without any, none, none of the family.
_PRODUCTS = """SELECT p_partkey AS id, p_partkey AS ord, p_partkey % 6 AS k, p_size % 5 + 2 AS n, 1990 + p_size % 20 AS y FROM part"""


def _products(spark, sf_dir) -> DataFrame:
    rows, k = d.derive(spark, sf_dir, _PRODUCTS), F.col("k")
    say = lambda *x: F.concat(*[c if isinstance(c, Column) else F.lit(c) for c in x])
    n = F.col("n").cast("string")
    told = (
        F.when(k == 0, say("<p>Composed in ", F.col("y"), "</p> Instrumentation: solo trumpet; ", n, " trumpets, strings. Program notes by X"))
        .when(k == 1, say("Instrumentation: *3222 – 4", n, "31 – t+4 – hp – str<br/>Commissioned by X")).when(k == 2, "").when(k == 3, " ").when(k == 4, "<b>Nothing</b>")
        .otherwise("Instrumentation: 2 oboes, harp")
    )
    short = F.when(k == 2, "For trumpet and piano / 5 minutes").otherwise("")
    kinds = F.when(k == 0, F.array(F.lit("Solos"), F.lit("Concertos (with Orchestra)"))).when(k == 1, F.array(F.lit("Orchestra"))).otherwise(F.array(F.lit("New")))
    own = rows.select("ord", "id", say("Piece ", F.col("id")).alias("title"), told.alias("description"), short.alias("short"), kinds.alias("categories"))
    # Another edition of the pieces for trumpet and piano, for more players; and the first products once more under their ids.
    more = own.where(F.col("id") % 6 == 2).withColumns({"id": -F.col("id"), "title": say(F.col("title"), " (Rental parts)"), "short": F.lit("For 4 cornets and piano / 6 minutes")})
    again = own.withColumns({"ord": F.col("ord") + (1 << 40), "description": F.lit("Instrumentation: 9 trumpets")})
    return own.unionByName(more).unionByName(again)


@query(
    "w4_read_products",
    f"""SELECT CASE WHEN k = 2 THEN -id ELSE id END AS id, 'Piece ' || id AS title, CASE k WHEN 0 THEN 'trumpet:' || (n + 1) WHEN 1 THEN 'trumpet:' || n ELSE 'cornet:4' END AS counts,
    CASE WHEN k = 0 THEN y END AS year, CASE k WHEN 0 THEN 'Concerto' WHEN 1 THEN 'Orchestral' ELSE 'Other' END AS genre FROM ({_PRODUCTS}) p WHERE k < 3""",
)
def w4_read_products(spark, sf_dir):
    works, _ = harvests.read_products(_products(spark, sf_dir), 2030)
    counts = F.array_join(F.transform(F.filter(F.map_entries("scoring.counts"), lambda e: e["value"] > 0), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return works.select("id", "title", counts.alias("counts"), F.col("year").cast("long").alias("year"), "genre")


@query(
    "w4_product_funnel",
    f"SELECT CASE WHEN k = 3 THEN 'edition' WHEN k = 4 THEN 'no scoring' WHEN k = 5 THEN 'no family' ELSE 'kept' END AS outcome, sum(CASE WHEN k = 2 THEN 2 ELSE 1 END) AS n FROM ({_PRODUCTS}) p GROUP BY 1",
)
def w4_product_funnel(spark, sf_dir):
    return harvests.read_products(_products(spark, sf_dir), 2030)[1]


@query(
    "w5_read_library",
    """WITH p AS (SELECT p_partkey AS id, p_partkey % 5 AS k, p_size % 5 + 2 AS n FROM part)
    SELECT 'Piece ' || id || ', Op.' || n || ' (Kund' || (id % 40) || ', Ana)' AS page, 'Piece ' || id AS title, 'Op.' || n AS cat, 'Ana Kund' || (id % 40) AS composer, 'kund' || (id % 40) || '-ana' AS composer_id,
      CASE k WHEN 0 THEN n || ' trumpets, organ' WHEN 1 THEN 'cornet, harp' WHEN 2 THEN n || ' trumpets, harp' ELSE n || ' cornets' END AS text, CASE k WHEN 0 THEN 'category' WHEN 1 THEN 'detail' WHEN 2 THEN 'field' ELSE 'category' END AS how,
      k = 3 AS arr, CASE k WHEN 0 THEN n || ' trumpets' WHEN 1 THEN n || ' trumpets, harp;trumpet' ELSE '' END AS others FROM p WHERE k < 4""",
)
def w5_read_library(spark, sf_dir):
    k, n = F.col("k"), F.col("n").cast("string")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("k"), (F.col("p_size") % 5 + 2).alias("n"))
    page = F.concat(F.lit("Piece "), "id", F.lit(", Op."), n, F.lit(" (Kund"), F.col("id") % 40, F.lit(", Ana)"))
    part = tables.settled(part.withColumn("page", page))
    category = F.when(k == 0, F.concat(F.lit("For "), n, F.lit(" trumpets, organ"))).when(k == 1, "For trumpet (arr)").when(k == 3, F.concat(F.lit("For "), n, F.lit(" cornets (arr)"))).when(k == 4, "For 2 oboes")
    members = part.where("k <> 2").select(category.alias("category"), "page").unionByName(part.where("k = 2").select(F.lit("For trumpets -- junk").alias("category"), "page"))
    detail = F.when(k == 0, F.concat(n, F.lit(" [[x|trumpets]]"))).when(k == 1, "cornet,<br>harp").when(k == 2, "{{x}}")
    short = F.when(k == 1, F.concat(n, F.lit(" trumpets, harp"))).when(k == 2, F.concat(F.lit("'" * 3), n, F.lit(" trumpets"), F.lit("'" * 3), F.lit(", harp"))).when(k == 4, "strings")
    out = harvests.read_library(members, part.select("page", short.alias("instrumentation"), detail.alias("detail")))
    others = F.array_join(F.transform("alternates", lambda x: x["text"]), ";")
    return out.select("page", "title", "cat", "composer", "composer_id", "text", "how", "arr", others.alias("others"))


#: Works whose pages say a year, in a source of their own.
_YEARED = "SELECT o_orderkey AS id, o_orderkey % 4 AS k, year(o_orderdate) AS y FROM orders"


@query(
    "w6_read_years",
    f"""SELECT 'library' AS src, 'L' || id AS page, CAST(y AS INT) AS year, 'field' AS how FROM ({_YEARED}) o WHERE k < 2 UNION ALL
    SELECT 'encyclopaedia', 'E' || id, CAST(CASE k WHEN 2 THEN y - 7 ELSE y END AS INT), CASE k WHEN 2 THEN 'category' ELSE 'infobox' END FROM ({_YEARED}) o WHERE k > 0""",
)
def w6_read_years(spark, sf_dir):
    rows, path, k = tables.settled(d.derive(spark, sf_dir, _YEARED)), _folder(spark, "years"), F.col("k")
    own, page = F.concat(F.lit("L"), "id"), F.concat(F.lit("E"), "id")
    library = rows.select(own.alias("page"), F.when(k < 2, F.concat(F.lit("{{\n|Year/Date of Composition="), F.col("y") - 2, F.lit("–"), "y", F.lit("\n}}"))).otherwise("{{}}").alias("wikitext"))
    stated = F.when(k == 1, F.concat(F.lit("#REDIRECT [[M"), "id", F.lit("]]"))).when(k == 2, F.concat(F.lit("[[Category:"), F.col("y") - 7, F.lit(" compositions]]"))).when(k == 3, F.concat(F.lit("{{Infobox x\n| year = "), "y", F.lit("\n}}")))
    moved = rows.where("k = 1").select(F.concat(F.lit("M"), "id").alias("title"), F.concat(F.lit("{{Infobox x\n| year = "), "y", F.lit("\n}}")).alias("wikitext"))
    articles = rows.where("k > 0").select(page.alias("title"), stated.alias("wikitext")).unionByName(moved)
    asked = rows.select(F.lit("library").alias("src"), own.alias("page")).unionByName(rows.select(F.lit("encyclopaedia").alias("src"), page.alias("page")))
    harvests.read_years(asked, library, articles.limit(0), path, 2030)
    return harvests.read_years(asked.where("src = 'encyclopaedia'"), library, articles, path, 2030)


@query(
    "w7_read_persons",
    f"""SELECT id AS ord, CASE WHEN k <> 3 THEN b END AS born, CASE WHEN k IN (0, 3) THEN e END AS died, found, with_birth FROM ({_PAGES}) p,
    (SELECT count(CASE WHEN k < 6 AND k <> 2 THEN 1 END) AS found, count(CASE WHEN k IN (0, 1, 4, 5) THEN 1 END) AS with_birth FROM ({_PAGES}) q) s WHERE k < 6 AND k <> 2""",
)
def w7_read_persons(spark, sf_dir):
    pages = _person_pages(spark, sf_dir)
    sort = F.concat(F.lit("Kund"), "id", F.lit(", Ana"))
    dates, statistics = harvests.read_persons(pages.select(F.col("id").alias("ord"), sort.alias("sort")), pages.where("wikitext is not null").select(F.concat(F.lit("Category:"), sort).alias("title"), "wikitext"), 2100)
    return dates.join(statistics.select("found", "with_birth"), F.lit(True)).select("ord", F.col("born").cast("long").alias("born"), F.col("died").cast("long").alias("died"), "found", "with_birth")  # one row of statistics
