"""Composers across sources: one identity each, their dates, and lookups by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, slug, sort_form
from ..sources.tables import settled
from .joins import WHOLE, join_split


def _renamed(records: DataFrame, none: Column) -> DataFrame:
    """Records under their canonical name, where there is one: their own becomes an alias, their id and sort name go."""
    found = F.col("canonical").isNotNull()
    return (
        records.withColumn("aliases", F.when(found, F.array_append(F.coalesce("aliases", none), F.col("name"))).otherwise(F.col("aliases")))
        .withColumn("id", F.when(~found, F.col("id"))).withColumn("sort", F.when(~found, F.col("sort"))).withColumn("name", F.coalesce("canonical", "name"))
    )


def resolve_composers(records: DataFrame, variants: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """records (rank, ord, name, id, sort, dates, aliases) -> (records with composer_id, composers).

    A known variant (variants: variant, canonical) is replaced by the canonical name and becomes an alias. Equal folded
    names are one composer; the first record in (rank, ord) fixes the id: the one given, else the slug of its sort form.
    Records are added up by what they say of the composer first, so that names are folded, and known by a variant, once each
    and not once a record; then each record takes the id of its name, where it lies if very many share that. `records` is
    read two or three times: give it settled if it is dear.
    """
    none = F.array().cast("array<string>")
    said = ["name", "id", "sort", "dates", "aliases", "rank"]
    df = settled(records.groupBy(*said).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("_n")))
    df = df.withColumn("_given", F.coalesce("name", F.lit(""))).withColumn("_key", fold(F.col("name"))).withColumn("canonical", F.lit(None).cast("string"))
    if variants is not None:
        known = variants.select(fold(F.col("variant")).alias("_key"), "canonical").dropDuplicates(["_key"])
        df = _renamed(df.drop("canonical").join(known, "_key", "left"), none).withColumn("_key", fold(F.col("name")))
    place = F.struct("rank", "ord")
    df = df.withColumn("_sort", F.coalesce("sort", sort_form(F.col("name"))))
    df = settled(df)
    ids = settled(df.groupBy("_key").agg(F.min_by(F.coalesce("id", slug(F.col("_sort"))), place).alias("composer_id"), F.sum("_n").alias("_n")))
    linked = join_split(df.withColumnRenamed("_n", "_records"), ids, ["_key"], "_n", whole=WHOLE)
    names = settled(linked.groupBy("_given").agg(F.first("composer_id").alias("composer_id"), F.first("canonical").alias("canonical"), F.sum("_records").alias("_n")))
    composers = linked.groupBy("composer_id").agg(
        F.min_by("name", place).alias("name"),
        F.min_by("_sort", place).alias("sort"),
        F.min_by("dates", F.when(F.col("dates").isNotNull(), place)).alias("dates"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases"),
    )
    own = join_split(records.withColumn("_given", F.coalesce("name", F.lit(""))), names, ["_given"], "_n", whole=WHOLE)
    return (own if variants is None else _renamed(own, none)).select(*records.columns, "composer_id"), composers


def composer_dates(composers: DataFrame, dates: DataFrame) -> DataFrame:
    """Adds born, died and via_variant to composers (composer_id, sort) from dates (ord, sort, born, died, alt).

    An exact sort name first; else the first record of the same folded surname that shares a forename word, its own or
    a listed variant.
    """
    surname = lambda c: fold(F.element_at(F.split(c, ","), 1))
    forenames = lambda c: F.filter(F.split(fold(F.array_join(F.slice(F.split(c, ","), F.lit(2), F.size(F.split(c, ","))), " ")), " "), lambda w: w != "")
    exact = dates.groupBy("sort").agg(F.min_by(F.struct("born", "died"), "ord").alias("_exact"))
    people = dates.select("ord", "born", "died", surname(F.col("sort")).alias("_surname"), F.array_union(forenames(F.col("sort")), F.coalesce("alt", F.array().cast("array<string>"))).alias("_names"))
    df = composers.join(exact, "sort", "left")
    open_ = df.where("_exact is null").select("composer_id", surname(F.col("sort")).alias("_surname"), forenames(F.col("sort")).alias("_own"))
    # Of each surname and forename word the first record, so that a composer meets one record a word, not all namesakes.
    first = people.select("_surname", F.explode(F.array_distinct("_names")).alias("_word"), "ord", F.struct("born", "died").alias("life")).groupBy("_surname", "_word").agg(F.min_by(F.struct("ord", "life"), "ord").alias("_first"))
    asked = open_.select("composer_id", "_surname", F.explode(F.array_distinct("_own")).alias("_word"))
    near = asked.join(first, ["_surname", "_word"]).groupBy("composer_id").agg(F.min_by("_first.life", "_first.ord").alias("_near"))
    df = df.join(near, "composer_id", "left")
    found = F.coalesce("_exact", "_near")
    return df.withColumn("born", found["born"]).withColumn("died", found["died"]).withColumn("via_variant", F.col("_exact").isNull() & F.col("_near").isNotNull()).drop("_exact", "_near")


#: Distinct query texts (with their pieces) that are broadcast at most; more are joined by shuffle.
QUERY_TEXTS = 200_000
#: Lengths of the prefixes by which suffixes of names are found; a longer query is found by the longest of these and compared.
PREFIXES = (*range(1, 17), 20, 24, 32, 48, 64)


def _asked(queries: DataFrame, least: int) -> tuple[DataFrame, DataFrame, bool]:
    """(query_id, q) of the folded queries, their distinct texts (q), and whether these are few enough to be broadcast."""
    q = queries.select("query_id", fold(F.col("text")).alias("q")).where(F.length("q") >= least)
    texts = settled(q.select("q").distinct())
    return q, texts, texts.limit(QUERY_TEXTS + 1).count() <= QUERY_TEXTS


def _named(composers: DataFrame) -> DataFrame:
    """composers (composer_id, name, sort, n) with their folded full, sort and last name."""
    sort = F.coalesce(F.col("sort"), F.lit(""))
    return composers.select("*", fold(F.col("name")).alias("_full"), fold(sort).alias("_sort"), fold(F.element_at(F.split(sort, ","), 1)).alias("_last"))


def _prefixes(text: Column) -> Column:
    """The prefixes of a text that have one of the lengths of PREFIXES."""
    lengths = F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.length(text))
    return F.transform(lengths, lambda n: F.substring(text, F.lit(1), n))


def name_lookup(composers: DataFrame, queries: DataFrame, top: int = 8) -> DataFrame:
    """The `top` composers (composer_id, name, sort, aliases, n: works and arrangements) for each query (query_id, text).

    A surname or alias that is the query scores 100, the whole name or its sort form 95, a surname that begins with it
    80, an alias 75, a name or sort form 70; a sort form that contains it 40, a name 35. Up to 12 points are added for
    many works; ties go by sort form. A name contains a query where one of its suffixes begins with it. So each distinct
    suffix, and each alias, is found by those of its prefixes that have certain lengths, and a query by its own longest
    such prefix: one pass over the names, however many queries there are and however long.
    """
    q, texts, few = _asked(queries, 1)
    c = _named(composers).withColumn("_aliases", F.transform(F.coalesce("aliases", F.array().cast("array<string>")), fold))
    # Composers of the same names and as many works score alike for any query, so only the first `top` of them can be among its best.
    alike = W.partitionBy("_full", "_sort", "_last", "_aliases", "n").orderBy("composer_id")
    c = settled(c.withColumn("_alike", F.row_number().over(alike)).where(F.col("_alike") <= top).drop("_alike"))
    key = F.element_at(_prefixes(F.col("q")), -1)
    asked = texts.withColumn("_key", key)

    def suffixes(name):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda i: F.substring(name, i, F.length(name)))

    starts = F.array_distinct(F.flatten(F.array(suffixes(F.col("_full")), suffixes(F.col("_sort")), F.col("_aliases"))))
    keyed = c.withColumn("_key", F.explode(F.array_distinct(F.flatten(F.transform(starts, _prefixes)))))
    is_q, begins = (lambda x: x == F.col("q")), (lambda x: F.startswith(x, F.col("q")))
    score = (
        F.when(is_q(F.col("_last")) | F.array_contains("_aliases", F.col("q")), 100).when(is_q(F.col("_full")) | is_q(F.col("_sort")), 95).when(begins(F.col("_last")), 80)
        .when(F.exists("_aliases", begins), 75).when(begins(F.col("_full")) | begins(F.col("_sort")), 70).when(F.contains("_sort", F.col("q")), 40).when(F.contains("_full", F.col("q")), 35)
    )
    boost = F.least(F.lit(12.0), 2 * F.log2(F.col("n") + 1))
    order = W.partitionBy("q").orderBy(F.desc("score"), "_sort", "composer_id")
    met = keyed.join(F.broadcast(asked) if few else asked, "_key").withColumn("score", F.round(score + boost, 6)).where("score is not null")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("q", "composer_id", "score", "rank")
    return q.join(best, "q").select("query_id", "composer_id", "score", "rank")


def edits(length: Column) -> Column:
    """How many edits a query of that length allows."""
    return F.greatest(F.lit(2), F.floor(length / 3)).cast("int")


def _piece(length: Column, most: Column, i: Column) -> tuple[Column, Column]:
    """Where piece i of the most + 1 pieces of a query of that length begins (from 0), and its length; the last pieces are the longer ones."""
    size, longer = F.floor(length / (most + 1)).cast("int"), (length % (most + 1)).cast("int")
    short = most + 1 - longer
    return i * size + F.greatest(i - short, F.lit(0)), size + F.when(i >= short, 1).otherwise(0)


def near_candidates(forms: DataFrame, texts: DataFrame, few: bool = True) -> DataFrame:
    """(form, q, most) for the pairs that a shared piece makes possible; a pair may come several times.

    A query that allows k edits is cut into k + 1 pieces. In a form within k edits one of the pieces stands unchanged, and
    not far from its own place: piece i is shifted by at most i edits before it and k - i behind it, which also have to
    make up the difference of the lengths. So a form is asked for its pieces at those places alone, for every length of a
    query that could be near it.
    """
    n, k, i = F.col("_length"), F.col("most"), F.col("_i")
    asked = texts.select("q", F.length("q").alias("_length")).withColumn("most", edits(n)).withColumn("_i", F.explode(F.sequence(F.lit(0), k)))
    begin, size = _piece(n, k, i)
    asked = asked.select("q", "_length", "most", "_i", F.substring("q", begin + 1, size).alias("_text"))
    own = F.length("form")
    held = forms.select("form", F.explode(F.sequence(F.greatest(F.lit(3), F.floor(own * 0.75).cast("int") - 2), (F.floor(own * 1.5) + 2).cast("int"))).alias("_length"))
    held = held.withColumn("most", edits(n)).where(F.abs(own - n) <= k).withColumn("_i", F.explode(F.sequence(F.lit(0), k)))
    gap = own - n
    shift = F.sequence(F.greatest(-i, gap - (k - i)), F.least(i, gap + (k - i)))
    held = held.withColumn("_at", begin).withColumn("_size", size).withColumn("_shift", F.explode(F.when(F.greatest(-i, gap - (k - i)) <= F.least(i, gap + (k - i)), shift)))
    held = held.where((F.col("_at") + F.col("_shift") >= 0) & (F.col("_at") + F.col("_shift") + F.col("_size") <= own))
    held = held.select("form", "_length", "_i", F.substring("form", F.col("_at") + F.col("_shift") + 1, F.col("_size")).alias("_text")).distinct()
    return held.join(F.broadcast(asked) if few else asked, ["_length", "_i", "_text"]).select("form", "q", "most")


def near_names(composers: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """The `top` composers (composer_id, name, sort, n) within max(2, length / 3) edits of a query of three letters or more.

    The distance is the lesser of those to the surname and to the whole name, of equal distances the composer with more
    works is first. Equal names and equal queries are compared once, and only where they share a piece.
    """
    q, texts, few = _asked(queries, 3)
    c = _named(composers).select("composer_id", "n", F.explode(F.array_distinct(F.array("_full", "_last"))).alias("form"))
    order = W.partitionBy("q").orderBy("distance", F.desc("n"), "composer_id")
    near = near_candidates(c.select("form").distinct(), texts, few).withColumn("distance", F.levenshtein("form", "q"))
    near = near.where("distance <= most").select("q", "form", "distance").distinct()
    met = c.join(near, "form").groupBy("q", "composer_id").agg(F.min("distance").alias("distance"), F.max("n").alias("n"))
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).drop("n")
    return q.join(best, "q").select("query_id", "composer_id", "distance", "rank")
