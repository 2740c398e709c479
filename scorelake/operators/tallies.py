"""Which rows count, counts of works and composers, and unions of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import product_title
from ..functions.text import fold

#: Sections larger than this are worth a look.
SECTION_LIMIT = 6
REPORT = 20


def count_rows() -> Column:
    return F.count(F.lit(1))


# ── rows ──────────────────────────────────────────────────────────────────────


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """The rows of all sources with `src` and `rank`, the place of the source among them; columns that a source lacks are null."""
    out = None
    for rank, (name, rows) in enumerate(sources.items()):
        rows = rows.withColumn("src", F.lit(name)).withColumn("rank", F.lit(rank))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def complete_rows(records: DataFrame, size: Column, *needed: str) -> DataFrame:
    """Rows that have all columns `needed` and players in the family."""
    for name in needed:
        records = records.where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    return records.where(size > 0)


def attach_years(works: DataFrame, years: DataFrame, on: list[str]) -> DataFrame:
    """works with `y` from years (`on`, year) where they have none, and `harvested`: whether it came from there."""
    found = years.groupBy(*on).agg(F.min("year").alias("_year"))
    missing = F.coalesce("y", F.lit(0)) == 0
    # Only works without a year that name a page move; `works` is read twice.
    asks = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on), missing)
    asked = works.where(asks).join(found, on, "left").withColumn("harvested", F.col("_year").isNotNull()).withColumn("y", F.col("_year")).drop("_year")
    return asked.unionByName(works.where(~asks).withColumn("harvested", F.lit(False)).withColumn("y", F.when(~missing, F.col("y"))))


def distinct_pages(*pages: DataFrame) -> DataFrame:
    """The titles in any of the tables, each once."""
    out = pages[0].select("title")
    for more in pages[1:]:
        out = out.unionByName(more.select("title"))
    return out.distinct()


def merged_names(rows: DataFrame, key: str, names: str) -> DataFrame:
    """For each key the distinct names in an array column of its rows, in order; nulls add none."""
    return rows.select(key, F.explode_outer(names).alias("_name")).groupBy(key).agg(F.array_sort(F.collect_set("_name")).alias(names))


def merge_products(products: DataFrame, count: str = "trumpets") -> DataFrame:
    """One row per work of products (id, ord, title): of an id the first; of a title, editions and punctuation aside, the one with most players.

    Equal numbers keep the first. A title is folded to letters and digits.
    """
    own = products.select("id", F.struct(*[F.col(c) for c in products.columns]).alias("row"), F.col("ord").alias("_ord"))
    first = own.groupBy("id").agg(F.min_by("row", "_ord").alias("row")).select("row.*")
    key = F.replace(fold(product_title(F.col("title"))), F.lit(" "), F.lit(""))
    best = F.max_by(F.struct(*[F.col(c) for c in products.columns]), F.struct(F.coalesce(count, F.lit(0)), -F.col("ord")))
    return first.groupBy(key.alias("_key")).agg(best.alias("row")).select("row.*")


def composers_with_works(composers: DataFrame, counts: DataFrame) -> DataFrame:
    """composers (composer_id) with n and n_arr from counts (c, n, n_arr); those without either are left out."""
    both = counts.select(F.col("c").alias("composer_id"), "n", "n_arr")
    return composers.join(both, "composer_id").where(F.col("n") + F.col("n_arr") > 0)


def plausibility_report(works: DataFrame, limit: int = SECTION_LIMIT, most: int = REPORT) -> DataFrame:
    """The `most` largest sections over `limit` among works (ord, src, arr, size) that are neither curated nor arrangements."""
    odd = works.where((F.coalesce("src", F.lit("")) != "curated") & ~F.col("arr") & (F.col("size") > limit))
    return odd.orderBy(F.desc("size"), "ord").limit(most)


# ── counts ────────────────────────────────────────────────────────────────────


def works_per_composer(works: DataFrame) -> DataFrame:
    """c, n and n_arr: a composer's works and arrangements."""
    return works.groupBy("c").agg(F.count_if(~F.col("arr")).alias("n"), F.count_if("arr").alias("n_arr"))


def works_of_source(works: DataFrame, src: str) -> DataFrame:
    """c and works: a composer's works in one source."""
    return works.where(F.col("src") == src).groupBy("c").agg(count_rows().alias("works"))


def works_by(works: DataFrame, heading: str) -> DataFrame:
    """A row for each value of a column, source, genre or composer, with its works."""
    return works.groupBy(heading).agg(count_rows().alias("works"))


def match_counts(matches: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: works, and their composers; counted by a sketch if that is enough."""
    composers = F.approx_count_distinct("c") if approximate else F.countDistinct("c")
    return matches.agg(count_rows().alias("works"), composers.alias("composers"))


def top_composers(works: DataFrame, most: int) -> DataFrame:
    """The `most` composers with most works; of equal numbers the smaller id first."""
    return works.groupBy("c").agg(count_rows().alias("n")).orderBy(F.desc("n"), "c").limit(most)


def build_statistics(works: DataFrame, composers: DataFrame) -> DataFrame:
    """One row about a build.

    works (y, sy, harvested, rejected), composers (dates_added, via_variant, living): numbers of both; works with a year,
    placed by their series or catalogue alone, with a harvested year that was kept or rejected; composers given dates,
    by a variant of their name, and alive.
    """
    dated = F.coalesce("y", F.lit(0)) != 0
    a = works.agg(
        count_rows().alias("works"), F.count_if(dated).alias("dated"), F.count_if(~dated & F.col("sy").isNotNull()).alias("placed"),
        F.count_if(F.col("harvested") & ~F.col("rejected")).alias("years_kept"), F.count_if("rejected").alias("years_rejected"),
    )
    b = composers.agg(count_rows().alias("composers"), F.count_if("dates_added").alias("dates_added"), F.count_if(F.col("dates_added") & F.col("via_variant")).alias("via_variant"), F.count_if("living").alias("living"))
    return a.join(b, F.lit(True))  # one row each


def person_statistics(people: DataFrame) -> DataFrame:
    """One row about looked-up people (missing: no page; born, died: their record, both null without one)."""
    record = ~F.col("missing") & (F.col("born").isNotNull() | F.col("died").isNotNull())
    return people.agg(
        count_rows().alias("looked_up"), F.count_if(record).alias("found"), F.count_if(~F.col("missing") & ~record).alias("no_record"), F.count_if("missing").alias("page_missing"),
        F.count_if(record & F.col("born").isNotNull()).alias("with_birth"), F.count_if(record & F.col("born").isNotNull() & F.col("died").isNull()).alias("no_death"),
    )


def product_funnel(products: DataFrame) -> DataFrame:
    """Products by what became of them: products (described, scoring, total, mentions) -> (outcome, n)."""
    outcome = (
        F.when(~F.col("described"), "edition").when(F.col("scoring").isNull(), "no scoring")
        .when((F.col("total") == 0) & ~F.col("mentions"), "no family").when(F.col("total") == 0, "no scoring").otherwise("kept")
    )
    return products.groupBy(outcome.alias("outcome")).agg(count_rows().alias("n"))


def data_date(*stamps: Column) -> Column:
    """The latest of several stamps of harvests, as an aggregate; not the time of the build."""
    return F.max(F.greatest(*stamps)) if len(stamps) > 1 else F.max(stamps[0])
