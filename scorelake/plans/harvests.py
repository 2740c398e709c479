"""The jobs that make the sources' tables out of what was crawled: products, pages of the score library, years and persons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleanup, keys, markup, scoring, text, years
from ..functions.scoring import TRUMPETS, Family
from ..operators import harvest, search, tallies
from ..sources import tables

#: How much a source of a scoring is worth on a page: a category that isn't an arrangement, the detailed field, the short one.
CATEGORY, DETAIL, FIELD, ARRANGED = 2.0, 1.6, 1.5, 1.0


def read_products(products: DataFrame, max_year: int, family: Family = TRUMPETS) -> tuple[DataFrame, DataFrame]:
    """A publisher's products (ord, id, title, description, short, categories) as works, and a count of what became of the products.

    A product states its scoring in its description or, shorter, in front; prose behind it is cut off. Soloists count
    beside the section, and digits stand in where words name no player. Of an id the first product counts, of a title,
    editions aside, the one with most players. Works have ord, title, text, scoring, year and genre.
    """
    first = products.groupBy("id").agg(F.min_by(F.struct(*products.columns), "ord").alias("row")).select("row.*")
    described = (markup.html_text(F.col("description")) != "") | (markup.html_text(F.col("short")) != "")
    stated = tables.settled(markup.product_scoring(first, "description", "short").withColumnRenamed("scoring", "_stated").withColumn("_described", described))
    # Prose is cut off in Python: only for products that state a scoring.
    cut = tables.settled(stated.where("_stated is not null").withColumn("text", cleanup.cut_at_prose(F.col("_stated"), family)))
    read = tables.settled(markup.soloist_scoring(cut, "text", family))
    whole = read.unionByName(stated.where("_stated is null"), allowMissingColumns=True)
    seen = whole.select(F.col("_described").alias("described"), F.col("text").alias("scoring"), F.coalesce("scoring.total", F.lit(0)).alias("total"), scoring.mentions_family(F.col("text"), family).alias("mentions"))
    works = read.where(F.col("_described") & (F.col("scoring.total") > 0)).withColumn("players", F.col("scoring.total"))
    works = tallies.merge_products(works, "players")
    told = F.concat_ws(" ", markup.html_text(F.col("description")), markup.html_text(F.col("short")))
    columns = ("ord", "id", keys.product_title(F.col("title")).alias("title"), "text", "scoring", years.product_year(told, max_year).alias("year"), keys.genre_from_products(F.col("categories")).alias("genre"))
    return works.select(*columns), tallies.product_funnel(seen)


def read_library(members: DataFrame, fields: DataFrame, family: Family = TRUMPETS, most: int = 4) -> DataFrame:
    """One row for each page of the score library that states a scoring: its best one and up to `most` others.

    members (category, page) are pages in categories "For 2 trumpets, organ (arr)", of which those that are junk or don't
    name the family are passed over; fields (page, instrumentation, detail) are what pages say themselves. An original
    scoring goes before an arrangement, then the better source, more members of the family, more players. Rows have page,
    title, cat, composer, composer_sort, composer_id, text, scoring, arr, how and alternates (text, arr).
    """
    sizes = members.groupBy("category").agg(F.count(F.lit(1)).alias("_pages"))
    sane = sizes.where(harvest.sane_category(F.col("category"), F.col("_pages"), family)).select("category")
    named = scoring.from_category(F.col("category"))
    hits = members.join(sane, "category").select("page", F.lit("category").alias("how"), named["text"].alias("raw"), named["arrangement"].alias("arr"))
    found = [hits]
    for column, how in (("detail", "detail"), ("instrumentation", "field")):
        plain = markup.clean_detail(F.col(column))
        found.append(fields.where(F.col(column).isNotNull()).select("page", F.lit(how).alias("how"), plain.alias("raw"), F.lit(False).alias("arr")))
    candidates = tables.settled(reduce(lambda a, b: a.unionByName(b), found).where("raw <> ''"))
    parsed = scoring.parse_scoring(candidates, "raw", family).where("scoring.total > 0")
    worth = F.when(F.col("how") == "detail", DETAIL).when(F.col("how") == "field", FIELD).when(F.col("arr"), ARRANGED).otherwise(CATEGORY)
    parsed = tables.settled(parsed.withColumn("worth", worth))
    order = [F.desc("worth"), F.desc(F.size("scoring.present")), F.desc("scoring.total"), F.col("raw")]
    ranked = tables.settled(search.alternates(parsed, "page", order, most))
    others = ranked.where("alternate > 0").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("alternate", F.col("raw").alias("text"), "arr"))).alias("_all"))  # `most` a page
    others = others.select("page", F.transform("_all", lambda x: F.struct(x["text"].alias("text"), x["arr"].alias("arr"))).alias("alternates"))
    best = ranked.where("alternate = 0").join(others, "page", "left")
    split = best.withColumn("_t", F.explode(F.array(text.title_composer(F.col("page")))))
    split = split.withColumn("_k", F.explode(F.array(keys.split_catalogue(F.col("_t.title")))))
    sort = F.col("_t.composer")
    none = F.array().cast("array<struct<text:string,arr:boolean>>")
    return split.select(
        "page", F.col("_k.title").alias("title"), F.col("_k.catalogue").alias("cat"), text.display_name(sort).alias("composer"), sort.alias("composer_sort"),
        F.when(sort.isNotNull(), text.slug(sort)).alias("composer_id"), F.col("raw").alias("text"), "scoring", "arr", "how", F.coalesce("alternates", none).alias("alternates"),
    )


def read_years(asked: DataFrame, library: DataFrame, articles: DataFrame, path: str, max_year: int, field: str = "Year/Date of Composition") -> DataFrame:
    """The table of years (src, page, year, how) at `path`, with the sources that `asked` (src, page) names read again.

    library (page, wikitext) says its years in a field, articles (title, wikitext) in their infobox or a category; redirects
    are followed one page on. Sources that aren't asked for keep the years that they have.
    """
    pages = asked.select("src", "page").distinct()
    own = library.select("page", years.page_year(F.col("wikitext"), field, max_year).alias("year"), F.lit("field").alias("how"))
    # Years are read by tasks of equal size and written before the join, which may move them or send them to all tasks.
    moved = tables.spread(tables.settled(harvest.follow_redirects(articles)))
    told = tables.settled(moved.withColumn("_y", F.explode(F.array(years.article_year(F.col("wikitext"), max_year)))).select(F.col("title").alias("page"), "_y.year", "_y.how").where("year is not null"))
    found = pages.where("src = 'library'").join(own, "page").unionByName(pages.where("src = 'encyclopaedia'").join(told, "page"))
    found = found.where("year is not null").groupBy("src", "page").agg(F.min(F.struct("year", "how")).alias("_y")).select("page", "_y.year", "_y.how", "src")
    tables.refresh_partition(found, path, "src")
    return asked.sparkSession.read.parquet(path).select("src", "page", "year", "how")


def read_persons(composers: DataFrame, pages: DataFrame, max_year: int) -> tuple[DataFrame, DataFrame]:
    """Dates of composers (ord, sort) from their pages (title "Category:" and the sort name, wikitext), and a row about the search.

    The dates (ord, sort, born, died, alt, suspect) are what `operators.identity.composer_dates` takes.
    """
    asked = composers.select("ord", "sort").where("sort is not null").withColumn("title", F.concat(F.lit("Category:"), "sort"))
    texts = pages.groupBy("title").agg(F.first("wikitext").alias("wikitext"))
    looked = asked.join(texts, "title", "left").withColumn("_r", F.explode(F.array(years.person_record(F.col("wikitext"), max_year))))
    looked = tables.settled(looked.select("ord", "sort", F.col("wikitext").isNull().alias("missing"), "_r.born", "_r.died", "_r.alt", "_r.suspect", F.col("_r").isNotNull().alias("found")))
    return looked.where("found").drop("missing", "found"), tallies.person_statistics(looked.select("missing", "born", "died"))
