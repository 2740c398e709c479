"""From crawled pages to candidates: the category walk, redirects and what to leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.markup import redirect_target
from ..functions.scoring import TRUMPETS, Family, mentions_family

MOST_ARTICLES = 1000
# Categories and articles that hold no works.
NO_CATEGORY = r"(?i)^(Recordings|Ballets to the music|Lists|Compositions? by year|Albums|Songs with)"
NO_ARTICLE = r"(?i)^(List of|Discography|Category:|Template:|Portal:|File:)"


def sane_category(name: Column, pages: Column, family: Family = TRUMPETS) -> Column:
    """A category name that isn't junk, has pages and names the family."""
    return F.coalesce((F.length(name).between(1, 160)) & ~name.rlike(r"[<>{}|]|&\w+=|--|/\*") & (pages >= 1) & mentions_family(name, family), F.lit(False))


def holds_works(title: Column) -> Column:
    return ~title.rlike(NO_ARTICLE) & ~F.regexp_replace(title, "^Category:", "").rlike(NO_CATEGORY)


def walk(roots: DataFrame, edges: DataFrame, most: int = MOST_ARTICLES) -> DataFrame:
    """(composer, title, subcat, parent): the articles of each root (composer, category), two levels deep.

    edges (parent, child, kind, ord). The second level is followed only for categories "… by <composer>". An article
    belongs to the first category that lists it: the root, then subcategories in order. At most `most` per composer,
    the walk's own limit.
    """
    pages = edges.where("kind = 'page'").select(F.col("parent").alias("cat"), F.col("child").alias("title"), F.col("ord").alias("place")).where(~F.col("title").rlike(NO_ARTICLE))
    subs = edges.where("kind = 'subcategory'").where(holds_works(F.regexp_replace("child", "^Category:", ""))).select(F.col("parent").alias("up"), F.col("child").alias("cat"), F.col("ord").alias("sub"))
    none = F.lit(None).cast("string")
    level0 = roots.select("composer", F.col("category").alias("cat"), none.alias("subcat"), none.alias("parent"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    level1 = roots.join(subs, F.col("category") == F.col("up")).select("composer", "cat", F.col("cat").alias("subcat"), none.alias("parent"), F.lit(1).alias("depth"), F.col("sub").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    up = level1.select("composer", F.col("cat").alias("up"), "a")
    by_composer = F.lower(F.col("cat")).endswith(F.concat(F.lit(" by "), F.lower(F.col("composer"))))
    level2 = up.join(subs, "up").where(by_composer).select("composer", "cat", F.col("cat").alias("subcat"), F.col("up").alias("parent"), F.lit(1).alias("depth"), "a", F.col("sub").cast("long").alias("b"))
    found = level0.unionByName(level1).unionByName(level2).join(pages, "cat")
    first = F.min_by(F.struct("subcat", "parent", "depth", "a", "b", "place"), F.struct("depth", "a", "b", "place"))
    kept = found.groupBy("composer", "title").agg(first.alias("f"))
    n = F.row_number().over(W.partitionBy("composer").orderBy("f.depth", "f.a", "f.b", "f.place", "title"))
    return kept.withColumn("n", n).where(F.col("n") <= most).select("composer", "title", "f.subcat", "f.parent")


def follow_redirects(pages: DataFrame) -> DataFrame:
    """pages (title, wikitext) with a redirect's text replaced by its target's, one hop; of a missing target, null."""
    goal = pages.withColumn("_to", redirect_target(F.col("wikitext")))
    texts = pages.select(F.col("title").alias("_to"), F.col("wikitext").alias("_text")).dropDuplicates(["_to"])
    return goal.join(texts, "_to", "left").select("title", F.when(F.col("_to").isNull(), F.col("wikitext")).otherwise(F.col("_text")).alias("wikitext"))


def unread(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Titles of `pages` that `read` hasn't."""
    return pages.select("title").subtract(read.select("title"))


def funnel(articles: DataFrame) -> DataFrame:
    """Articles by what became of them: articles (title, text, total) -> (outcome, n)."""
    outcome = F.when(F.col("text").isNull(), "no scoring").when(F.col("total") == 0, "no family").otherwise("kept")
    return articles.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def requested_titles(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """pages (title, ...) with `requested`: the title that was asked for, where aliases (asked, title) say it was normalised, else its own."""
    known = aliases.select("title", F.col("asked").alias("_asked")).dropDuplicates(["title", "_asked"])
    return pages.join(known, "title", "left").withColumn("requested", F.coalesce("_asked", "title")).drop("_asked")
