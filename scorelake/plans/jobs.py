"""The operators in a row: building the merged index, reading scorings out of crawled pages, and answering a search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleanup, commentary, keys, markup, publisher, scoring, text, years
from ..functions.scoring import TRUMPETS, Family
from ..operators import chronology, dedupe, harvest, identity, search, tallies
from ..operators.joins import WHOLE, join_split
from ..sources import publishing, tables

#: The sources, best first.
SOURCES = ("curated", "publisher", "encyclopaedia", "library")
#: What a source's table has; what it lacks is null.
RECORD = (
    "ord long, composer string, composer_id string, composer_sort string, dates string, aliases array<string>, title string, cat string, year int, "
    "genre string, text string, full string, note string, also array<string>, arr boolean, page string, url string, stamp timestamp"
)


@dataclass
class Index:
    works: DataFrame
    composers: DataFrame
    statistics: DataFrame

    def publish(self, path: str, force: bool = False, verify=None) -> publishing.Outcome:
        """Makes these tables the current version at `path`, as `publishing.publish` says: equal ones are left, losses refused unless forced."""
        return tables.publish_index(self.works, self.composers, self.statistics, path, verify=verify, force=force)


def _typed(rows: DataFrame) -> DataFrame:
    """The rows with all columns of RECORD."""
    have = {c.lower() for c in rows.columns}
    kinds = [part.rsplit(" ", 1) for part in RECORD.split(", ")]
    return rows.select(*[(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in kinds])


#: 128 bits of a row's source and texts.
TEXT = ("_t1", "_t2")


def _digest(*columns: str) -> list:
    said = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*said), F.xxhash64(F.lit(1), *said)]


def _told(texts: DataFrame, sources: list[str], family: Family) -> DataFrame:
    """What is read in each of the texts (TEXT, src, text, full, _rows) that count players, and what is shown for it.

    Soloists and groups of digits are a publisher's. What is shown is tidied by source, so that each helper reads its own
    source's texts alone; a curated row may show another text than the one it is counted by.
    """
    texts, published = tables.settled(texts), F.col("src") == "publisher"
    read = scoring.parse_scoring(texts.where(~published), "text", family).unionByName(markup.soloist_scoring(texts.where(published), "text", family))
    read, shown, s = tables.settled(read.where("scoring.total > 0")), None, F.col("scoring")
    for name in sources:
        own = {"curated": F.col("full"), "encyclopaedia": cleanup.scoring_display(F.col("text"), family), "publisher": publisher.readable_scoring(F.col("text"))}.get(name, F.col("text"))
        kind = tables.spread(read.where(F.col("src") == name)).withColumn("_shown", own)
        if name != "curated":
            kind = kind.withColumn("_shown", commentary.strip_commentary(cleanup.collapse_strings(F.col("_shown")), family))
        else:
            kind = kind.withColumn("_shown", cleanup.collapse_strings(F.col("_shown")))
        shown = kind if shown is None else shown.unionByName(kind)
    return shown.select(
        *TEXT, "src", scoring.format_scoring(s, family).alias("s"), s["counts"].alias("counts"), scoring.required(s, family).alias("req"), scoring.section_size(s).alias("size"),
        F.col("_shown").alias("full"), (F.size(s["uncertain"]) > 0).alias("est"), "_rows",
    )


def build_index(sources: dict[str, DataFrame], found_years: DataFrame, found_dates: DataFrame, variants: DataFrame | None = None, family: Family = TRUMPETS) -> Index:
    """One index of the sources (name -> table of RECORD, best first).

    A curated row is counted by its text and shows `full`; the others show their text, tidied. found_years (src, page,
    year) are years harvested for pages, found_dates (ord, sort, born, died, alt) lives of composers, variants (variant,
    canonical) other spellings of names. Rows without players of the family, or that name no composer,
    are left out; of equal works that of the best source stays and takes over a year that the library had for a copy.
    Harvested years outside a composer's life go. Works without a year are placed between their neighbours. The
    statistics name the latest stamp of a harvested row as the date of the data.
    """
    unknown = set(sources) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    rows = tallies.union_sources({name: _typed(sources[name]) for name in SOURCES if name in sources})
    rows = rows.withColumn("arr", F.coalesce("arr", F.lit(False))).withColumn("ord", F.col("rank").cast("long") * (1 << 40) + F.col("ord"))
    rows = rows.withColumn("title", F.when(F.col("src") == "encyclopaedia", text.without_disambiguator(F.col("title"))).otherwise(F.col("title")))
    rows = tables.settled(rows.withColumns(dict(zip(TEXT, _digest("src", "text", "full"), strict=True))))
    whole = tallies.complete_rows(rows, F.lit(1), "composer", "text").where((F.col("src") != "library") | F.col("composer_id").isNotNull())
    told = tables.settled(_told(whole.groupBy(*TEXT, "src", "text", "full").agg(F.count(F.lit(1)).alias("_rows")), list(sources), family))
    # Rows carry 128 bits of their text until they are done, so that no step moves or writes what was read in it.
    counted = join_split(whole.drop("text", "full", "stamp"), told.select(*TEXT, "_rows"), list(TEXT), "_rows", whole=WHOLE)

    renamed = counted.withColumnsRenamed({"composer": "name", "composer_id": "id", "composer_sort": "sort"})
    linked, composers = identity.resolve_composers(renamed, variants)
    linked = linked.drop("id", "name", "sort", "aliases", "dates").withColumnsRenamed({"composer_id": "c", "title": "t", "year": "y", "genre": "g"})
    works = tallies.attach_years(linked, found_years, ["src", "page"]).drop("page")
    works = tables.settled(works.withColumn("id", F.concat_ws(":", "src", F.col("ord") % (1 << 40))))
    kept = dedupe.merge_works(works, [name for name in SOURCES if name in sources])

    own = years.lifespan(F.col("dates"))
    lives = identity.composer_dates(composers, found_dates).withColumn("_own", own)
    has_own = F.col("dates").isNotNull()
    lives = lives.withColumn("born", F.when(has_own, F.col("_own.born")).otherwise(F.col("born"))).withColumn("died", F.when(has_own, F.col("_own.died")).otherwise(F.col("died"))).drop("_own")
    shown = years.show_dates(F.col("born"), F.col("died"))
    lives = lives.withColumn("dates_added", ~has_own & shown.isNotNull()).withColumn("dates", F.coalesce("dates", shown)).withColumn("living", F.col("dates_added") & F.startswith(shown, F.lit("b. ")))
    lives = tables.settled(lives)

    dated = kept.join(lives.select(F.col("composer_id").alias("c"), "born", "died"), "c")
    checked = F.when(F.col("harvested"), years.plausible_year(F.col("y"), F.col("born"), F.col("died"))).otherwise(F.col("y"))
    dated = dated.withColumn("rejected", F.col("harvested") & checked.isNull()).withColumn("y", checked).drop("born", "died")
    dated = chronology.assign_sort_years(dated)

    genre = F.coalesce(F.col("g"), F.when(F.col("arr"), F.lit("Arrangement")).when(F.col("src") == "encyclopaedia", keys.genre_from_title(F.col("t"), F.lit("Orchestral"))), F.lit("Other"))
    done = join_split(dated, told.drop("src"), list(TEXT), "_rows", whole=WHOLE)
    done = done.select("id", "ord", "c", "t", "cat", "y", "sy", genre.alias("g"), "s", "counts", "req", "size", "full", "note", "arr", "est", "src", "url", "harvested", "rejected")
    done = tables.settled(done)
    people = tallies.composers_with_works(lives, tallies.works_per_composer(done))
    stamped = rows.agg(tallies.data_date(F.col("stamp")).alias("data_date"))
    statistics = tallies.build_statistics(done, people).join(stamped, F.lit(True))  # one row each
    return Index(done.drop("harvested", "rejected"), people, tables.settled(statistics))


def read_articles(roots: DataFrame, edges: DataFrame, pages: DataFrame, family: Family = TRUMPETS, most: int = harvest.MOST_ARTICLES) -> DataFrame:
    """The articles of the composers' categories with what they are scored for: roots (composer, category), edges (parent,
    child, kind, ord), pages (title, wikitext) -> (composer, title, subcat, genre, text, how, scoring, outcome).

    Redirects are followed one page on. outcome says whether a scoring was found and names the family.
    """
    listed = harvest.walk(roots, edges, most)
    listed = tables.settled(listed)
    read = tables.settled(harvest.follow_redirects(pages).join(listed.select("title").distinct(), "title", "left_semi"))
    found = markup.read_passages(read, "wikitext", family)
    words = F.when(F.col("how").isin("prose", "prose-unbounded"), markup.first_sentence(F.col("text"))).otherwise(F.col("text"))
    parsed = scoring.parse_scoring(found.select("title", "how", words.alias("text")), "text", family)
    genre = keys.genre_from_category(F.col("subcat"), F.col("parent"))
    outcome = F.when(F.col("text").isNull(), "no scoring").when(F.col("scoring.total") == 0, "no family").otherwise("kept")
    return listed.join(parsed, "title", "left").select("composer", "title", "subcat", genre.alias("genre"), "text", "how", "scoring", outcome.alias("outcome"))


def answer(index: Index, rules: list[tuple[str, str, int]], by: str = "composer", number: int = 0, arrangements: bool = False, inferred: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A search: the batch `number` of the works that fulfil all rules in the order `by`, their counts, and how many need each member."""
    works = search.toggles(index.works, arrangements, inferred)
    matches = search.with_composers(works.where(search.match_instruments(rules, F.col("counts"), F.col("req"))), index.composers)
    return search.page(matches, search.ordering(by), number), tallies.match_counts(matches), search.instrument_tally(matches, TRUMPETS.keys)
