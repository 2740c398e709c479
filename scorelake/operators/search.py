"""Searching the merged index by required instruments."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import fold, natural_key
from ..sources.tables import discard, settled, shared_dir
from .joins import join_split

UNDATED = 9999
BATCH = 150


def players(counts: Column, req: Column, key: str | Column) -> Column:
    """Printed parts of a member, else one if it is only doubled, else none."""
    printed = F.coalesce(F.element_at(counts, F.lit(key) if isinstance(key, str) else key), F.lit(0))
    return F.when(printed > 0, printed).when(F.array_contains(req, key), 1).otherwise(0)


def match_instruments(rules: list[tuple[str, str, int]], counts: Column, req: Column) -> Column:
    """All of the rules (member, "any", "eq" or "ge", number) hold; eq 0 means none."""
    tests = {"any": lambda n, _: n > 0, "eq": lambda n, k: n == k, "ge": lambda n, k: n >= k}
    return reduce(lambda a, b: a & b, (tests[op](players(counts, req, key), k) for key, op, k in rules), F.lit(True))


def search_rules(searches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(search_id, key, lo, hi): the rules in tokens "cornet,trumpet:eq2,flugelhorn:ge1"; unknown members and rules are passed over."""
    token = F.explode(F.split("tokens", ","))
    rules = searches.select("search_id", token.alias("token")).select(
        "search_id", F.regexp_extract("token", r"^\s*([A-Za-z]+)(?::(?:eq[0-4]|ge[2-5]))?\s*$", 1).alias("key"), F.regexp_extract("token", r":(eq|ge)(\d)", 1).alias("op"), F.regexp_extract("token", r":(eq|ge)(\d)", 2).alias("k")
    )
    lo = F.when(F.col("op") == "", 1).otherwise(F.col("k").cast("int"))
    hi = F.when(F.col("op") == "eq", F.col("k").cast("int")).otherwise(1_000_000)
    return rules.where(F.col("key").isin(*keys)).select("search_id", "key", lo.alias("lo"), hi.alias("hi")).distinct()


#: Different sets of rules that are broadcast at once, in one array a part.
SEARCHES = 5_000


def _kinds(works: DataFrame, searches: DataFrame, keys: tuple[str, ...]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(search_id, set): the searches by their set of rules; (ord, numbers) of the works; and (numbers, found, _n): for each row of
    numbers the sets that it fulfils, and how many works have it.

    Searches of the same rules are one, and so are works that need the same players. What the members, tests and numbers of
    rules allow bounds both, so that the trying doesn't grow with the searches, nor with the works.
    """
    rule = F.struct("key", "lo", "hi")
    rules = search_rules(searches, keys).groupBy("search_id").agg(F.array_sort(F.collect_set(rule)).alias("rules"))
    none = F.array().cast("array<struct<key: string, lo: int, hi: int>>")
    asked = searches.select("search_id").distinct().join(rules, "search_id", "left").withColumn("rules", F.coalesce("rules", none)).withColumn("set", F.to_json("rules"))
    asked = settled(asked)
    sets = settled(asked.groupBy("set").agg(F.first("rules").alias("rules")))
    parts = max(-(-sets.count() // SEARCHES), 1)
    tried = sets.groupBy(F.pmod(F.xxhash64("set"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("set", "rules")).alias("sets"))
    numbers = F.array(*[players(F.col("counts"), F.col("req"), k) for k in keys])
    needed = settled(works.select("ord", F.coalesce(numbers, F.array(*[F.lit(0)] * len(keys))).alias("numbers")))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (k, i)])
    holds = lambda r: F.get(F.col("numbers"), F.element_at(place, r["key"])).between(r["lo"], r["hi"])
    alike = needed.groupBy("numbers").agg(F.count(F.lit(1)).alias("_n"))
    each = alike.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    found = each.join(F.broadcast(tried), "part").select("numbers", "_n", F.filter("sets", lambda s: F.forall(s["rules"], holds)).alias("found")).where(F.size("found") > 0)
    found = found.groupBy("numbers", "_n").agg(F.flatten(F.collect_list(F.transform("found", lambda s: s["set"]))).alias("found"))
    return asked.select("search_id", "set"), needed, settled(found)


def run_saved_searches(works: DataFrame, searches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(search_id, ord) for all saved searches in one pass over the works (ord, counts, req). A search without a rule finds every work."""
    asked, needed, found = _kinds(works, searches, keys)
    # Most works share a few rows of numbers: they stay where they lie.
    hits = join_split(needed, found, ["numbers"], "_n").select("ord", F.explode("found").alias("set"))
    return hits.join(asked, "set").select("search_id", "ord")


def count_saved_searches(works: DataFrame, searches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(search_id, works): how many works each saved search finds, none included; no work is listed for it."""
    asked, _, found = _kinds(works, searches, keys)
    sums = found.select("_n", F.explode("found").alias("set")).groupBy("set").agg(F.sum("_n").alias("works"))
    return asked.join(sums, "set", "left").select("search_id", F.coalesce("works", F.lit(0)).cast("long").alias("works"))


def toggles(works: DataFrame, arrangements: bool = False, inferred: bool = True) -> DataFrame:
    """Without arrangements, and without works whose counts are inferred, unless asked for."""
    works = works if arrangements else works.where(~F.col("arr"))
    return works if inferred else works.where(~F.col("est"))


def with_composers(works: DataFrame, composers: DataFrame) -> DataFrame:
    """Works with the composer's name and sort name; "Unknown" for an id that isn't known."""
    named = composers.select(F.col("composer_id").alias("c"), F.col("name").alias("composer"), F.col("sort").alias("composer_sort"))
    return works.join(named, "c", "left").withColumn("composer", F.coalesce("composer", F.lit("Unknown"))).withColumn("composer_sort", F.coalesce("composer_sort", F.lit("zz")))


def ordering(by: str) -> list[Column]:
    """Sort keys across composers: composer, title, date or size; ord is always the last."""
    composer, title, date = fold(F.col("composer_sort")), natural_key(F.col("t")), F.coalesce("sy", F.lit(UNDATED))
    keys = {"composer": [composer, title], "title": [title, composer], "date": [date, composer, title], "size": [F.desc("size"), composer]}
    return [*keys[by], F.col("ord")]


def ordering_within(by: str, title: Column | None = None) -> list[Column]:
    """Sort keys within one composer: genre, title, date or size. `title` is the title's natural key where that is known."""
    title, date = natural_key(F.col("t")) if title is None else title, F.coalesce("sy", F.lit(UNDATED))
    keys = {"genre": [F.col("g"), date, title], "title": [title], "date": [date, title], "size": [F.desc("size"), title]}
    return [*keys[by], F.col("ord")]


def places_within(works: DataFrame, orders: tuple[str, ...]) -> DataFrame:
    """(by, ord, place): the place of each work among its composer's in each of the orders. The works move once for all of them."""
    keyed = settled(works.withColumn("_title", natural_key(F.col("t"))))
    own = [F.struct(F.lit(by).alias("by"), F.row_number().over(W.partitionBy("c").orderBy(*ordering_within(by, F.col("_title")))).alias("place")) for by in orders]
    return keyed.select("ord", F.array(*own).alias("_x")).select("ord", F.explode("_x").alias("_x")).select("_x.by", "ord", "_x.place")


def page(matches: DataFrame, by: list[Column], number: int, size: int = BATCH) -> DataFrame:
    """Batch `number` (from 0) of the ordered matches: a top-k of what comes before it and itself, then its offset."""
    return matches.orderBy(*by).offset(number * size).limit(size)


def _ranged(rows: DataFrame, by: list[Column], ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows, written, dealt to ranges of the order (`_range`), and for each range how many rows it has and how many lie before it (_range, _n, _before)."""
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    dealt = settled(dealt.withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    return dealt, sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_range")) - F.col("_n"))  # one row a range


def placed(rows: DataFrame, *by: str | Column, out: str = "place") -> DataFrame:
    """`rows` with their place, from 1, in the order of `by`, equal values in any order among themselves.

    Ranges of the values are dealt to tasks; a range's places begin behind the rows of the ranges before it.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in by]
    dealt, before = _ranged(rows, order)
    own = dealt.withColumn("_own", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return own.join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_own")).drop("_range", "_n", "_before", "_own")


#: Ranges of an index at most, whatever it holds: the keys that bound them are sampled by the driver, and each is a task.
MOST_RANGES = 256


class OrderIndex:
    """Rows in an order, kept with their places in ranges of about `rows_each` rows, or of more where those would be over MOST_RANGES.

    A batch reads the one or two ranges that hold it, and of those what its places need: the rows of a range lie in order.
    """

    def __init__(self, matches: DataFrame, by: list[Column], rows_each: int = 100_000):
        own = settled(matches)
        dealt, before = _ranged(own, by, min(max(1, -(-own.count() // rows_each)), MOST_RANGES))
        self.path = f"{shared_dir(matches.sparkSession)}/order-{uuid.uuid4().hex}"
        self.ranges, self.columns = settled(before), matches.columns
        place = (F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*by))).cast("long")
        kept = dealt.join(F.broadcast(self.ranges.select("_range", "_before")), "_range").withColumn("place", place).select(*self.columns, "place", "_range")
        kept.write.partitionBy("_range").parquet(self.path)
        self.rows = matches.sparkSession.read.schema(kept.schema).parquet(self.path)
        discard(own, dealt)

    def batch(self, number: int, size: int = BATCH) -> DataFrame:
        """Batch `number` (from 0), with its rows' places (`place`, from 1)."""
        first, last = number * size, (number + 1) * size
        held = self.ranges.where((F.col("_before") < last) & (F.col("_before") + F.col("_n") > first))
        wanted = [r["_range"] for r in held.select("_range").collect()]  # a batch lies in few ranges
        return self.rows.where(F.col("_range").isin(wanted) & (F.col("place") > first) & (F.col("place") <= last)).select(*self.columns, "place")


def facets(matches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """All numbers of a result set at once: (facet, value, works).

    "all" and its works; "composers" and how many there are; each "member" with the works that need it, each "genre" and
    "size" with its works. One pass over the matches: each becomes a few small rows, which are added up before they move.
    """
    cell = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.cast("string").alias("value"))
    members = F.transform(F.filter(F.array_distinct("req"), lambda k: k.isin(*keys)), lambda k: cell("member", k))
    cells = F.concat(F.array(cell("all", F.lit("")), cell("composers", F.col("c")), cell("genre", F.col("g")), cell("size", F.col("size"))), F.coalesce(members, F.array().cast("array<struct<facet:string,value:string>>")))
    added = matches.select(F.explode(cells).alias("x")).groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("works"))
    composer = F.col("facet") == "composers"
    return added.groupBy("facet", F.when(~composer, F.col("value")).alias("value")).agg(F.sum(F.when(composer, F.col("value").isNotNull().cast("long")).otherwise(F.col("works"))).alias("works"))


def chunks(works: DataFrame, heading: str, by: list[Column], item: Column, size: int = BATCH) -> DataFrame:
    """(heading, chunk, works, items): the works under each heading in order, `item` of each, in numbered arrays of at most `size`.

    Places are found by ranges of the whole order, so that a heading of any size is many rows and many tasks.
    """
    rows = settled(placed(works, F.col(heading), *by, out="_place"))
    first = rows.groupBy(heading).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = join_split(rows.withColumn("_h", F.xxhash64(heading, F.col(heading).isNull())), settled(first.withColumn("_h", F.xxhash64(heading, F.col(heading).isNull())).drop(heading)), ["_h"], "_n")
    own = own.withColumn("chunk", F.floor((F.col("_place") - F.col("_first")) / size))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", item.alias("item")))), lambda x: x["item"])
    return own.groupBy(heading, "chunk").agg(F.count(F.lit(1)).alias("works"), listed.alias("items"))


def instrument_tally(works: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return works.select(F.explode("req").alias("key")).where(F.col("key").isin(*keys)).groupBy("key").agg(F.count(F.lit(1)).alias("works"))


def alternates(candidates: DataFrame, page_col: str, best: list[Column], most: int = 4) -> DataFrame:
    """The best candidate of each page, and up to `most` others whose raw text differs, in the same order.

    candidates (page, raw, ...). The window's rank limits each task's rows before they are dealt out.
    """
    own = W.partitionBy(page_col).orderBy(*best)
    ranked = candidates.withColumn("_n", F.row_number().over(own)).withColumn("_best", F.first("raw").over(own))
    others = ranked.where((F.col("_n") > 1) & (F.col("raw") != F.col("_best")))
    others = others.withColumn("alternate", F.row_number().over(W.partitionBy(page_col).orderBy("_n"))).where(F.col("alternate") <= most)
    return ranked.where("_n = 1").withColumn("alternate", F.lit(0)).unionByName(others).drop("_n", "_best")
