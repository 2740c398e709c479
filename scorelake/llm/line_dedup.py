"""Line dedup by a suffix array over sequences of line ids. DataFrame operations only.

Every line has an id; a document is a sequence of ids. Prefix doubling sorts the places of all documents by the
2**k lines that begin there: round k joins a place with the one 2**(k-1) lines on and ranks the pairs of their ranks.
Places of one rank are an interval of the suffix array whose longest common prefix is at least 2**k lines. A place
whose rank is its own has no repeat of that length and takes no further part, so rounds shrink and end with the
longest repeated run. From these ranks each place's longest match with an earlier place is put together, the highest
level first: such a run is known by its earliest place and its length, and the places that share it are told apart by
the rank of the 2**k lines behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import word_count, written

#: A run of fewer words is not deleted.
MIN_WORDS = 5
LAST = (1 << 63) - 1


def place(docs: DataFrame) -> tuple[Column, Column]:
    """What names and orders a document: its id, null behind all others, and a hash of its text."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.xxhash64(docs["text"])


def lines(docs: DataFrame) -> DataFrame:
    """(d, th, i, h1, h2, words): the lines of each document, with a 128-bit id."""
    d, th = place(docs)
    rows = docs.select(d.alias("d"), th.alias("th"), F.posexplode(F.split(docs["text"], "\n", -1)).alias("i", "line"))
    return rows.select("d", "th", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), word_count(F.col("line")).cast("int").alias("words"))


def ranked(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that stand in more than one place, in order, with their rank and earliest place."""
    here = F.struct("d", "th", "i")
    groups = rows.groupBy(*key).agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first < last").drop("last")
    groups = groups.repartitionByRange(*key).sortWithinPartitions(*key)
    return written(groups.withColumn("rank", F.monotonically_increasing_id()), "line-ranks")


def placed(rows: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Places that share their rank: (d, th, i, rank, words, first), first: the rank's earliest place."""
    return written(rows.join(groups, key).select("d", "th", "i", "rank", "words", "first"), "line-places")


def suffix_intervals(docs: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ...: the places whose 2**k lines stand elsewhere too, ranked; until there are none."""
    key, rows, levels = ["h1", "h2"], lines(docs), []
    while True:
        groups = ranked(rows, key)
        # Repeated equal rows are one document.
        found = placed(rows if levels else rows.dropDuplicates(["d", "th", "i"]), groups, key)
        if not found.count():
            return levels
        step = 1 << len(levels)
        levels.append(found)
        key = ["left", "right"]
        ahead = found.select("d", "th", (F.col("i") - step).alias("i"), F.col("rank").alias("right"), F.col("words").alias("words2"))
        rows = found.drop("first").join(ahead, ["d", "th", "i"]).select("d", "th", "i", F.col("rank").alias("left"), "right", (F.col("words") + F.col("words2")).alias("words"))


def longest_matches(levels: list[DataFrame]) -> DataFrame | None:
    """(d, th, i, m, words, first): the m lines from a place on are its longest run that begins earlier too, first at `first`.

    Level k adds 2**k lines to the runs found so far where the longer run, too, begins earlier. Of the places that share
    a run, those with equal ranks behind it share the longer one. Its earliest place is the run's own earliest place if
    that has the same rank, else the least of them: no other place of the longer run can have a run of another length
    by now, as it would have an earlier place.
    """
    runs = None
    for k in range(len(levels) - 1, -1, -1):
        level, step = levels[k], 1 << k
        new = level.where(F.struct("d", "th", "i") > F.col("first")).select("d", "th", "i", F.lit(step).alias("m"), F.col("words").cast("long").alias("words"), "first")
        if runs is None:
            runs = written(new, "line-runs")
            continue
        behind = level.select("d", "th", F.col("i").alias("at"), F.col("rank").alias("r"), F.col("words").alias("more"))
        own = runs.withColumn("at", F.col("i") + F.col("m")).join(behind, ["d", "th", "at"], "left").drop("at")
        own = written(own, "line-runs-behind")
        firsts = own.where("r is not null").select("first", "m").distinct()
        firsts = firsts.select("first", "m", F.col("first.d").alias("d"), F.col("first.th").alias("th"), (F.col("first.i") + F.col("m")).alias("at"))
        theirs = firsts.join(behind.drop("more"), ["d", "th", "at"]).select("first", "m", "r", F.lit(True).alias("same"))
        groups = own.where("r is not null").groupBy("first", "m", "r").agg(F.min(F.struct("d", "th", "i")).alias("least"))
        groups = groups.join(theirs, ["first", "m", "r"], "left").select("first", "m", "r", F.when(F.col("same"), F.col("first")).otherwise(F.col("least")).alias("next"))
        joined = own.join(groups, ["first", "m", "r"], "left")
        longer = F.coalesce(F.struct("d", "th", "i") > F.col("next"), F.lit(False))
        grown = joined.select(
            "d", "th", "i", F.when(longer, F.col("m") + step).otherwise(F.col("m")).alias("m"),
            F.when(longer, F.col("words") + F.col("more")).otherwise(F.col("words")).alias("words"), F.when(longer, F.col("next")).otherwise(F.col("first")).alias("first"),
        )
        runs = written(grown.unionByName(new.join(runs, ["d", "th", "i"], "left_anti")), "line-runs")
    return runs


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS, out: str = "line_dedup") -> DataFrame:
    """The rows of `docs` with `text` less its repeated lines, and a column `out`: struct of n_lines, n_removed, longest_run.

    A line goes if it lies in a run of lines, of at least `min_words` words in all, that also begins at an earlier
    place (smaller doc_id, then smaller line number; the same document counts). longest_run is the most lines of such a
    run found in the document, 0 if none. Runs are judged on the input.
    Null texts stay null with 0 lines; an empty text is one empty line. Repeated equal rows are one document and don't
    count against each other; rows of one doc_id with other texts are in the order of a hash. Null ids come last. An
    empty table gives no rows. Other columns pass through; a column named `out` is replaced.
    """
    runs = longest_matches(suffix_intervals(docs))
    d, th = place(docs)
    other = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*[docs[c] for c in other]).alias("row"), d.alias("d"), th.alias("th"))
    spans = "array<struct<i: int, end: int>>"
    if runs is None:
        rows = rows.withColumn("gone", F.lit(None).cast(spans))
    else:
        # Later places' runs never end earlier, so that runs of one end are covered by the first of them.
        gone = runs.where(F.col("words") >= min_words).groupBy("d", "th", (F.col("i") + F.col("m")).alias("end")).agg(F.min("i").alias("i"))
        gone = gone.groupBy("d", "th").agg(F.array_sort(F.collect_list(F.struct("i", "end"))).cast(spans).alias("gone"))
        rows = rows.join(gone, ["d", "th"], "left")
    rows = rows.withColumn("every", F.split(F.col("row.text"), "\n", -1))
    end = lambda k: F.when(k == 0, 0).otherwise(F.get("gone", k - 1)["end"])
    gaps = F.transform("gone", lambda x, k: F.slice("every", end(k) + 1, F.greatest(x["i"] - end(k), F.lit(0))))
    tail = F.slice("every", F.element_at("gone", -1)["end"] + 1, F.size("every"))
    kept_lines = F.concat(F.flatten(gaps), tail)
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept_lines, "\n"))
    n_lines = F.when(F.col("row.text").isNull(), F.lit(0)).otherwise(F.size("every")).cast("long")
    removed = F.aggregate(F.transform("gone", lambda x, k: x["end"] - F.greatest(x["i"], end(k))), F.lit(0), lambda a, x: a + x)
    n_removed = F.coalesce(removed, F.lit(0)).cast("long")
    longest = F.coalesce(F.array_max(F.transform("gone", lambda x: x["end"] - x["i"])), F.lit(0)).cast("long")
    about = F.struct(n_lines.alias("n_lines"), n_removed.alias("n_removed"), longest.alias("longest_run"))
    return rows.select(*[kept.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in other], about.alias(out))
