"""Duplicate works across ranked sources: first in order wins, on any of several keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import arrangement_scope, catalogue_key, extra_keys, form_key, work_key
from ..sources.tables import discard, settled
from .joins import WHOLE, join_split


def with_keys(works: DataFrame, source: str) -> DataFrame:
    """Adds register and query (arrays of keys) to works (c, t, cat; also; arr), as the source wants it.

    The score library looks up its extra keys but registers only the plain ones; the others register those too. Rows
    that `arr` marks as arrangements are keyed apart, so that they only meet each other.
    """
    c, t, cat = F.col("c"), F.col("t"), F.col("cat")
    if "arr" in works.columns:
        c = arrangement_scope(c, F.coalesce("arr", F.lit(False)))
    plain = F.array_compact(F.array(work_key(c, t), catalogue_key(c, cat), form_key(c, t)))
    extra = extra_keys(c, t, cat, bare_ok=source != "library")
    registered = plain if source == "library" else F.array_distinct(F.concat(plain, extra["register"]))
    if source == "curated" and "also" in works.columns:
        named = F.coalesce("also", F.array().cast("array<string>"))
        registered = F.concat(registered, F.transform(named, lambda a: work_key(c, a)), F.array_compact(F.transform(named, lambda a: form_key(c, a))))
    return works.withColumn("register", F.array_distinct(registered)).withColumn("query", F.array_distinct(F.concat(plain, extra["query"])))


def _meets(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The ids of `rows` that look up one of `keys`."""
    return rows.select("id", F.explode("query").alias("key")).join(keys, "key", "left_semi").select("id").distinct()


#: Rounds over all rows that are still open, before what is left is parted into components.
ROUNDS = 3
#: Components of at most so many rows are decided in one task each.
COMPONENT = 50_000


def _round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that no earlier open row can drop, and the rows that are open after them."""
    least = open_.select("ord", F.explode("register").alias("key")).groupBy("key").agg(F.min("ord").alias("least"))
    asked = open_.select("id", "ord", F.explode("query").alias("key"))
    waiting = asked.join(least, "key").where("least < ord").select("id").distinct()
    kept = settled(open_.join(waiting, "id", "left_anti"))
    held = kept.select("ord", F.explode("register").alias("key")).groupBy("key").agg(F.min("ord").alias("least"))
    gone = asked.join(held, "key").where("least < ord").select("id").distinct()
    return kept, settled(open_.join(kept, "id", "left_anti").join(gone, "id", "left_anti"))


def components(rows: DataFrame) -> DataFrame:
    """(id, root): rows (id, keys) that share a key, directly or over others, have one root, the least id that reaches them.

    In each round a row takes the least root of those it shares a key with, roots take the least that one of their rows
    saw, and then every row takes the root of its root, so that chains shorten to half or less a round.
    """
    keys = settled(rows.select("id", F.explode("keys").alias("key")).distinct())
    roots = settled(rows.select("id", F.col("id").alias("root")))
    while True:
        by_key = keys.join(roots, "id").groupBy("key").agg(F.min("root").alias("least"))
        seen = keys.join(by_key, "key").groupBy("id").agg(F.min("least").alias("seen"))
        now = settled(roots.join(seen, "id", "left").select("id", "root", F.least("root", F.coalesce("seen", "root")).alias("seen")))
        hooks = settled(now.groupBy("root").agg(F.min("seen").alias("hook"), F.count(F.lit(1)).alias("_n")))
        hooked = join_split(now, hooks, ["root"], "_n").select("id", F.least("seen", "hook").alias("root"))
        hooked = settled(hooked)
        parents = settled(hooked.groupBy("root").agg(F.count(F.lit(1)).alias("_n")).join(hooked.select(F.col("id").alias("root"), F.col("root").alias("up")), "root"))
        new = settled(join_split(hooked, parents, ["root"], "_n").select("id", F.col("up").alias("root")))
        changed = not new.join(roots, ["id", "root"], "left_anti").isEmpty()
        discard(roots, now, hooks, hooked, parents)
        roots = new
        if not changed:
            discard(keys)
            return roots


def _greedy(_, table):
    """The ids of a component that stay, row by row in order; rows of one ord don't drop each other."""
    import pyarrow as pa

    rows = sorted(table.select(["ord", "id", "register", "query"]).to_pylist(), key=lambda r: r["ord"])
    held: set[str] = set()
    kept, at = [], 0
    while at < len(rows):
        end = next((k for k in range(at, len(rows)) if rows[k]["ord"] != rows[at]["ord"]), len(rows))
        stay = [r for r in rows[at:end] if held.isdisjoint(r["query"] or ())]
        for r in stay:
            held.update(r["register"] or ())
        kept += [r["id"] for r in stay]
        at = end
    return pa.table({"id": pa.array(kept, table.schema.field("id").type)})


def first_wins(rows: DataFrame) -> DataFrame:
    """The rows (id, ord, register, query) that survive in order: one is dropped if an earlier survivor registers a key that it looks up.

    A dropped row registers nothing, so this is not a matter of components alone. In a round, a row that no open earlier
    row can drop is a survivor, and those that survivors drop are gone. Only the smallest ord of a key is kept, never
    pairs, so a key that many share costs one row. What a few rounds leave open, long chains of drops, is parted into
    components over shared keys: each of bounded size is decided in order by one task, and only larger ones go on in rounds.
    """
    open_, parts, rounds = settled(rows.select("id", "ord", "register", "query")), [], 0
    while not open_.isEmpty():
        if rounds == ROUNDS:
            roots = components(open_.select("id", F.concat(F.coalesce("register", F.array().cast("array<string>")), F.coalesce("query", F.array().cast("array<string>"))).alias("keys")))
            small = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= COMPONENT)
            own = settled(open_.join(roots.join(small.select("root"), "root"), "id"))
            kind = open_.schema["id"].dataType.simpleString()
            parts.append(settled(own.groupBy("root").applyInArrow(_greedy, f"id {kind}")))
            left = settled(open_.join(own.select("id"), "id", "left_anti"))
            discard(open_, own, roots)
        else:
            kept, left = _round(open_)
            parts.append(kept)
            discard(open_)
        open_, rounds = left, rounds + 1
    if not parts:
        return rows.limit(0)
    out = settled(reduce(lambda a, b: a.unionByName(b), [p.select("id") for p in parts]))
    discard(open_, *parts)
    return rows.join(out, "id", "left_semi")


def dedupe_works(ranked: DataFrame, ranks: list[int]) -> DataFrame:
    """ranked (id, rank, ord, register, query) -> with `kept`. Rows of the first rank always stay; a row of another is
    dropped if a kept row of a smaller rank, or an earlier kept row of its own, registers a key that it looks up."""
    ranked = settled(ranked)  # the keys of a row are made once, not in each step that reads them
    kept = settled(ranked.where(F.col("rank") == ranks[0]))
    for rank in ranks[1:]:
        own = ranked.where(F.col("rank") == rank)
        known = kept.select(F.explode("register").alias("key")).distinct()
        kept = settled(kept.unionByName(first_wins(own.join(_meets(own, known), "id", "left_anti"))))
    return ranked.join(kept.select("id").withColumn("kept", F.lit(True)), "id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def backfill_years(ranked: DataFrame, keys: str = "query") -> DataFrame:
    """Gives kept rows without a year (y null or 0) that of the first dropped row that meets them: (id, y) for those.

    A dropped row hands its year to the kept row that owns the first of its keys that anybody owns; of several years
    for one row the earliest dropped row's counts.
    """
    owners = ranked.where("kept").select("id", "y", "rank", "ord", F.explode("register").alias("key"))
    owners = owners.groupBy("key").agg(F.min_by(F.struct("id", "y"), F.struct("rank", "ord")).alias("owner"))
    dropped = ranked.where("not kept and coalesce(y, 0) <> 0").select("id", "rank", "ord", F.col("y").alias("_y"), F.posexplode(keys).alias("place", "key"))
    found = dropped.join(owners, "key").groupBy("id").agg(F.min_by(F.struct("owner", "rank", "ord", "_y"), "place").alias("m"))
    found = found.where("coalesce(m.owner.y, 0) = 0").select("m.*")
    return found.groupBy(F.col("owner.id").alias("id")).agg(F.min_by("_y", F.struct("rank", "ord")).alias("y"))


#: What the keys of a work are made of.
NAMED = ("src", "rank", "c", "t", "cat", "also", "arr")
CLASS = ["_c1", "_c2"]


def _classed(works: DataFrame) -> DataFrame:
    """Adds 128 bits of what the keys are made of; the number of other titles is among it, so that lists don't run into what follows."""
    said = [x for c in NAMED for x in ((F.size(c), F.col(c)) if c == "also" else (F.col(c).isNull(), F.col(c)))]
    return works.withColumn("_c1", F.xxhash64(*said)).withColumn("_c2", F.xxhash64(F.lit(1), *said))


def merge_works(works: DataFrame, sources: list[str], giver: str = "library") -> DataFrame:
    """The works (ord, NAMED, y, harvested; c not null) that stay, with the years handed to them: as `with_keys`, `dedupe_works` and `backfill_years` say.

    rank is the place of src in `sources`, and ord grows with it. Only dropped works of the source `giver` hand years on,
    which count as harvested. Works of one source that are named alike have the same keys, and each meets the others by its
    title. So they are a class: outside the first source its first work stays or none, and what decides is done once for a
    class, however many works it has. `works` is read three times or more: give it settled.
    """
    works = _classed(works)
    classes = settled(works.groupBy(*CLASS, *NAMED).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("_n")))
    keyed = reduce(lambda a, b: a.unionByName(b), [with_keys(classes.where(F.col("src") == name), name) for name in sources])
    keyed = settled(keyed.select(F.concat_ws(":", *CLASS).alias("id"), *CLASS, "rank", F.col("first").alias("ord"), "register", "query", "_n"))
    kept = settled(dedupe_works(keyed.drop(*CLASS, "_n"), list(range(len(sources)))).where("kept").select(F.col("id"), F.lit(True).alias("_kept")))
    decided = settled(keyed.join(kept, "id", "left").select("id", *CLASS, F.col("ord").alias("first"), F.col("_kept").isNotNull().alias("_kept"), "_n"))
    stays, is_first = (F.col("rank") == 0) | (F.col("_kept") & (F.col("ord") == F.col("first"))), F.col("ord") == F.col("first")

    # A kept class asks with its first work's year, and the earliest dropped work with a year hands that on.
    gives = ~stays & (F.col("src") == giver) & (F.coalesce("y", F.lit(0)) != 0)
    marked = join_split(works.select(*CLASS, "rank", "src", "ord", "y"), decided, CLASS, "_n", whole=WHOLE)
    told = settled(marked.groupBy("id").agg(F.max(F.when(is_first, F.col("y"))).alias("own"), F.min_by("y", F.when(gives, F.col("ord"))).alias("given"), F.min(F.when(gives, F.col("ord"))).alias("giver")))
    known = settled(keyed.select("id", "rank", "ord", "register", "query").join(told, "id").join(kept, "id", "left"))
    owners = known.where("_kept").select("id", "rank", "ord", F.col("own").alias("y"), F.lit(True).alias("kept"), "register", "query")
    givers = known.where("giver is not null").select(F.concat("id", F.lit(":given")).alias("id"), "rank", F.col("giver").alias("ord"), F.col("given").alias("y"), F.lit(False).alias("kept"), "register", "query")
    filled = backfill_years(owners.unionByName(givers)).withColumnRenamed("y", "_y")
    decided = settled(decided.join(filled, "id", "left").select(*CLASS, "first", "_kept", "_y", "_n"))
    own = join_split(works, decided, CLASS, "_n", whole=WHOLE).where(stays)
    handed = F.when(is_first, F.col("_y"))
    return own.withColumn("harvested", F.col("harvested") | handed.isNotNull()).withColumn("y", F.coalesce(handed, "y")).drop(*CLASS, "first", "_kept", "_y")
