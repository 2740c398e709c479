"""Joins of many rows with one row a key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is hot; so at most so many keys are, which bounds what is broadcast.
HOT_SHARE = 1024
#: Fewer rows are never too many for a task.
FEW = 1000
#: Groups that are broadcast whole at most, where that is asked for.
WHOLE = 50_000


def join_split(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, how: str = "inner", whole: int = 0) -> DataFrame:
    """rows joined with groups, which has one row for each key and, in `size`, the number of `rows` with it; without `size`.

    Rows of hot keys are joined by broadcast where they lie, those of all others by shuffle, so that no task gets all rows
    of one key. `how` is inner or left. `rows` is read twice, `groups` three times. At most `whole` groups are broadcast all
    together, so that no row moves and `rows` is read once.
    """
    total, number = groups.agg(F.coalesce(F.sum(size), F.lit(0)), F.count(F.lit(1))).first()
    if number <= whole:
        return rows.join(F.broadcast(groups.drop(size)), keys, how)
    hot = groups.where((F.col(size) * HOT_SHARE > total) & (F.col(size) > FEW)).drop(size)
    rare = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.drop(size).hint("merge"), keys, how)
    return rare.unionByName(rows.join(F.broadcast(hot), keys))
