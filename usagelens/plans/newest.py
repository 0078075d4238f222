"""Threshold search of the newest groups: only the newest days are read to find them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from usagelens.operators import common as C

#: Days read by the first try, and the factor by which each further try reaches back.
FIRST_DAYS, FACTOR, TRIES = 2, 16, 3


def newest_groups(rows: DataFrame, group: str, *, as_of, limit: int, certain: Column | None = None) -> DataFrame | None:
    """The `group` values that can be among the `limit` newest by last timestamp, or None where the last
    `FIRST_DAYS * FACTOR ** (TRIES - 1)` days hold fewer than that many.

    `certain` is an aggregate condition that, once true of part of a group's rows, is true of all of them;
    groups without it may still drop out. When `limit` certain groups were seen since a day, no group that
    was last seen before the least recent of them can be among the newest, so older partitions stay closed.
    The result holds those `limit` groups, ties with the last one, and uncertain groups between them.
    """
    sure = F.lit(True) if certain is None else certain
    days = FIRST_DAYS
    for _ in range(TRIES):
        day = C.moment(as_of).date() - timedelta(days=days)
        seen = rows.where(F.expr(f"date >= DATE '{day}' AND {group} IS NOT NULL")).groupBy(group).agg(F.max("timestamp").alias("last"), sure.alias("sure"))
        top = seen.where("sure").orderBy(F.desc("last")).limit(limit)
        n, least = top.agg(F.count(F.lit(1)), F.min("last").cast("string")).first()
        if n == limit and least is not None:
            return seen.where(F.expr(f"last >= TIMESTAMP_NTZ '{least}'")).select(group)
        days *= FACTOR
    return None


def only_newest(rows: DataFrame, group: str, *, as_of, limit: int | None, certain: Column | None = None) -> DataFrame:
    """All rows, old ones included, of the groups that can be among the `limit` newest. Short histories
    come back whole: the cut to `limit` is the caller's."""
    if limit is None or as_of is None:
        return rows
    groups = newest_groups(rows, group, as_of=as_of, limit=limit, certain=certain)
    return rows if groups is None else rows.join(C.maybe_broadcast(groups), group, "left_semi")
