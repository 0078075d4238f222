"""Starts of anchored windows: the next window opens at the first record at or after
the previous start plus five hours.

That rule is a chain, so no built-in window function computes it. Three facts keep it
parallel:

* A gap of a full window always opens a new one, so records split into islands.
* Two starts are at least a window apart, so a window-wide time cell holds at most one
  start, and a cell can only contain records of its own start or of the cell before.
* Islands and gaps show in per-cell minima and maxima, so finding them needs no sort
  of raw records.

Islands up to `fold_limit` records are folded in place. Larger ones never meet in one
task: each distinct time gets a pointer to its successor start, looked up inside
five-minute slices, and pointer doubling marks the starts reachable from the first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from usagelens.functions.text import micros
from usagelens.operators.common import maybe_broadcast
from usagelens.plans.asof import first_at_or_after
from usagelens.session import cut_lineage

WINDOW_US = 5 * 3_600_000_000
SLICE_US = 300_000_000
FOLD_LIMIT = 10_000_000         # records of an island folded in one task: at most 80 MB of times


def slot(us, width: int) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.call_function("div", us - F.pmod(us, F.lit(width)), F.lit(width))


def _islands(points: DataFrame, keys) -> DataFrame:
    """Per (key, cell): bounds and island number."""
    cells = points.groupBy(*keys, "cell").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("cell")
    opens = F.coalesce(F.col("lo") - F.lag("hi").over(w) >= WINDOW_US, F.lit(True))
    return cells.withColumn("_opens", opens.cast("bigint")).withColumn("island", F.sum("_opens").over(w)).drop("_opens")


def _fold(points: DataFrame, keys) -> DataFrame:
    """Starts of islands small enough for one array of times."""
    cells = points.groupBy(*keys, "cell").agg(F.sort_array(F.collect_set("us")).alias("times"))
    w = Window.partitionBy(*keys).orderBy("cell")
    gap = F.get("times", F.lit(0)) - F.lag(F.element_at("times", -1)).over(w)
    cells = cells.withColumn("_opens", F.coalesce(gap >= WINDOW_US, F.lit(True)).cast("bigint"))
    cells = cells.withColumn("island", F.sum("_opens").over(w))
    # One step per cell, not per record: a cell opens at most one window, at its first
    # time that is a full window after the start before.
    def first_from(times, start):
        late = F.filter(times, lambda t: t >= F.coalesce(start + WINDOW_US, F.get(times, F.lit(0))))
        return F.slice(late, 1, 1)

    starts = F.aggregate(
        "chain",
        F.array().cast("array<bigint>"),
        lambda acc, cell: F.concat(acc, first_from(cell["times"], F.try_element_at(acc, F.lit(-1)))),
    )
    folded = cells.groupBy(*keys, "island").agg(F.sort_array(F.collect_list(F.struct("cell", "times"))).alias("chain"))
    return folded.select(*keys, F.explode(starts).alias("start_us"))


def _chase(points: DataFrame, keys, rounds: int) -> DataFrame:
    """Starts by pointer doubling; `keys` includes the island."""
    keys = list(keys)
    points = points.select(*keys, "us").distinct().withColumn("slice", slot("us", SLICE_US))
    points = cut_lineage(points)
    ahead = points.select(
        *keys,
        F.col("us").alias("t"),
        (F.col("us") + WINDOW_US).alias("us"),
        (F.col("slice") + WINDOW_US // SLICE_US).alias("slice"),
    )
    hit = first_at_or_after(points, ahead, [*keys, "slice"], at="us", value=F.col("us"), alias="_hit")
    # A probe past the last point of its slice takes the first point of the next slice in use.
    slices = points.groupBy(*keys, "slice").agg(F.min("us").alias("lo"))
    targets = ahead.select(*keys, "slice").distinct()
    later = first_at_or_after(slices, targets, keys, at="slice", value=F.col("lo"), alias="_later", strict=True)
    step = (
        hit.join(later, [*keys, "slice"], "left")
        .select(*keys, "t", F.coalesce("_hit", "_later").alias("u"))
        .where(F.col("u").isNotNull())
    )
    seeds = points.groupBy(*keys).agg(F.min("us").alias("t"))
    levels = [cut_lineage(step)]
    for _ in range(rounds - 1):
        g = levels[-1]
        # Only times that the orbit can still visit stay: the seeds and what g reaches.
        alive = g.select(*keys, F.col("u").alias("t")).unionByName(seeds).distinct()
        hop = g.select(*keys, F.col("t").alias("u"), F.col("u").alias("_u2"))
        nxt = g.join(alive, [*keys, "t"], "left_semi").join(hop, [*keys, "u"]).select(*keys, "t", F.col("_u2").alias("u"))
        levels.append(cut_lineage(nxt))
    orbit = seeds
    for g in reversed(levels):
        orbit = orbit.unionByName(orbit.join(g, [*keys, "t"]).select(*keys, F.col("u").alias("t")))
    return orbit.withColumnRenamed("t", "start_us")


# Up to this many windows the start table is sent to every task instead of shuffling records.
BROADCAST_WINDOWS = 200_000


def _starts(usage: DataFrame, keys, fold_limit: int) -> tuple[DataFrame, int]:
    """Starts and an upper bound of their number, from one small size check."""
    points = usage.select(*keys, micros("timestamp").alias("us")).withColumn("cell", slot("us", WINDOW_US))
    islands = _islands(points, keys)
    sizes = islands.groupBy(*keys, "island").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    over = F.col("n") > fold_limit
    span = F.col("hi") - F.col("lo")
    # Starts of an island are a window apart.
    windows = F.call_function("div", span, F.lit(WINDOW_US)) + 1
    check = sizes.agg(
        F.count_if(over).alias("hot"), F.max(F.when(over, span)).alias("span"), F.coalesce(F.sum(windows), F.lit(0)).alias("windows")
    ).first()
    if not check["hot"]:
        return _fold(points, keys), check["windows"]
    rounds = max(1, math.ceil(math.log2(check["span"] // WINDOW_US + 2)))
    over_limit = sizes.where(over).select(*keys, "island")
    hot_cells = cut_lineage(islands.join(over_limit, [*keys, "island"]).select(*keys, "cell", "island"))
    hot_cells = maybe_broadcast(hot_cells)
    cold = _fold(points.join(hot_cells, [*keys, "cell"], "left_anti"), keys)
    hot = _chase(points.join(hot_cells, [*keys, "cell"]), [*keys, "island"], rounds).select(*keys, "start_us")
    return cold.unionByName(hot), check["windows"]


def window_starts(usage: DataFrame, keys=(), fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """One row (keys, start_us) per anchored window."""
    return _starts(usage, list(keys), fold_limit)[0]


def assign_windows(usage: DataFrame, keys=(), fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Usage with the `start_us` of each record's window.

    A cell holds records of at most two windows, its own and the one of the cell before,
    so the join on (keys, cell) gives one row per record."""
    keys = list(keys)
    home = slot("start_us", WINDOW_US)
    covers = F.explode(F.array(F.struct(home.alias("cell"), F.lit(True).alias("own")), F.struct((home + 1).alias("cell"), F.lit(False).alias("own"))))
    starts, bound = _starts(usage, keys, fold_limit)
    cells = (
        starts.select(*keys, "start_us", covers.alias("c"))
        .groupBy(*keys, F.col("c.cell").alias("_cell"))
        .agg(
            F.max(F.when(F.col("c.own"), F.col("start_us"))).alias("_own"),
            F.max(F.when(~F.col("c.own"), F.col("start_us"))).alias("_before"),
        )
    )
    if bound <= BROADCAST_WINDOWS:
        cells = F.broadcast(cells)
    rows = usage.withColumn("_us", micros("timestamp")).withColumn("_cell", slot("_us", WINDOW_US))
    start = F.when(F.col("_us") >= F.col("_own"), F.col("_own")).otherwise(F.col("_before"))
    return rows.join(cells, [*keys, "_cell"]).withColumn("start_us", start).drop("_own", "_before", "_cell", "_us")
