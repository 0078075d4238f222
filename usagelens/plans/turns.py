"""Walking parent links to the line that opened a turn, for all lines at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from usagelens.session import cut_lineage



def _hop(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Follow `p` once through `table`; a parent that is not in the file ends the walk."""
    nxt = table.select("file", F.col("uuid").alias("p"), F.col("p").alias("_p"), F.col("done").alias("_done"), F.col("least").alias("_least"))
    return rows.join(nxt, ["file", "p"], "left").select(
        "file", "uuid", F.coalesce("_p", "p").alias("p"), F.coalesce("_done", F.lit(True)).alias("done"), F.least("least", "_least").alias("least")
    )


def resolve_turns(lines: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(file, uuid, turn_id) for lines with file, uuid, parent_uuid, is_human, line_no.

    Every line points at its parent; a round replaces each pointer by its target's own
    pointer, so k rounds walk 2**k hops. A round reads and writes only the lines that are still walking; what is
    finished is written once, and leaves the join, which keeps a busy turn from gathering all its lines on one key.

    A walk of any length ends by itself, unless it runs into a cycle: as long as any other line walks, each round finishes some,
    so when a round finishes none only cycles are left. Their lines take the smallest id of their cycle, which every line carries
    along (`least`: of as many lines as it has walked). With `max_hops` a walk ends after so many hops wherever it is.
    """
    last = Window.partitionBy("file", "uuid").orderBy(F.desc("line_no"))
    nodes = (
        lines.where(F.coalesce("uuid", F.lit("")) != "")
        .withColumn("_rn", F.row_number().over(last))
        .where(F.col("_rn") == 1)
    )
    stays = F.col("is_human") | (F.coalesce("parent_uuid", F.lit("")) == "")
    start = nodes.select(
        "file", "uuid", F.when(stays, F.col("uuid")).otherwise(F.col("parent_uuid")).alias("p"), stays.alias("done"), F.col("uuid").alias("least")
    )
    found = cut_lineage(start)
    finished, walking = found.where("done"), found.where(~F.col("done"))
    hops, left = 1, walking.count()
    levels = [(1, found)]
    while left and (max_hops is None or hops * 2 <= max_hops):
        found = cut_lineage(_hop(walking, finished.unionByName(walking)))
        finished, walking = finished.unionByName(found.where("done")), found.where(~F.col("done"))
        hops, before, left = hops * 2, left, walking.count()
        if max_hops is not None:
            levels.append((hops, finished.unionByName(walking)))
        elif left == before and hops >= left:
            on_cycle = walking.select("file", F.col("uuid").alias("p"), F.col("least").alias("_least"))
            walking = walking.join(on_cycle, ["file", "p"]).withColumn("p", F.col("_least")).drop("_least")
            break
    rows = finished.unionByName(walking)
    if max_hops is not None and left:
        # What is still walking takes the rest of max_hops in powers of two.
        rest = max_hops - hops
        for size, level in reversed(levels):
            if size <= rest:
                rows = rows.where("done").unionByName(_hop(rows.where(~F.col("done")), level))
                rest -= size
    return rows.select("file", "uuid", F.col("p").alias("turn_id"))
