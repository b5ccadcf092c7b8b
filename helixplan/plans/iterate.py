"""Driver-controlled loops over DataFrames; each round is a table in the shared folder."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from helixplan.plans.runtime import Scratch


#: Open rows of three short values that may be broadcast.
BROADCAST_ROWS = 200_000


def pointer_double(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Follows unique pointers to their roots in a logarithmic number of joins.

    ``links``: ``(id, up)``, ids unique, ``up`` null at a root. Returns ``(id, root, dist)`` of all ids that
    reach a root; those on cycles are dropped. A chain longer than the reach of a round always closes a row
    in the next, so a round without change leaves cycles alone. Rows that have reached their root are written once;
    a round writes the open ones alone and, once they are few (counted), sends them to the others.
    """
    state = scratch.keep(links.select("id", F.coalesce("up", "id").alias("root"), F.col("up").isNotNull().cast("long").alias("dist"), F.col("up").isNull().alias("done")))
    closed, open_ = [state.where("done")], state.where("not done")
    left = open_.count()
    while left:
        every = functools.reduce(DataFrame.unionByName, [*closed, open_])
        goal = every.select(F.col("id").alias("root"), F.col("root").alias("r2"), F.col("dist").alias("d2"), F.col("done").alias("f2"))
        few = left <= BROADCAST_ROWS
        moved = (F.broadcast(open_) if few else open_).join(goal, "root").select("id", F.col("r2").alias("root"), (F.col("dist") + F.col("d2")).alias("dist"), F.col("f2").alias("done"))
        moved = scratch.keep(moved.repartition(1) if few else moved)  # a file, not one for each part of the others
        closed, open_ = [*closed, moved.where("done")], moved.where("not done")
        now = open_.count()
        if now == left:
            break
        left = now
    return functools.reduce(DataFrame.unionByName, closed).drop("done")


def numbered(rows: DataFrame, order: list[Column], scratch: Scratch, name: str = "n") -> DataFrame:
    """Adds a row number from 1 in a total order without bringing all rows to one task.

    Rows are sorted and counted by the tasks that write the ranges, so they are shuffled once: the low 33 bits of
    ``monotonically_increasing_id`` are a row's place in its partition, the others the partition.
    """
    dealt = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__part")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("__size"))
    before = F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))  # a row per partition
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn(name, (F.col("__before") + within).cast("long")).drop("__part", "__id", "__before")
