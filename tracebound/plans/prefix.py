"""State at the start of every chunk of a long log, by a parallel prefix scan.

A chunk turns the state before it, one integer, into the state after it. Such a map is kept as
rows: an explicit row per state that differs, and ``start + shift`` for every other one. Two
neighbours compose by a join, so a log of n chunks takes log2(n) rounds whichever key it belongs
to, and no key of a join is shared by more than a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.plans.lineage import cut


def chunk_starts(rows: DataFrame, nodes: DataFrame, key: list[str], initial: int,
                 least: int | None = None) -> DataFrame:
    """``key, chunk, start`` for every chunk of ``nodes``; the first one of a key has ``initial``.

    ``nodes(key, chunk, shift)`` are the chunks, numbered from 0 with any gaps;
    ``rows(key, chunk, start, end)`` their explicit rows. No state is below ``least``.
    """
    top = nodes.agg(F.max("chunk")).first()[0] or 0
    levels = [(rows, nodes)]
    parent = F.floor(F.col("chunk") / 2).cast("bigint").alias("chunk")
    is_left = F.col("chunk") % 2 == 0
    on = [*key, "chunk"]
    while top > 0:
        rows, nodes = levels[-1]

        def side(which):
            return F.coalesce(F.sum(F.when(which, F.col("shift"))), F.lit(0)).alias

        sides = cut(nodes.groupBy(*key, parent).agg(
            F.sum("shift").alias("shift"), side(is_left)("__left"), side(~is_left)("__right")))
        left = rows.filter(is_left).select(*key, parent, "start", F.col("end").alias("mid"))
        right = rows.filter(~is_left).select(*key, parent, F.col("start").alias("mid"), "end")
        both = left.join(right, [*on, "mid"], "left").join(sides, on).select(
            *on, "start", F.coalesce("end", F.col("mid") + F.col("__right")).alias("end"))
        # states that the left chunk only shifts
        beside = right.join(sides, on).withColumn("start", F.col("mid") - F.col("__left")).join(
            left.select(*on, "start"), [*on, "start"], "left_anti").select(*on, "start", "end")
        if least is not None:
            beside = beside.filter(F.col("start") >= least)
        levels.append((cut(both.unionByName(beside)), sides.select(*on, "shift")))
        top //= 2
    starts = levels[-1][1].select(*on, F.lit(initial).cast("bigint").alias("start"))
    for rows, nodes in reversed(levels[:-1]):
        first = starts.select(*key, (F.col("chunk") * 2).alias("chunk"), "start")
        second = (
            first.join(rows, [*on, "start"], "left").join(nodes, on, "left")
            .select(*key, (F.col("chunk") + 1).alias("chunk"),
                    F.coalesce("end", F.col("start") + F.coalesce("shift", F.lit(0))).alias("start"))
        )
        starts = cut(first.unionByName(second).join(nodes.select(*on), on, "left_semi"))
    return starts
