"""Ordered numbering and carrying for keys of any size.

A plain window puts all rows of one key into one task. Here every key is cut into
ordered buckets first. The window runs per (key, bucket); one summary row per bucket
carries the result across. Windows, summaries and the join that brings these back use one and
the same exchange of the rows: they are read once and shuffled once. A key that holds a third of all rows is then spread over
as many tasks as it has buckets, and the second window sees only the summaries.

``bucket`` must not decrease along ``order``: a leading order column, or a coarser
form of it such as ``floor(seq / 10000)`` or ``date_trunc('hour', ts)``.

Where nearly every key is short, buckets hold a row or two and cost more than they save:
``spread_hot`` of ``positions`` then cuts only the keys of crowded hash slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "__bucket"
_GROUP = "__group"
_SPREAD = "__spread"
#: Hash slots in which rows are counted before keys are cut, and the share of a crowded one.
SLOTS, SLOT_ROWS, SLOT_TIMES = 65_536, 100_000, 4


def _grouped(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """Rows dealt out by their (key, bucket), one struct, in which NULL keys are equal."""
    group = F.struct(*[F.col(k) for k in keys], bucket.alias(BUCKET))
    return df.withColumn(_GROUP, group).repartition(_GROUP)


def _summaries(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """One row per (key, bucket) of ``rows``: the key columns, the bucket and the aggregates.

    It is taken from the same exchange as the windows over ``rows``. For that it must ask for the
    same columns, which the digest of all of them does; the optimizer would prune them otherwise.
    """
    digest = F.bit_xor(F.xxhash64(*[F.col(c) for c in rows.columns]))
    return (
        rows.groupBy(_GROUP).agg(*aggregates, digest.alias("__all"))
        .filter(F.col("__all").isNotNull()).drop("__all")
        .withColumns({f"__k{i}": F.col(_GROUP)[k] for i, k in enumerate([*keys, BUCKET])})
    )


def _along(keys: list[str]):
    """Windows over the summaries: of the key, and of its buckets before this one."""
    key = Window.partitionBy(*[f"__k{i}" for i in range(len(keys))])
    before = key.orderBy(f"__k{len(keys)}").rowsBetween(Window.unboundedPreceding, -1)
    return key, before


def _attach(local: DataFrame, summary: DataFrame, columns: list[str]) -> DataFrame:
    return local.join(summary.select(_GROUP, *columns), _GROUP, "left")


def _marked(df: DataFrame, keys: list[str], slot_rows: int) -> DataFrame:
    """Rows with ``__spread``: whether their key lies in a crowded hash slot.

    Only keys are read, and every task sends at most a row per slot. Crowded are slots of more than
    ``slot_rows`` rows and of more than four times the mean, 16,384 at most, so their list may be
    broadcast; a key in any other slot is too small a share of all rows to hold up a task.
    """
    slot = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(SLOTS)).cast("int")
    counts = df.groupBy(slot.alias("__slot")).agg(F.count(F.lit(1)).alias("__rows"))
    mean = F.sum("__rows").over(Window.partitionBy()) / SLOTS
    crowded = counts.withColumn("__least", F.greatest(F.lit(slot_rows), mean * SLOT_TIMES)).filter(
        F.col("__rows") > F.col("__least")).select("__slot", F.lit(True).alias(_SPREAD))
    return (
        df.withColumn("__slot", slot).join(F.broadcast(crowded), "__slot", "left")
        .withColumn(_SPREAD, F.coalesce(_SPREAD, F.lit(False))).drop("__slot")
    )


def _spread_groups(df: DataFrame, keys: list[str], bucket: Column, slot_rows: int) -> DataFrame:
    """Rows as by ``_grouped``, but only keys of crowded slots are cut."""
    return _grouped(_marked(df, keys, slot_rows), keys, F.when(F.col(_SPREAD), bucket))


def _spread_before(local: DataFrame, rows: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """``local`` with ``__before``: ``total`` over the earlier buckets of its key, 0 for whole keys."""
    summary = rows.filter(_SPREAD).groupBy(_GROUP).agg(total.alias("__t")).withColumns(
        {f"__k{i}": F.col(_GROUP)[k] for i, k in enumerate([*keys, BUCKET])}
    ).withColumn("__before", F.sum("__t").over(_along(keys)[1]))
    return (
        _attach(local, summary, ["__before"])
        .withColumn("__before", F.coalesce("__before", F.lit(0))).drop(_SPREAD)
    )


def positions(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
              out: str, start: int = 1, maxima: dict[str, str] | None = None,
              spread_hot: bool = False, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``row_number`` per key; ``maxima`` adds each key's maximum of a column on the way.

    ``spread_hot`` keeps a key whole unless it lies in a hash slot of many rows; without ``maxima``.
    """
    if spread_hot:
        if maxima:
            raise ValueError("maxima need all buckets")
        rows = _spread_groups(df, keys, bucket, slot_rows)
        local = rows.withColumn(out, F.row_number().over(Window.partitionBy(_GROUP).orderBy(*order)))
        return (
            _spread_before(local, rows, keys, F.count(F.lit(1)))
            .withColumn(out, (F.col(out) + F.col("__before") + (start - 1)).cast("bigint"))
            .drop("__before", _GROUP)
        )
    maxima = maxima or {}
    rows = _grouped(df, keys, bucket)
    local = rows.withColumn(out, F.row_number().over(Window.partitionBy(_GROUP).orderBy(*order)))
    key, before = _along(keys)
    summary = _summaries(
        rows, keys, F.count(F.lit(1)).alias("__n"), *[F.max(c).alias(n) for n, c in maxima.items()]
    ).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumns(
        {n: F.max(n).over(key) for n in maxima})
    return (
        _attach(local, summary, ["__before", *maxima])
        .withColumn(out, (F.col(out) + F.col("__before") + (start - 1)).cast("bigint"))
        .drop("__before", _GROUP)
    )


def running_sum(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                value: Column, out: str, spread_hot: bool = False,
                slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Sum of ``value`` over this row and all rows before it, per key; ``spread_hot`` as above."""
    inside = Window.partitionBy(_GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if spread_hot:
        rows = _spread_groups(df.withColumn("__v", value), keys, bucket, slot_rows)
        local = rows.withColumn(out, F.sum("__v").over(inside))
        return (
            _spread_before(local, rows, keys, F.sum("__v"))
            .withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.col("__before"))
            .drop("__before", "__v", _GROUP)
        )
    rows = _grouped(df.withColumn("__v", value), keys, bucket)
    local = rows.withColumn(out, F.sum("__v").over(inside))
    summary = _summaries(rows, keys, F.sum("__v").alias("__s")).withColumn(
        "__before", F.sum("__s").over(_along(keys)[1]))
    return (
        _attach(local, summary, ["__before"])
        .withColumn(out, F.coalesce(F.col(out), F.lit(0)) + F.coalesce("__before", F.lit(0)))
        .drop("__before", "__v", _GROUP)
    )


def carry_last(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
               value: Column, out: str, include_current: bool = True) -> DataFrame:
    """Last non-NULL ``value`` at or before this row (or strictly before), per key."""
    rows = _grouped(df.withColumn("__v", value), keys, bucket)
    inside = (
        Window.partitionBy(_GROUP).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    )
    local = rows.withColumn(out, F.last("__v", ignorenulls=True).over(inside))
    last = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.struct(*order)))
    summary = _summaries(rows, keys, last.alias("__l")).withColumn(
        "__before", F.last("__l", ignorenulls=True).over(_along(keys)[1]))
    return (
        _attach(local, summary, ["__before"])
        .withColumn(out, F.coalesce(F.col(out), F.col("__before")))
        .drop("__before", "__v", _GROUP)
    )
