"""Joins whose key may be hot, and broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALT = "__salt"


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: list[str],
                how: str = "inner", counts: DataFrame | None = None,
                hot_rows: int = 1_000_000) -> DataFrame:
    """Join ``many`` (skewed on ``keys``) with ``few`` (few rows per key).

    A key with more than ``hot_rows`` rows is spread over ``ceil(n / hot_rows)`` salts by a hash of
    the ``spread`` columns, which gives the same answer when a task is run again; the
    matching rows of ``few`` are repeated once per salt. All other rows carry salt 0. However
    many keys are hot, each is split. ``counts(keys, n)`` gives the frequencies where the
    caller has them already; otherwise they come from a pre-aggregated count. There is at most
    one hot key per ``hot_rows`` rows, and Spark broadcasts their list only while it is small.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join {how!r}")
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = counts.filter(F.col("n") > hot_rows).select(
        *keys, F.ceil(F.col("n") / hot_rows).cast("int").alias("__salts"))
    salts = F.coalesce("__salts", F.lit(1))
    spread_hash = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), salts).cast("int")
    left = many.join(hot, keys, "left").withColumn(SALT, spread_hash)
    right = few.join(hot, keys, "left").withColumn(
        SALT, F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.drop("__salts").join(right.drop("__salts"), [*keys, SALT], how).drop(SALT)


def fits(df: DataFrame, max_rows: int, size: Column | None = None,
         max_size: int | None = None) -> bool:
    """True when ``df`` has at most ``max_rows`` rows, and ``size`` sums to ``max_size``.

    Stops after ``max_rows`` rows; only two numbers reach the driver.
    """
    measured = df.select((F.lit(0) if size is None else size).alias("size")).limit(max_rows + 1)
    rows, total = measured.agg(F.count(F.lit(1)), F.sum("size")).first()
    return rows <= max_rows and (max_size is None or (total or 0) <= max_size)
