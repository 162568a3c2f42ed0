"""N-03, N-04, A-03..A-11, O-01: small tables, measures and series.

Cells are long rows ``dataset_id, row_idx, col_idx, cell``. Choices are made by
pre-aggregated counts and ``min_by`` / ``max_by``; no dataset is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.lets import non_blank
from tracebound.functions.text import (
    comparable_value, js_trim, numeric_tokens, parse_numeric_cell, unit_from_label,
)
from tracebound.plans.ordered import positions


def explode_cells(tables: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """N-03: ``rows`` to body cells and header names; tables of one row are ignored."""
    usable = tables.filter(F.size("rows") > 1)
    columns = usable.select(
        key, F.posexplode(F.element_at("rows", 1)).alias("col_idx", "name")
    ).withColumn("col_idx", F.col("col_idx").cast("bigint"))
    body = usable.select(
        key, F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row_idx", "r")
    ).select(
        key, F.col("row_idx").cast("bigint").alias("row_idx"),
        F.posexplode("r").alias("col_idx", "cell"),
    )
    return body.withColumn("col_idx", F.col("col_idx").cast("bigint")), columns


def recommend_mode(docs: DataFrame, by: str, text: str = "text",
                   threshold: int = fixed.QUANTITATIVE_THRESHOLD) -> DataFrame:
    """A-03: ``numeric_tokens, mode, reason`` per group of documents."""
    counted = docs.groupBy(by).agg(
        F.sum(F.size(numeric_tokens(F.col(text), "analysis")).cast("bigint"))
        .alias("numeric_tokens")
    )
    enough = F.col("numeric_tokens") >= threshold
    return counted.select(
        by, "numeric_tokens",
        F.when(enough, "data-first").otherwise("evidence-first").alias("mode"),
        F.when(enough, "quantitative-evidence").otherwise("narrative-evidence").alias("reason"),
    )


def typed_cells(cells: DataFrame) -> DataFrame:
    """Cells with ``num`` (NULL unless numeric) and ``is_text`` (not blank, not numeric)."""
    return cells.withColumn("num", parse_numeric_cell(F.col("cell"))).withColumn(
        "is_text",
        F.col("num").isNull() & (js_trim(F.coalesce("cell", F.lit(""))) != ""),
    )


def column_choice(typed: DataFrame) -> DataFrame:
    """A-04 and A-05 in one pass: ``dataset_id, measure_col, numeric_cells, rows, label_col,
    usable``; ``usable`` counts the non-negative cells of the measure.

    Cells are reduced to one row per column first; what is gathered per dataset is one
    short entry per column of the table.
    """
    profile = typed.groupBy("dataset_id", "col_idx").agg(
        F.count("num").alias("n"),
        F.count_if(F.col("num.value") >= 0).alias("usable"),
        F.count_if("is_text").alias("texts"),
        # Rows are numbered from 0 without gaps, so the last index gives the count.
        (F.max("row_idx") + 1).alias("rows"),
    )
    per_dataset = profile.groupBy("dataset_id").agg(
        F.max("rows").alias("rows"),
        F.max_by(
            F.struct("col_idx", "n", "usable"),
            F.when(
                (F.col("col_idx") >= 1) & (F.col("n") >= 2),
                F.struct("n", (-F.col("col_idx")).alias("c")),
            ),
        ).alias("m"),
        F.collect_list(F.struct("col_idx", "texts")).alias("columns"),
    )
    label = F.array_max(
        F.transform(
            F.filter(
                "columns",
                lambda c: (c["col_idx"] < F.col("m.col_idx"))
                & (c["texts"] >= F.ceil(F.col("rows") / 2)),
            ),
            lambda c: c["col_idx"],
        )
    )
    return per_dataset.filter(F.col("m").isNotNull() & (F.col("rows") >= 2)).select(
        "dataset_id", F.col("m.col_idx").alias("measure_col"),
        F.col("m.n").alias("numeric_cells"), "rows",
        F.coalesce(label, F.lit(0)).cast("bigint").alias("label_col"),
        F.col("m.usable").alias("usable"),
    )


def select_measure(typed: DataFrame) -> DataFrame:
    """A-04: per dataset the column after the first with most numeric cells.

    At least two numeric cells and two rows; the earliest column wins a tie.
    """
    return column_choice(typed).select("dataset_id", "measure_col", "numeric_cells", "rows")


def select_label(typed: DataFrame) -> DataFrame:
    """A-05: the nearest column left of the measure that is text in half the rows, else 0."""
    return column_choice(typed).select("dataset_id", "measure_col", "label_col")


def table_series(cells: DataFrame) -> DataFrame:
    """A-06: ``dataset_id, row_idx, label, value, unit, display`` of chartable tables.

    A numeric label is replaced by the first text cell of its row, else by the 1-based
    row number. Negative values are dropped; fewer than two rows left means no series.
    """
    typed = typed_cells(cells)
    chosen = column_choice(typed).filter(F.col("usable") >= 2)
    is_label = F.col("col_idx") == F.col("label_col")
    rows = (
        typed.join(chosen.select("dataset_id", "measure_col", "label_col"), "dataset_id")
        .groupBy("dataset_id", "row_idx")
        .agg(
            F.max(F.when(F.col("col_idx") == F.col("measure_col"), F.col("num"))).alias("m"),
            F.max(F.when(is_label, F.col("cell"))).alias("pref"),
            F.max(F.when(is_label, F.col("num").isNotNull())).alias("pref_numeric"),
            F.min_by("cell", F.when(F.col("is_text"), F.col("col_idx"))).alias("fallback"),
        )
        .filter(F.col("m").isNotNull() & (F.col("m.value") >= 0))
    )
    number = (F.col("row_idx") + 1).cast("string")
    return rows.select(
        "dataset_id", "row_idx",
        F.when(F.col("pref_numeric"), F.coalesce("fallback", number))
        .otherwise(F.coalesce("pref", number)).alias("label"),
        F.col("m.value").alias("value"), F.col("m.unit").alias("unit"),
        F.col("m.raw").alias("display"),
    )


def dominant_unit(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """A-07: most frequent unit of the rows (first seen wins a tie), else from the header.

    ``rows(dataset_id, row_idx, unit)``, ``headers(dataset_id, name)``.
    """
    counted = (
        rows.filter(non_blank(F.col("unit")).isNotNull())
        .groupBy("dataset_id", "unit")
        .agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("first"))
        .groupBy("dataset_id")
        .agg(F.max_by("unit", F.struct("n", (-F.col("first")).alias("f"))).alias("__unit"))
    )
    return headers.join(counted, "dataset_id", "left").select(
        "dataset_id", F.coalesce("__unit", unit_from_label(F.col("name"))).alias("unit")
    )


def comparable_groups(values: DataFrame, top: int = fixed.TOP_ROWS) -> DataFrame:
    """A-08: the largest group of values with the same unit, first ``top`` rows.

    ``values(dataset_id, ord, label, value, unit)``. Repeats of (unit, value) keep their
    first position and the label of the last repeat. Groups of one are dropped; the first
    seen wins a tie.
    """
    unique = (
        values.groupBy("dataset_id", "unit", "value")
        .agg(F.min("ord").alias("ord"), F.max_by("label", "ord").alias("label"))
        .filter(comparable_value(F.col("value"), F.col("unit")))
    )
    groups = (
        unique.groupBy("dataset_id", "unit")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
        .filter(F.col("n") >= 2)
        .groupBy("dataset_id")
        .agg(F.max_by("unit", F.struct("n", (-F.col("first")).alias("f"))).alias("unit"))
    )
    kept = unique.join(groups, ["dataset_id", "unit"], "left_semi")
    return top_rows(kept, ["dataset_id"], "ord", top)


def top_rows(df: DataFrame, keys: list[str], order: str,
             top: int = fixed.TOP_ROWS) -> DataFrame:
    """O-01: the first ``top`` rows per key, numbered in ``position``.

    A filter on ``row_number`` becomes a group limit before the shuffle: every map task
    sends at most ``top`` rows per key, so a hot key is as cheap as any other.
    """
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return (
        df.withColumn("position", number).filter(F.col("position") <= top)
        .withColumn("position", F.col("position").cast("bigint"))
    )


def trend_groups(series: DataFrame) -> DataFrame:
    """A-09: finite points per (dataset, x, series) of the datasets fit for a trend.

    ``series(dataset_id, x_idx, x, series, unit, value)`` holds one row per x and series,
    value NULL where missing. A dataset needs two x values and a value at every x.
    """
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (
        F.abs("value") != float("inf")
    )
    per_x = series.groupBy("dataset_id", "x_idx").agg(F.count_if(finite).alias("points"))
    fit = (
        per_x.groupBy("dataset_id")
        .agg(F.count(F.lit(1)).alias("xs"), F.min("points").alias("fewest"))
        .filter((F.col("xs") >= 2) & (F.col("fewest") > 0))
    )
    return series.filter(finite).join(fit.select("dataset_id"), "dataset_id", "left_semi")


def with_maximum(rows: DataFrame, key: str, **columns: str) -> DataFrame:
    """Join each key's maximum of the given columns, at least 1, under the new names."""
    maxima = rows.groupBy(key).agg(
        *[F.greatest(F.max(c), F.lit(1.0)).alias(n) for n, c in columns.items()]
    )
    return rows.join(maxima, key)


def scale_bars(rows: DataFrame, bucket_width: int = 4096) -> DataFrame:
    """A-10: bar width in percent of the largest value, palette slot and reuse flag.

    ``rows(dataset_id, row_idx, value)``.
    """
    numbered = positions(
        rows, ["dataset_id"], [F.col("row_idx")], F.floor(F.col("row_idx") / bucket_width),
        "__pos", start=0, maxima={"__max": "value"},
    ).withColumn("__max", F.greatest("__max", F.lit(1.0)))
    return (
        numbered.withColumn(
            "width",
            F.greatest(
                F.lit(fixed.MIN_BAR_PERCENT), F.col("value") / F.col("__max") * 100
            ),
        )
        .withColumn("palette_slot", (F.col("__pos") % fixed.PALETTE_SIZE + 1).cast("bigint"))
        .withColumn("reused", F.col("__pos") >= fixed.PALETTE_SIZE)
        .drop("__pos", "__max")
    )


def axis_ticks(rows: DataFrame) -> DataFrame:
    """A-10: axis values at 0, a quarter, half, three quarters and all of the maximum."""
    maxima = rows.groupBy("dataset_id").agg(F.greatest(F.max("value"), F.lit(1.0)).alias("m"))
    ratios = F.array(*[F.lit(r) for r in fixed.AXIS_RATIOS])
    return maxima.select(
        "dataset_id", F.explode(ratios).alias("ratio"), "m"
    ).select("dataset_id", "ratio", (F.col("m") * F.col("ratio")).alias("tick"))


def scale_points(points: DataFrame) -> DataFrame:
    """A-11: x and y in percent of their maxima. ``points(dataset_id, x, y)``."""
    return (
        with_maximum(points, "dataset_id", __mx="x", __my="y")
        .withColumn("left_pct", F.col("x") / F.col("__mx") * 100)
        .withColumn("bottom_pct", F.col("y") / F.col("__my") * 100)
        .drop("__mx", "__my")
    )


def chart_to_table(points: DataFrame) -> DataFrame:
    """N-04: every index against every series; gaps become empty cells.

    ``points(dataset_id, series_idx, idx, category, value STRING)``. A missing category is
    the index plus one. Returns ``dataset_id, idx, category, series_idx, value``.
    """
    categories = points.groupBy("dataset_id", "idx").agg(
        F.min_by(
            "category", F.when(F.col("category").isNotNull(), F.col("series_idx"))
        ).alias("category")
    )
    series = points.select("dataset_id", "series_idx").distinct()
    values = points.filter(F.col("value").isNotNull()).select(
        "dataset_id", "idx", "series_idx", "value"
    )
    return (
        categories.join(series, "dataset_id")
        .join(values, ["dataset_id", "idx", "series_idx"], "left")
        .select(
            "dataset_id", "idx",
            F.coalesce("category", (F.col("idx") + 1).cast("string")).alias("category"),
            "series_idx", F.coalesce("value", F.lit("")).alias("value"),
        )
    )


def unvisualised_datasets(cells: DataFrame, charts: DataFrame) -> DataFrame:
    """Q-06: chartable datasets without a chart. ``charts(dataset_id)``."""
    return (
        table_series(cells).select("dataset_id").distinct()
        .join(charts.select("dataset_id").distinct(), "dataset_id", "left_anti")
    )


