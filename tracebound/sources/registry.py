"""S-08, S-09, S-11, S-13: media types, raw file digests, warnings, image inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.lets import non_blank


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_type(path: Column) -> Column:
    """S-08: media type from the extension; NULL when it is not supported."""
    table = F.create_map(*[F.lit(x) for pair in fixed.MEDIA_TYPES.items() for x in pair])
    return F.try_element_at(table, extension(path))


def classify_media(files: DataFrame, path: str = "path") -> DataFrame:
    """S-08 as rows: unsupported files keep a NULL type and carry an issue code."""
    return files.withColumn("media_type", media_type(F.col(path))).withColumn(
        "code", F.when(F.col("media_type").isNull(), F.lit("unsupported-format"))
    )


def register_contents(df: DataFrame, name: Column, content: Column) -> DataFrame:
    """S-09 over a column that already holds the contents."""
    return df.select(
        name.alias("name"),
        F.octet_length(content).cast("bigint").alias("size"),
        F.sha2(content, 256).alias("sha256"),
    )


def register_sources(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """S-09: name, size and digest of every raw source file below ``folder``.

    For document files; one file is one row and has to fit in a task.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    )
    return register_contents(files, F.regexp_extract("path", r"([^/]+)$", 1), F.col("content"))


def extraction_warnings(units: DataFrame) -> DataFrame:
    """S-11: one row per extraction problem.

    Reads ``source_id, type, asset_path, rows, fallback``.
    """
    no_rows = F.col("rows").isNull() | (F.size("rows") == 0)
    codes = F.array_compact(
        F.array(
            F.when(
                (F.col("type") == "image") & non_blank(F.col("asset_path")).isNull(),
                "missing-target",
            ),
            F.when((F.col("type") == "chart") & no_rows, "no-cached-data"),
            F.when(F.coalesce(F.col("fallback"), F.lit(False)), "fallback-used"),
        )
    )
    return units.select("source_id", F.explode(codes).alias("code"))


def asset_inventory(units: DataFrame) -> DataFrame:
    """S-13: image units with path, alternative text and caption."""
    return units.filter(F.col("type") == "image").select(
        "source_id",
        "asset_path",
        F.coalesce("alt", F.lit("")).alias("alt"),
        F.coalesce("caption", F.lit("")).alias("caption"),
    )
