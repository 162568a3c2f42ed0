"""The common output of every check: ``severity, code, subject_id, detail``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issue_rows(df: DataFrame, code: str | Column, subject: str | Column,
               detail: str | Column | None = None, severity: str = "error") -> DataFrame:
    def column(value):
        return F.col(value) if isinstance(value, str) else value

    return df.select(
        F.lit(severity).alias("severity"),
        (F.lit(code) if isinstance(code, str) else code).alias("code"),
        column(subject).cast("string").alias("subject_id"),
        (F.lit(None) if detail is None else column(detail)).cast("string").alias("detail"),
    )


def collect_issues(*audits: DataFrame) -> DataFrame:
    """U-02: all issues of several audits."""
    return reduce(DataFrame.unionByName, audits)


def audit_verdict(subjects: DataFrame | None, issues: DataFrame) -> DataFrame:
    """A-23: error and warning counts per subject; valid when there is no error.

    ``subjects`` (``subject_id``) adds the subjects without any issue.
    """
    counts = issues.groupBy("subject_id").agg(
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )
    if subjects is not None:
        counts = subjects.select("subject_id").distinct().join(counts, "subject_id", "left")
    return counts.select(
        "subject_id",
        F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"),
        F.coalesce("warnings", F.lit(0)).cast("bigint").alias("warnings"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("valid"),
    )


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))
