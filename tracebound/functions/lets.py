"""Small helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A plain ``withColumn`` may be inlined into every filter and projection above it, which
    repeats an expensive text expression. A generator is never inlined.
    """
    packed = F.struct(*[value.alias(name) for name, value in columns.items()])
    added = df.select("*", F.explode(F.array(packed)).alias("__c"))
    return added.select(*df.columns, *[F.col(f"__c.{name}").alias(name) for name in columns])


def non_blank(value: Column) -> Column:
    """NULL for the empty string, else the value."""
    return F.when(value != "", value)


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def ascii_words(pattern: str) -> str:
    r"""``\b`` as a boundary of ASCII words.

    Java 17 counts letters such as ``é`` as word characters in ``\b`` but not in ``\w``;
    the patterns here mean ASCII in both.
    """
    # Before a letter at the start of an alternative, and after a letter, half the test will do.
    pattern = re.sub(r"(^(?:\(\?[a-z]+\))?|\|)\\b(?=[A-Za-z])", r"\1(?<!\\w)", pattern)
    pattern = re.sub(r"((?<!\\)[A-Za-z])\\b(?=[\[<]|$)", r"\1(?!\\w)", pattern)
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def found(value: Column, pattern: str) -> Column:
    return value.rlike(ascii_words(pattern))


def extract(value: Column | str, pattern: str, group: int) -> Column:
    return F.regexp_extract(value, ascii_words(pattern), group)


def substitute(value: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(value, ascii_words(pattern), replacement)


def matches(value: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern``; an empty array for NULL input."""
    return F.coalesce(
        F.regexp_extract_all(value, F.lit(ascii_words(pattern)), F.lit(group)), empty_strings()
    )


def one_of(terms: tuple[str, ...] | list[str]) -> str:
    """Alternation of literal terms, in the order given (first alternative wins)."""
    special = set(r".*+?^${}()|[]\/")
    return "|".join("".join("\\" + c if c in special else c for c in t) for t in terms)
