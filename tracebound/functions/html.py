"""Column functions over raw HTML text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.lets import extract, matches, substitute
from tracebound.functions.text import collapse_ws, decode_entities, split_lines


def drop_scripts(html: Column) -> Column:
    return substitute(html, fixed.HTML_SCRIPT_STYLE, "")


def strip_tags(html: Column) -> Column:
    """Tags become spaces, entities are decoded, whitespace collapses."""
    return collapse_ws(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")))


def visible_text(html: Column) -> Column:
    """Readable lines of a page."""
    broken = substitute(drop_scripts(html), fixed.HTML_BREAK_TAG, "\n")
    plain = decode_entities(F.regexp_replace(broken, "<[^>]+>", ""))
    return F.array_join(
        F.filter(F.transform(split_lines(plain), collapse_ws), lambda x: x != ""), "\n"
    )


def attribute_pattern(name: str, value: str = "[^\"']+") -> str:
    return rf"(?i)\b{name}\s*=\s*[\"']({value})[\"']"


def extract_attribute(html: Column, name: str) -> Column:
    """All non-empty quoted values of an attribute, in order."""
    return matches(html, attribute_pattern(name), 1)


def first_attribute(html: Column, name: str) -> Column:
    """First quoted value of an attribute, or the empty string."""
    return extract(F.coalesce(html, F.lit("")), attribute_pattern(name, "[^\"']*"), 1)


def classify_resource(url: Column) -> Column:
    return (
        F.when(url.rlike(r"(?i)^(?:https?:)?//"), "remote")
        .when(url.startswith("data:"), "data")
        .when(url.startswith("#"), "fragment")
        .otherwise("local")
    )


def table_rows(html: Column) -> Column:
    """ARRAY<ARRAY<STRING>> of the cells of every table row."""
    return F.transform(
        matches(html, fixed.HTML_ROW),
        lambda row: F.transform(matches(row, fixed.HTML_CELL), strip_tags),
    )
