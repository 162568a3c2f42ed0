"""S-01..S-07: text, Markdown and HTML to units.

Every reader works inside the row that holds the text: lines and blocks are arrays
until the final ``posexplode``. No shuffle and no window is needed, and the work for
one document never leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.html import drop_scripts, first_attribute, strip_tags, table_rows
from tracebound.functions.html import visible_text
from tracebound.functions.lets import found, let, matches
from tracebound.functions.text import js_trim, split_lines, stable_id, text_lines, unit_text

UNIT_FIELDS = (
    "type STRING, level INT, text STRING, items ARRAY<STRING>, ordered BOOLEAN, "
    "rows ARRAY<ARRAY<STRING>>, asset_path STRING, alt STRING"
)
NO_ROWS = "array<array<string>>"


def _unit(type_: Column, level=None, text=None, items=None, ordered=None, rows=None,
          asset_path=None, alt=None) -> Column:
    def or_null(value, kind):
        return (F.lit(None) if value is None else value).cast(kind)

    return F.struct(
        type_.alias("type"),
        or_null(level, "int").alias("level"),
        or_null(text, "string").alias("text"),
        or_null(items, "array<string>").alias("items"),
        or_null(ordered, "boolean").alias("ordered"),
        or_null(rows, NO_ROWS).alias("rows"),
        or_null(asset_path, "string").alias("asset_path"),
        or_null(alt, "string").alias("alt"),
    )


def _explode(df: DataFrame, units: Column, keep: list[str],
             count: str | None = None) -> DataFrame:
    """One row per unit; ``count`` names a column for the number of units of the document."""
    if count is None:
        return df.select(*keep, F.posexplode(units).alias("ord", "u")).select(
            *keep, F.col("ord").cast("bigint").alias("ord"), "u.*"
        )
    counted = let(
        units,
        lambda us: F.transform(us, lambda u: F.struct(u.alias("u"), F.size(us).alias("n"))),
    )
    return df.select(*keep, F.posexplode(counted).alias("ord", "c")).select(
        *keep, F.col("ord").cast("bigint").alias("ord"), "c.u.*",
        F.col("c.n").cast("bigint").alias(count),
    )


def with_source_ids(units: DataFrame, name: str = "doc_id") -> DataFrame:
    """P-04: identity of a unit from document name, position, type and text."""
    text = unit_text(
        "id", F.col("text"), F.col("items"), F.col("rows"), F.lit(None), F.col("alt"),
        F.col("asset_path"),
    )
    return units.withColumn(
        "source_id", stable_id("src", F.col(name), F.col("ord"), F.col("type"), text)
    )


def read_plain_units(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
                     count: str | None = None) -> DataFrame:
    """S-01: one paragraph unit per non-blank line."""
    keep = keep or ["doc_id"]
    units = F.transform(text_lines(F.col(text)), lambda x: _unit(F.lit("paragraph"), text=x))
    return _explode(docs, units, keep, count)


# --- Markdown -------------------------------------------------------------

_HEADING = rf"^(#{{1,6}})[{fixed.WS}]+(.+)$"
_LIST = r"^([-*+] |\d+[.)] )(.+)$"
_TABLE = r"^\|.*\|$"
_SEPARATOR = rf"^\|?[{fixed.WS}]*:?-{{3,}}"


def _line_kind(line: Column) -> Column:
    return (
        F.when(line.rlike(_HEADING), "heading")
        .when(line.rlike(_LIST), "list")
        .when(line.rlike(_TABLE), "table")
        .when(line == "", "blank")
        .otherwise("paragraph")
    )


def line_islands(lines: Column) -> Column:
    """W-02: ARRAY<STRUCT<kind, lines>>; runs of paragraph or table lines form one block."""

    def blocks(tagged: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(tagged)),
            lambda i: (i == 1)
            | ~F.element_at(tagged, i)["kind"].isin("paragraph", "table")
            | (F.element_at(tagged, i)["kind"] != F.try_element_at(tagged, i - 1)["kind"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.element_at(tagged, at)["kind"].alias("kind"),
                    F.slice(
                        tagged, at,
                        F.coalesce(F.try_element_at(s, k + 2), F.size(tagged) + 1) - at,
                    )["line"].alias("lines"),
                ),
            ),
        )

    tagged = F.transform(
        lines, lambda x: F.struct(_line_kind(x).alias("kind"), x.alias("line"))
    )
    return let(
        tagged,
        lambda t: F.filter(
            F.when(F.size(t) > 0, blocks(t)), lambda b: b["kind"] != "blank"
        ),
    )


def pipe_rows(lines: Column) -> Column:
    """S-06: rows of one pipe table, separator rows removed, cells trimmed."""
    kept = F.filter(
        lines,
        lambda x: ~F.regexp_replace(
            F.regexp_replace(x, rf"\|[{fixed.WS}]*$", ""), r"^\|", ""
        ).rlike(_SEPARATOR),
    )
    return F.transform(
        kept,
        lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"\|", -1), js_trim),
    )


def _markdown_unit(block: Column) -> Column:
    first = F.element_at(block["lines"], 1)
    item = F.regexp_extract(first, _LIST, 2)
    return (
        F.when(
            block["kind"] == "heading",
            _unit(F.lit("heading"), level=F.length(F.regexp_extract(first, _HEADING, 1)),
                  text=F.regexp_extract(first, _HEADING, 2)),
        )
        .when(
            block["kind"] == "list",
            _unit(F.lit("list"), text=item, items=F.array(item), ordered=first.rlike(r"^\d")),
        )
        .when(block["kind"] == "table", _unit(F.lit("table"), rows=pipe_rows(block["lines"])))
        .otherwise(_unit(F.lit("paragraph"), text=F.array_join(block["lines"], " ")))
    )


def _has_content(unit: Column) -> Column:
    return (unit["type"] != "table") | (F.coalesce(F.size(unit["rows"]), F.lit(0)) > 0)


def read_markdown_units(docs: DataFrame, text: str = "text",
                        keep: list[str] | None = None) -> DataFrame:
    """S-02: headings, list items, pipe tables and paragraphs."""
    keep = keep or ["doc_id"]
    lines = F.transform(split_lines(F.coalesce(F.col(text), F.lit(""))), js_trim)
    units = F.filter(F.transform(line_islands(lines), _markdown_unit), _has_content)
    return _explode(docs, units, keep)


def read_pipe_tables(docs: DataFrame, text: str = "text",
                     keep: list[str] | None = None) -> DataFrame:
    """S-06: one row per pipe table, with its rows."""
    keep = keep or ["doc_id"]
    lines = F.transform(split_lines(F.coalesce(F.col(text), F.lit(""))), js_trim)
    tables = F.filter(
        F.transform(
            F.filter(line_islands(lines), lambda b: b["kind"] == "table"),
            lambda b: pipe_rows(b["lines"]),
        ),
        lambda rows: F.size(rows) > 0,
    )
    return docs.select(*keep, F.posexplode(tables).alias("table_no", "rows")).withColumn(
        "table_no", F.col("table_no").cast("bigint")
    )


# --- HTML -----------------------------------------------------------------


def _html_unit(block: Column) -> Column:
    level = F.regexp_extract(block, r"(?i)^<h([1-6])", 1)
    return (
        F.when(
            level != "",
            _unit(F.lit("heading"), level=level.try_cast("int"), text=strip_tags(block)),
        )
        .when(found(block, r"(?i)^<p\b"), _unit(F.lit("paragraph"), text=strip_tags(block)))
        .when(
            found(block, r"(?i)^<img\b"),
            _unit(F.lit("image"), asset_path=first_attribute(block, "src"),
                  alt=first_attribute(block, "alt")),
        )
        .otherwise(_unit(F.lit("table"), rows=table_rows(block)))
    )


def read_html_units(pages: DataFrame, html: str = "html",
                    keep: list[str] | None = None) -> DataFrame:
    """S-03: headings, paragraphs, tables and images in document order.

    A page without any of them is read line by line from its visible text.
    """
    keep = keep or ["page_id"]
    source = F.col(html)

    def or_lines(blocks: Column) -> Column:
        lines = F.transform(
            text_lines(visible_text(source)), lambda x: _unit(F.lit("paragraph"), text=x)
        )
        return F.when(F.size(blocks) > 0, blocks).otherwise(lines)

    blocks = F.filter(
        F.transform(matches(drop_scripts(source), fixed.HTML_BLOCK), _html_unit), _has_content
    )
    return _explode(pages, let(blocks, or_lines), keep)


def read_html_tables(pages: DataFrame, html: str = "html",
                     keep: list[str] | None = None) -> DataFrame:
    """S-07: one row per HTML table, with its rows."""
    keep = keep or ["page_id"]
    tables = F.filter(
        F.transform(
            matches(drop_scripts(F.col(html)), r"(?i)<table\b[\s\S]*?</table>"), table_rows
        ),
        lambda rows: F.size(rows) > 0,
    )
    return pages.select(*keep, F.posexplode(tables).alias("table_no", "rows")).withColumn(
        "table_no", F.col("table_no").cast("bigint")
    )


def explode_rows(tables: DataFrame, keep: list[str]) -> DataFrame:
    """``rows`` to long cells: one row per (table, row, column)."""
    return (
        tables.select(*keep, F.posexplode("rows").alias("row_idx", "cells"))
        .select(*keep, F.col("row_idx").cast("bigint").alias("row_idx"),
                F.posexplode("cells").alias("col_idx", "cell"))
        .withColumn("col_idx", F.col("col_idx").cast("bigint"))
    )


