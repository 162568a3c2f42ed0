"""Frames derived from the driver tables. Each one covers its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebound.functions.text import text_lines
from tracebound.plans.ordered import positions
from tracebound.sources.units import read_html_units, read_plain_units, with_source_ids

TEST_TERMS = ("of", "with", "von", "que", "dans")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def money(column: str):
    return F.col(column).cast("decimal(15,2)").cast("string")


def text_units(spark, folder) -> DataFrame:
    """B1: lines of documents as paragraph units."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    return with_source_ids(read_plain_units(docs, keep=["doc_id", "lang", "source"]))


def typed_units(spark, folder) -> DataFrame:
    """B1 units given types, paths, rows and captions by their position and text."""
    kind = (
        F.when(F.col("ord") % 4 == 0, "image").when(F.col("ord") % 4 == 1, "chart")
        .when(F.col("ord") % 4 == 2, "table").otherwise("paragraph")
    )
    line = F.col("text")
    has_rows = (F.col("type") == "table") | (
        (F.col("type") == "chart") & F.contains(line, F.lit("."))
    )
    no_text = F.col("type").isin("image", "table", "chart")
    rows = F.array(F.array(F.lit("lang"), F.lit("line")), F.array("lang", line))
    return (
        text_units(spark, folder).withColumn("type", kind)
        .select(
            "doc_id", "lang", "source", "source_id", "ord", "type",
            F.lit(None).cast("int").alias("level"),
            F.when(~no_text, line).alias("text"),
            F.lit(None).cast("array<string>").alias("items"),
            F.when(has_rows, rows).alias("rows"),
            F.when(
                (F.col("type") == "image") & F.contains(line, F.lit(",")),
                F.concat(F.lit("assets/"), F.col("doc_id"), F.lit("-"), F.col("ord"),
                         F.lit(".png")),
            ).alias("asset_path"),
            F.when(F.col("type") == "image", line).alias("alt"),
            F.when(no_text, F.col("lang")).alias("caption"),
            (F.length(line) < 15).alias("fallback"),
        )
    )


def markdown_docs(spark, folder) -> DataFrame:
    """Documents rewritten as Markdown: the line number decides the kind of line."""
    docs = table(spark, folder, "documents")

    def rewrite(x, i):
        return (
            F.when(i % 8 == 0, F.concat(F.lit("## "), x))
            .when(i % 8 == 3, F.concat(F.lit("- "), x))
            .when(i % 8 == 4, F.concat(F.lit("1. "), x))
            .when(i % 8 == 5, F.concat(F.lit("| "), F.col("lang"), F.lit(" | "), x, F.lit(" |")))
            .when(i % 8 == 6, F.lit("| --- | --- |"))
            .when(i % 8 == 7, F.lit(""))
            .otherwise(x)
        )

    text = F.array_join(F.transform(text_lines(F.col("text")), rewrite), "\n")
    return docs.select("doc_id", text.alias("text"))


def html_table_pages(spark, folder) -> DataFrame:
    """Pages whose navigation list is rewritten as a table."""
    html = F.col("html")
    for old, new in (("<ul>", "<table><tr>"), ("</ul>", "</tr></table>"), ("<li>", "<td>"),
                     ("</li>", "</td>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    return table(spark, folder, "pages").select("page_id", html.alias("html"))


def page_units(spark, folder) -> DataFrame:
    """B2."""
    return read_html_units(table(spark, folder, "pages").select("page_id", "html"))


def order_lines(spark, folder) -> DataFrame:
    """Lines of each order, numbered; a hot order is spread over (line, part) buckets."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_linestatus",
    )
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_linestatus"]
    bucket = F.col("l_linenumber").cast("bigint") * 1_000_000_000 + F.floor(
        F.col("l_partkey") / 1000)
    return positions(
        lines, ["l_orderkey"], [F.col(c) for c in order], bucket, "rn", spread_hot=True)


def _line_id():
    return F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("rn").cast("string"))


def numeric_sources(spark, folder) -> DataFrame:
    """B3 sources: ``source_id, text``."""
    return order_lines(spark, folder).select(
        _line_id().alias("source_id"),
        F.concat(
            F.when(F.col("l_linestatus") == "F", "about ").otherwise(""), F.lit("qty "),
            money("l_quantity"), F.lit(" price "), money("l_extendedprice"),
        ).alias("text"),
    )


#: Lines of an order in one claim: a claim stays short however long an order is.
CLAIM_LINES, CHUNK_STEP = 8, 10**12


def claim_chunk() -> Column:
    return F.floor((F.col("rn") - 1) / CLAIM_LINES)


def numeric_claims(spark, folder) -> DataFrame:
    """B3 claims: ``claim_id, text`` with the quantities of all lines, eight to a claim."""
    lines = order_lines(spark, folder).groupBy(
        (F.col("l_orderkey") + claim_chunk() * CHUNK_STEP).alias("claim_id")
    ).agg(F.array_sort(F.collect_list(F.struct("rn", money("l_quantity").alias("q")))).alias("rows"))
    return lines.select(
        "claim_id",
        F.concat(
            F.when(F.col("claim_id") % 3 != 0, "about ").otherwise(""),
            F.array_join("rows.q", " and "),
        ).alias("text"),
    )


def cited_lines() -> Column:
    """B3 citations of a claim: all its lines, but not the second where its id divides by 5."""
    lines = F.sequence(F.lit(1), F.size(F.split("text", " and ")))
    cited = F.filter(lines, lambda n: (F.col("claim_id") % 5 != 0) | (n != 2))
    order = F.col("claim_id") % CHUNK_STEP
    first = F.floor(F.col("claim_id") / CHUNK_STEP) * CLAIM_LINES
    return F.transform(
        cited, lambda n: F.concat_ws("-", order.cast("string"), (first + n).cast("string")))


def numeric_refs(claims: DataFrame) -> DataFrame:
    # the id within the generator: a filter on it would make another plan of ``claims``, read twice
    return claims.select(F.inline(F.transform(cited_lines(), lambda source: F.struct(
        F.col("claim_id").alias("claim_id"), source.alias("source_id")))))


def lexical_refs(units: DataFrame) -> DataFrame:
    """B4 citations: the unit itself; the document before it where doc_id divides by 10."""
    cited = F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    key = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string"))
    return units.select(
        key.alias("claim_id"),
        F.concat_ws("-", cited.cast("string"), F.col("ord").cast("string")).alias("source_id"),
    )


def keyed_units(units: DataFrame, name: str) -> DataFrame:
    return units.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("ord").cast("string")).alias(name),
        "text",
    )


def part_cells(spark, folder) -> DataFrame:
    """B6: one dataset per brand, one row per part, four columns."""
    part = table(spark, folder, "part")
    ranked = positions(
        part, ["p_brand"], [F.col("p_partkey")], F.floor(F.col("p_partkey") / 4096), "row_idx",
        start=0,
    )
    cells = F.array(
        F.col("p_partkey").cast("string"), F.col("p_name"),
        F.concat(F.col("p_size").cast("string"), F.lit(" cm")), money("p_retailprice"),
    )
    return ranked.select(
        F.col("p_brand").alias("dataset_id"), "row_idx", F.posexplode(cells).alias("col_idx", "cell")
    ).withColumn("col_idx", F.col("col_idx").cast("bigint"))


def order_series(spark, folder) -> DataFrame:
    """B7: total price per month (x) and priority (series); one dataset per status."""
    orders = table(spark, folder, "orders")
    return (
        orders.groupBy(
            F.col("o_orderstatus").alias("dataset_id"),
            F.date_format("o_orderdate", "yyyy-MM").alias("x"),
            F.col("o_orderpriority").alias("series"),
        )
        .agg(F.sum(F.col("o_totalprice").cast("decimal(15,2)")).cast("double").alias("value"))
        .withColumn(
            "x_idx",
            (F.substring("x", 1, 4).cast("bigint") * 12 + F.substring("x", 6, 2).cast("bigint")),
        )
    )


def patch_log(spark, folder) -> DataFrame:
    """B8: edits of each user and day, numbered in time."""
    events = table(spark, folder, "events").select(
        "user_id", "event_id", "ts", "event_type",
        F.to_date("ts").alias("day"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    ranked = positions(
        events, ["user_id", "day"], [F.col("ts"), F.col("event_id")],
        F.date_trunc("minute", "ts"), "seq",
    )
    op = (
        F.when(F.col("event_type") == "view", "undo")
        .when(F.col("event_type") == "signup", "redo").otherwise("patch")
    )
    return ranked.select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.col("day").cast("string"))
        .alias("project_id"),
        "seq", "event_type", "k", (F.col("k") % 8).alias("node"), op.alias("op"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("changed_at"),
        (F.floor((F.col("seq") - 1) / 2) - F.when(F.col("k") % 7 == 0, 1).otherwise(0))
        .cast("bigint").alias("base_revision"),
    )


def version_log(spark, folder) -> DataFrame:
    """B9: one version per order of a customer."""
    orders = table(spark, folder, "orders")
    return orders.select(
        F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("variant_id"),
        F.col("o_orderdate").alias("created_at"),
        F.sha2(money("o_totalprice"), 256).alias("sha256"),
        F.when(F.col("o_orderstatus") == "F", "published")
        .when(F.col("o_orderstatus") == "O", "publishing").otherwise("failed").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, "public").otherwise("local").alias("target"),
    )


def snapshots(spark, folder) -> tuple[DataFrame, DataFrame]:
    """B10."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    kept = docs.filter(F.col("doc_id") % 11 != 0).withColumn(
        "text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    )
    added = docs.filter(F.col("doc_id") % 13 == 0).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return docs, kept.unionByName(added)


def segment_nodes(spark, folder) -> DataFrame:
    """B13: a forest: per market segment the nations, their customers and their orders.

    Nations of a region share one ``ord``; customers and orders have positions of 11 digits,
    and customers repeat them.
    """
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    nation = table(spark, folder, "nation")
    doc = F.col("c_mktsegment").alias("doc")
    own = customer.select("c_mktsegment", "c_custkey", "c_nationkey")

    def node(prefix: str, column: str):
        return F.concat(F.lit(prefix), F.col(column).cast("string"))

    roots = (
        own.select(doc, "c_nationkey").distinct()
        .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
        .select("doc", node("n", "c_nationkey").alias("node_id"),
                F.lit(None).cast("string").alias("parent_id"),
                F.col("n_regionkey").cast("bigint").alias("ord")))
    customers = own.select(
        doc, node("c", "c_custkey").alias("node_id"), node("n", "c_nationkey").alias("parent_id"),
        (F.col("c_custkey") % 3 + 12_345_678_900).cast("bigint").alias("ord"))
    leaves = orders.join(own, F.col("o_custkey") == F.col("c_custkey")).select(
        doc, node("o", "o_orderkey").alias("node_id"), node("c", "c_custkey").alias("parent_id"),
        (F.col("o_orderkey") + 12_345_678_900).cast("bigint").alias("ord"))
    return roots.unionByName(customers).unionByName(leaves)


def assessments(spark, folder) -> DataFrame:
    """B16: judgments of documents, from their labels and texts."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    labels = table(spark, folder, "labels")
    level = lambda c: F.when(c == 0, "low").when(c == 1, "medium").when(c == 2, "high")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("source_id"),
        F.concat(F.lit("assets/"), F.col("doc_id")).alias("asset_path"),
        # whole texts; short values by condition, so that both sides of the length rules occur
        F.when(F.col("doc_id") % 7 == 0, "brief").otherwise(F.col("text")).alias("description"),
        F.when(F.col("doc_id") % 5 == 0, " because ").otherwise(F.col("text")).alias("rationale"),
        F.when(F.col("lang") == "en", "evidence").when(F.col("lang") == "de", "context")
        .when(F.col("lang") == "fr", "decorative").otherwise("unknown").alias("content_role"),
        level(F.coalesce(F.col("toxic"), F.lit(0)) * 2).alias("information_loss"),
        level(F.coalesce(F.col("quality"), F.lit(0)) * 2).alias("value"),
        F.when(F.col("n_chars") % 3 == 0, "omit").when(F.col("n_chars") % 3 == 1, "redraw")
        .otherwise("use-original").alias("treatment"),
        F.when(F.col("n_chars") % 2 == 0, F.col("source")).otherwise("").alias("source_binding"),
    )
