"""P-01..P-03, U-01, A-01, A-02, A-22, A-25, F-01, S-10: units, facts, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.html import extract_attribute
from tracebound.functions.lets import computed
from tracebound.functions.text import (
    is_substantive, js_trim, numeric_tokens, qualification_tokens, stable_id, unit_text,
)
from tracebound.operators.snapshot import fingerprint


def normalize_headings(units: DataFrame, name: str = "doc_id",
                       count: str | None = None) -> DataFrame:
    """P-01: paragraphs that read like headings become headings.

    ``count`` names the column with the number of units of the document, as the readers add
    it; nothing is shuffled then. Without it, a document has more than one unit exactly
    when it has a unit 1, and the first unit is matched with that one.
    """
    text = js_trim(F.coalesce("text", F.lit("")))
    paragraph = F.col("type") == "paragraph"
    if count is not None:
        marked = units.withColumn("__more", (F.col("ord") == 0) & (F.col(count) > 1))
    else:
        longer = units.filter(F.col("ord") == 1).select(
            name, F.lit(0).cast("bigint").alias("ord"), F.lit(True).alias("__more")
        )
        marked = units.join(longer, [name, "ord"], "left")
    level = (
        F.when(paragraph & text.rlike(fixed.HEADING_LEVEL_1), 1)
        .when(paragraph & text.rlike(fixed.HEADING_LEVEL_2), 2)
        .when(
            paragraph & F.col("__more") & (F.length(text) <= fixed.TITLE_MAX_CHARS)
            & text.rlike(fixed.TITLE_ENDING),
            0,
        )
    )
    return (
        marked.withColumn("__level", level)
        .withColumn("type", F.when(F.col("__level").isNotNull(), "heading")
                    .otherwise(F.col("type")))
        .withColumn("level", F.coalesce("__level", "level"))
        .drop("__more", "__level")
    )


def _text(dialect: str) -> Column:
    return unit_text(
        dialect, F.col("text"), F.col("items"), F.col("rows"), F.col("caption"), F.col("alt"),
        F.col("asset_path"),
    )


def mark_substantive(units: DataFrame) -> DataFrame:
    """P-03."""
    return units.withColumn("substantive", is_substantive(F.col("type"), _text("id")))


def substantive(units: DataFrame) -> DataFrame:
    """F-01."""
    return units.filter("substantive")


def fact_ledger(units: DataFrame, name: str = "doc_id",
                terms=fixed.QUALIFIERS_AUDIT) -> DataFrame:
    """Ledger of substantive units with their numeric tokens and qualifications."""
    return (
        computed(units.filter("substantive"), raw_text=_text("ledger"))
        .select(
            F.concat(F.lit("fact-"), F.regexp_replace("source_id", "^src-", "")).alias("fact_id"),
            "source_id", F.col(name).cast("string").alias("document"), "ord",
            F.col("type").alias("kind"), "raw_text",
            numeric_tokens(F.col("raw_text"), "ledger").alias("numeric_tokens"),
            qualification_tokens(F.col("raw_text"), terms).alias("qualifications"),
        )
    )


def compile_facts(nodes: DataFrame, metrics: DataFrame, variant: str) -> DataFrame:
    """U-01: claims, metrics and evidence of report nodes, with stable ids.

    ``nodes(node_id, type, original_type, text)``, ``metrics(node_id, idx, value, unit,
    label)``.
    """
    text = js_trim(F.coalesce("text", F.lit("")))
    blank = F.lit(None).cast("string")

    def fact(kind, *parts):
        return stable_id("fact", F.lit(variant), F.lit(kind), *parts).alias("fact_id")

    claims = nodes.filter(F.col("type").isin("paragraph", "text", "list") & (text != "")).select(
        fact("claim", F.col("node_id")), F.lit("claim").alias("type"), "node_id",
        F.col("text").alias("content"), blank.alias("unit"),
    )
    measured = metrics.select(
        fact("metric", F.col("node_id"), F.col("idx")), F.lit("metric").alias("type"), "node_id",
        F.col("value").cast("string").alias("content"), "unit",
    )
    evidence = nodes.filter(F.col("type").isin("table", "image", "evidenceWarning")).select(
        fact("evidence", F.col("node_id")), F.lit("evidence").alias("type"), "node_id",
        F.coalesce("original_type", "type").alias("content"), blank.alias("unit"),
    )
    return claims.unionByName(measured).unionByName(evidence)


def invert_references(refs: DataFrame, member: str = "node_id") -> DataFrame:
    """A-02: source to members, as distinct rows: a much-cited source stays spread out."""
    return refs.select("source_id", member).distinct()


def coverage_map(units: DataFrame, node_refs: DataFrame, fact_refs: DataFrame,
                 dataset_nodes: DataFrame) -> DataFrame:
    """A-01: status, transformation and counts of nodes and facts per source.

    The members themselves are rows of ``invert_references``; they are not collected.
    """
    charted = dataset_nodes.select("node_id").distinct().withColumn("__d", F.lit(1))
    nodes = (
        invert_references(node_refs).join(charted, "node_id", "left")
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("nodes"), F.max("__d").alias("__d"))
    )
    facts = invert_references(fact_refs, "fact_id").groupBy("source_id").agg(
        F.count(F.lit(1)).alias("facts")
    )
    referenced = F.col("nodes").isNotNull()
    return (
        units.select("source_id", "type", "substantive")
        .join(nodes, "source_id", "left").join(facts, "source_id", "left")
        .select(
            "source_id", "type", "substantive",
            F.when(referenced, "preserved").otherwise("pending").alias("status"),
            F.when(F.col("__d") == 1, "visualize").otherwise("preserve").alias("transformation"),
            F.coalesce("nodes", F.lit(0)).cast("bigint").alias("nodes"),
            F.when(referenced, F.coalesce("facts", F.lit(0))).otherwise(F.lit(0))
            .cast("bigint").alias("facts"),
        )
    )


def unique_refs(refs: DataFrame, owner: str, order: str = "ord") -> DataFrame:
    """A-25: distinct sources per owner; the first occurrence gives the order."""
    return refs.groupBy(owner, "source_id").agg(F.min(order).alias(order))


def identity_manifest(pages: DataFrame, key: str, html: str,
                      attributes: list[str]) -> DataFrame:
    """A-22: distinct values of each attribute kind per page: ``key, kind, value``."""
    kinds = F.array(
        *[
            F.struct(F.lit(a).alias("kind"),
                     F.array_distinct(extract_attribute(F.col(html), a)).alias("values"))
            for a in attributes
        ]
    )
    return pages.select(key, F.explode(kinds).alias("k")).select(
        key, "k.kind", F.explode("k.values").alias("value")
    )


def repeated_identities(pages: DataFrame, key: str, html: str,
                        attributes: list[str]) -> DataFrame:
    """A-12 inside a page: attribute values used more than once."""
    kinds = F.array(
        *[
            F.struct(F.lit(a).alias("kind"), extract_attribute(F.col(html), a).alias("values"))
            for a in attributes
        ]
    )
    values = pages.select(key, F.explode(kinds).alias("k")).select(
        key, "k.kind", F.explode("k.values").alias("value")
    )
    return values.groupBy(key, "kind", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def source_pack(docs: DataFrame, units: DataFrame, warnings: DataFrame,
                terms=fixed.QUALIFIERS_AUDIT) -> dict[str, DataFrame]:
    """S-10: the parts of a source pack as frames, keyed by part name."""
    tables = units.filter(F.col("type").isin("table", "chart")).select(
        "source_id", "type", F.coalesce("caption", F.lit("")).alias("caption"),
        F.to_json("rows").alias("rows"),
    )
    return {
        "readable-source": docs.select(F.col("doc_id").cast("string").alias("name"), "text"),
        "fact-ledger": fact_ledger(units, terms=terms),
        "source-map": units.select("doc_id", "source_id", "ord", "type", "substantive"),
        "tables-and-datasets": tables,
        "extraction-warnings": warnings,
    }


def pack_manifest(parts: dict[str, DataFrame]) -> DataFrame:
    """S-10: ``part, sha256, rows`` of every part; equal for equal content in any order."""
    rows = None
    for part, df in parts.items():
        line = F.to_json(
            F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}
        )
        digests = df.select(
            F.lit(part).alias("part"), F.lit("").alias("name"), F.sha2(line, 256).alias("digest")
        )
        rows = digests if rows is None else rows.unionByName(digests)
    return fingerprint(rows, ["part"], "name", "digest")


def write_source_pack(parts: dict[str, DataFrame], folder: str) -> DataFrame:
    """S-10: write every part below ``folder`` and return the manifest of what was written."""
    spark = None
    for part, df in parts.items():
        spark = df.sparkSession
        df.write.mode("errorifexists").parquet(f"{folder}/{part}")
    written = {part: spark.read.parquet(f"{folder}/{part}") for part in parts}
    manifest = pack_manifest(written)
    manifest.write.mode("errorifexists").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")
