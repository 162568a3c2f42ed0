"""A-14, A-17, A-18, J-15, U-04, U-05: digests and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.functions.lets import let


def fingerprint(df: DataFrame, group: list[str], name: str, digest: str) -> DataFrame:
    """A-14: one digest per group over its (name, digest) rows, in any input order.

    Built as a two-level hash tree. Equal rows are counted first. Row digests are then
    bucketed by their first four hex digits, each bucket is hashed over its sorted
    digests, and the group over its sorted buckets. A group of any size is spread over
    65,536 buckets, so no task ever holds it whole.
    """
    rows = df.groupBy(*group, name, digest).agg(F.count(F.lit(1)).alias("__n"))
    line = F.concat_ws(
        "\u0000", F.coalesce(F.col(name).cast("string"), F.lit("")),
        F.coalesce(F.col(digest), F.lit("")), F.col("__n").cast("string"),
    )
    leaves = rows.select(*group, "__n", F.sha2(line, 256).alias("__d")).withColumn(
        "__bucket", F.substring("__d", 1, 4)
    )

    def combine(column):
        return F.sha2(F.array_join(F.array_sort(F.collect_list(column)), ""), 256)

    buckets = leaves.groupBy(*group, "__bucket").agg(
        combine("__d").alias("__d"), F.sum("__n").alias("__n")
    )
    top = F.struct("__bucket", "__d")
    return buckets.groupBy(*group).agg(
        F.sha2(
            F.array_join(F.transform(F.array_sort(F.collect_list(top)), lambda b: b["__d"]), ""),
            256,
        ).alias("sha256"),
        F.sum("__n").cast("bigint").alias("rows"),
    )


def plan_digest(facets: DataFrame, overview: DataFrame | None = None) -> DataFrame:
    """A-17: digest of a plan, the same for any order of entities, facets or references.

    ``facets(plan_id, entity_id, facet_id, source_id)``; ``overview(plan_id, source_id)``.
    """
    rows = facets.select(
        "plan_id", F.concat_ws("\u0001", "entity_id", "facet_id").alias("name"),
        F.col("source_id").cast("string").alias("member"),
    )
    if overview is not None:
        rows = rows.unionByName(
            overview.select(
                "plan_id", F.lit("").alias("name"),
                F.col("source_id").cast("string").alias("member"),
            )
        )
    return fingerprint(rows.distinct(), ["plan_id"], "name", "member")


def signature(rows: DataFrame, group: str, category: str, kind: str,
              counted: bool = False) -> DataFrame:
    """A-18: sorted ``category:type`` joined by a bar.

    Repeats are counted before anything is collected. By default each pair stands as often
    as it occurs. ``counted`` writes ``pairxn`` instead, for groups of unbounded size: the
    signature then grows with the distinct pairs only.
    """
    pairs = rows.groupBy(group, F.concat_ws(":", category, kind).alias("pair")).agg(
        F.count(F.lit(1)).alias("n")
    )
    if counted:
        shown = F.concat_ws("x", "pair", F.col("n").cast("string"))
    else:
        shown = F.array_join(F.array_repeat("pair", F.col("n").cast("int")), "|")
    entry = F.struct("pair", shown.alias("shown"))
    return pairs.groupBy(group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["shown"]), "|"
        ).alias("signature")
    )


def snapshot_diff(before: DataFrame, after: DataFrame, key: list[str],
                  columns: list[str]) -> DataFrame:
    """J-15: ``key, change, fields``: added, removed or changed rows of two snapshots.

    Long values are replaced by their digests on each side, so the join shuffles digests.
    """
    def side(df, tag):
        return df.select(
            *key,
            *[F.sha2(F.col(c).cast("string"), 256).alias(f"{tag}_{c}") for c in columns],
            F.lit(True).alias(tag),
        )

    joined = side(before, "__b").join(side(after, "__a"), key, "full_outer")
    fields = F.array_compact(
        F.array(
            *[F.when(~F.col(f"__b_{c}").eqNullSafe(F.col(f"__a_{c}")), F.lit(c))
              for c in columns]
        )
    )
    change = (
        F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed")
        .when(F.size(fields) > 0, "changed")
    )
    return (
        joined.withColumn("change", change).filter(F.col("change").isNotNull())
        .select(
            *key, "change",
            F.when(F.col("change") == "changed", F.array_join(fields, ","))
            .otherwise("").alias("fields"),
        )
    )


def missing_members(required: DataFrame, actual: DataFrame) -> DataFrame:
    """U-04: required rows that are absent."""
    return required.distinct().subtract(actual.select(*required.columns))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """U-03: ``exceptAll`` by counts: what is left over, with ``n`` surplus copies.

    Counting first keeps a row that occurs a billion times one row in the shuffle.
    """
    keys = left.columns
    signed = (
        left.withColumn("__s", F.lit(1)).unionByName(right.select(*keys).withColumn("__s", F.lit(-1)))
    )
    return signed.groupBy(*keys).agg(F.sum("__s").alias("n")).filter("n > 0")


def same_collection(left: DataFrame, right: DataFrame) -> DataFrame:
    """U-05: one row ``same, only_left, only_right`` comparing two multisets."""
    keys = left.columns
    signed = (
        left.withColumn("__s", F.lit(1)).unionByName(right.select(*keys).withColumn("__s", F.lit(-1)))
        .groupBy(*keys).agg(F.sum("__s").alias("n"))
    )
    return signed.agg(
        F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_right"),
    ).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def term_overlap(left, right):
    """U-06: Jaccard overlap of two distinct term arrays; two empty arrays score 0."""
    def score(sides):
        shared = F.size(F.array_intersect(sides["l"], sides["r"]))
        union = F.size(sides["l"]) + F.size(sides["r"]) - shared
        return F.when(union == 0, F.lit(0.0)).otherwise(shared / union)

    return let(F.struct(left.alias("l"), right.alias("r")), score)
