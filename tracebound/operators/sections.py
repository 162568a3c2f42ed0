"""W-01, W-03, W-04, W-09, A-20, A-21, J-20: document structure.

Units of one document come from one text cell, so windows per document are bounded by
that cell. Frames whose groups can be larger (dialogues, sections of a corpus) go through
``plans.ordered``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.lets import computed, found
from tracebound.functions.text import classify_by_rules, split_sentences
from tracebound.plans.lineage import cut
from tracebound.plans.ordered import positions
from tracebound.plans.prefix import chunk_starts


def assign_sections(units: DataFrame, name: str = "doc_id") -> DataFrame:
    """W-01: each unit belongs to the last heading at or before it in its document.

    Adds ``section_ord`` (NULL before any heading) and ``section_title`` (the document
    name there).
    """
    upto = Window.partitionBy(name).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(
        F.col("type") == "heading", F.struct(F.col("ord"), F.coalesce("text", F.lit("")))
    )
    last = F.last(heading, ignorenulls=True).over(upto)
    return (
        units.withColumn("__h", last)
        .withColumn("section_ord", F.col("__h")["ord"])
        .withColumn(
            "section_title",
            F.coalesce(
                F.when(F.col("__h")["col2"] != "", F.col("__h")["col2"]),
                F.col(name).cast("string"),
            ),
        )
        .drop("__h")
    )


def following_text(units: DataFrame, name: str = "doc_id") -> DataFrame:
    """W-03: text of the next unit when it is a paragraph, else the empty string.

    Units with a ``source_id`` also get ``following_source``, that of the same paragraph.
    """
    w = Window.partitionBy(name).orderBy("ord")
    is_text = F.lead("type").over(w) == "paragraph"
    found_next = {"following_text": F.coalesce(F.when(is_text, F.lead("text").over(w)), F.lit(""))}
    if "source_id" in units.columns:
        found_next["following_source"] = F.when(is_text, F.lead("source_id").over(w))
    return units.withColumns(found_next)


def describe_images(units: DataFrame, pattern: str = fixed.DATA_IMAGE_PATTERN,
                    mode: str = "data-first") -> DataFrame:
    """Images whose description says they hold data become ``evidenceWarning``, in data-first mode only.

    ``units`` as returned by ``following_text``. A warning keeps its type as ``original_type``; its
    ``warning_text`` is the caption, the following text or the alternative text, the first that is not
    empty; with ``following_source``, its ``source_refs`` name the paragraph that follows as well.
    """
    description = F.concat_ws(
        " ", F.coalesce("alt", F.lit("")), F.coalesce("caption", F.lit("")), "following_text"
    )
    is_data = (F.col("type") == "image") & found(description, pattern) & F.lit(mode == "data-first")
    texts = [F.nullif(F.col(c), F.lit("")) for c in ("caption", "following_text", "alt")]
    columns = {
        "original_type": F.when(is_data, F.col("type")),
        "warning_text": F.when(is_data, F.coalesce(*texts)),
        "type": F.when(is_data, "evidenceWarning").otherwise(F.col("type")),
    }
    if "following_source" in units.columns:
        cited = F.array("source_id", F.when(is_data, F.col("following_source")))
        columns["source_refs"] = F.filter(cited, lambda s: s.isNotNull())
    return units.withColumns(columns)


def _before(units: DataFrame, key: str, labels: Column, width: int) -> DataFrame:
    """``key, ord, before``: number of the label in force before each unit; 1 is the default.

    ``units(key, ord, fixed, only, whole)`` hold numbers of labels: ``fixed`` is what a unit hands on;
    a unit with ``only`` and ``whole`` hands on ``whole`` after a unit of label ``only``, else ``only``.
    """
    unit = F.struct("ord", "fixed", "only", "whole")
    buckets = cut(
        units.groupBy(key, F.floor(F.col("ord") / width).cast("bigint").alias("chunk"))
        .agg(F.array_sort(F.collect_list(unit)).alias("units")))
    first = buckets.groupBy(key).agg(F.min("chunk").alias("__first"))
    buckets = buckets.join(first, key).withColumn("chunk", F.col("chunk") - F.col("__first")).drop("__first")

    def handed_on(state, u):
        told = F.when(state == u["only"], u["whole"]).otherwise(u["only"])
        return F.coalesce(u["fixed"], F.when(u["only"].isNotNull(), told), state)

    ends = F.transform(
        F.sequence(F.lit(1).cast("bigint"), labels.cast("bigint")),
        lambda start: F.struct(start.alias("start"), F.aggregate("units", start, handed_on).alias("end")))
    starts = chunk_starts(
        buckets.select(key, "chunk", F.inline(ends)).filter(F.col("start") != F.col("end")),
        buckets.select(key, "chunk", F.lit(0).cast("bigint").alias("shift")), [key], 1)

    def step(acc, u):
        return F.struct(handed_on(acc["state"], u).alias("state"), F.concat(acc["out"], F.array(acc["state"])).alias("out"))

    begin = F.struct(F.col("start").alias("state"), F.array().cast("array<bigint>").alias("out"))
    return buckets.join(starts, [key, "chunk"]).select(key, F.inline(F.zip_with(
        "units", F.aggregate("units", begin, step)["out"],
        lambda u, state: F.struct(u["ord"].alias("ord"), state.alias("before")))))


def carry_label(units: DataFrame, key: str, rules=fixed.TEXT_DIMENSION_RULES,
                default: str = fixed.DIMENSION_DEFAULT, ends: str = fixed.SENTENCE_ENDS,
                bucket_width: int = 4096) -> DataFrame:
    """W-04: texts with the last label seen: ``key, ord, sentence_no, sentence, label``.

    A unit is split into sentences only when these carry different labels, counting the
    label that is in force before the unit; otherwise it stays whole and takes the label of
    the whole text, or keeps the one in force. What a unit hands on is known from its own text
    in all but one case: where the whole text and its only labelled sentence disagree, it depends
    on the label before it. Labels are few, so a bucket of units is a map from label to label, and
    a prefix scan over the buckets finds the label before each; units per key may be any number.
    ``ord`` is unique per key; the text is not shuffled until its label is known.
    """
    found_in = F.transform(
        split_sentences(F.col("text"), ends),
        lambda s: F.struct(s.alias("sentence"), classify_by_rules(s, rules).alias("label")),
    )
    read = computed(
        units.select(key, "ord", "text"),
        parts=found_in, whole=classify_by_rules(F.col("text"), rules),
    )
    labels = F.filter("parts.label", lambda x: x.isNotNull())
    several = F.size("parts") >= 2
    first = F.try_element_at("parts.label", F.lit(1))
    only = F.when(
        several & (F.size(F.array_distinct(labels)) == 1) & first.isNull(), F.element_at(labels, 1)
    )
    mixed = several & (F.size(F.array_distinct(labels)) > 1)
    read = read.select(
        key, "ord", "text", "parts", "whole",
        # The single label of a unit whose first sentence has none.
        only.alias("only"), mixed.alias("mixed"),
        F.when(mixed, F.element_at(labels, -1)).alias("last_label"),
    )
    depends = F.col("only").isNotNull() & F.col("whole").isNotNull() & (
        F.col("only") != F.col("whole")
    )
    known = F.when(F.col("mixed"), F.col("last_label")).otherwise(
        F.coalesce(F.when(depends, F.col("only")), "whole", "only")
    )
    names = F.array(*[F.lit(x) for x in dict.fromkeys([default, *(label for label, *_ in rules)])])
    number = lambda c: F.nullif(F.array_position(names, c), F.lit(0))
    before = _before(
        read.select(
            key, "ord", number(F.when(~depends | F.col("mixed"), known)).alias("fixed"),
            *(F.when(depends, number(F.col(c))).alias(c) for c in ("only", "whole"))),
        key, F.size(names), bucket_width)
    rows = read.join(before, [key, "ord"]).withColumn("before", F.element_at(names, F.col("before").cast("int")))
    split = F.col("mixed") | F.coalesce(F.col("only") != F.col("before"), F.lit(False))
    carried = F.transform(
        "parts",
        lambda p, n: F.struct(
            p["sentence"].alias("sentence"),
            F.coalesce(
                F.try_element_at(
                    F.filter(F.slice("parts.label", F.lit(1), n + 1), lambda x: x.isNotNull()),
                    F.lit(-1),
                ),
                F.col("before"),
            ).alias("label"),
        ),
    )
    whole = F.array(
        F.struct(F.col("text").alias("sentence"), F.coalesce("whole", "before").alias("label"))
    )
    return rows.select(
        key, "ord", F.posexplode(F.when(split, carried).otherwise(whole)).alias("sentence_no", "s")
    ).select(key, "ord", F.col("sentence_no").cast("bigint").alias("sentence_no"), "s.*")


def split_table_rows(tables: DataFrame, key: str,
                     rules=fixed.ROW_DIMENSION_RULES) -> DataFrame:
    """Table rows that carry a label of their own: ``key, row_idx, label, cells``.

    Tables without such a row are not returned: they keep the label in force.
    """
    return (
        tables.select(key, F.posexplode("rows").alias("row_idx", "cells"))
        .withColumn("label", classify_by_rules(F.try_element_at("cells", F.lit(1)), rules))
        .filter(F.col("label").isNotNull())
        .select(key, F.col("row_idx").cast("bigint").alias("row_idx"), "label", "cells")
    )


def marker_run(rows: DataFrame, key: str, order: str, marker: Column,
               member: Column) -> DataFrame:
    """W-09: the rows after a key's first marker, up to the first that is no member.

    Two pre-aggregated minima per key; no window.
    """
    first = rows.filter(marker).groupBy(key).agg(F.min(order).alias("__start"))
    after = rows.join(first, key).filter(F.col(order) > F.col("__start"))
    broken = after.filter(~F.coalesce(member, F.lit(False))).groupBy(key).agg(
        F.min(order).alias("__stop")
    )
    return (
        after.join(broken, key, "left")
        .filter(F.col("__stop").isNull() | (F.col(order) < F.col("__stop")))
        .drop("__start", "__stop")
    )


def repeated_entities(run: DataFrame, dimensions: DataFrame, key: str, entity: str,
                      min_entities: int = fixed.MIN_ENTITIES,
                      min_dimensions: int = fixed.MIN_DIMENSIONS) -> DataFrame:
    """A-20: keys whose run forms an entity group.

    ``run(key, entity)`` and ``dimensions(key, entity, label)``. Every entity needs
    ``min_dimensions`` labels and the run ``min_entities`` entities; else no row.
    """
    labels = dimensions.select(key, entity, "label").distinct().groupBy(key, entity).agg(
        F.count(F.lit(1)).alias("labels")
    )
    return (
        run.select(key, entity).distinct().join(labels, [key, entity], "left")
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.min(F.coalesce("labels", F.lit(0))).alias("fewest"),
        )
        .filter((F.col("entities") >= min_entities) & (F.col("fewest") >= min_dimensions))
        .select(key, "entities")
    )


def dimension_matrix(rows: DataFrame, entity: str, order: str,
                     preferred=fixed.DIMENSION_ORDER, bucket_width: int = 4096) -> DataFrame:
    """A-21: entity by label, in the preferred label order, as ordered rows.

    ``rows(entity, order, label, text, source_id)``. Labels outside the preferred list are
    dropped. ``position`` orders the texts of one cell; ``first_ref`` marks the first use of
    a source in it. The texts stay rows, since one cell may hold any number of them.
    """
    names = F.array(*[F.lit(p) for p in preferred])
    kept = rows.withColumn(
        "label_rank", F.array_position(names, F.col("label")).cast("bigint")
    ).filter(F.col("label_rank") > 0)
    numbered = positions(
        kept, [entity, "label_rank"], [F.col(order)], F.floor(F.col(order) / bucket_width),
        "position",
    )
    first = kept.groupBy(entity, "label_rank", "source_id").agg(F.min(order).alias("__first"))
    return (
        numbered.join(first, [entity, "label_rank", "source_id"])
        .withColumn("first_ref", F.col(order) == F.col("__first"))
        .select(entity, "label", "label_rank", "position", order, "text", "source_id",
                "first_ref")
    )


def assign_intent(nodes: DataFrame, chartable: DataFrame) -> DataFrame:
    """J-20: display intent by node type and by whether its dataset is chartable.

    ``nodes(node_id, type)``, ``chartable(node_id)``.
    """
    charted = chartable.select("node_id").distinct().withColumn("__c", F.lit(True))
    return nodes.join(charted, "node_id", "left").withColumn(
        "display_intent",
        F.when(F.col("type") == "evidenceWarning", "warning")
        .when(F.col("type") == "image", "evidence")
        .when(F.col("__c"), "chart-support").otherwise("narrative"),
    ).drop("__c")
