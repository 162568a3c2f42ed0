"""F-03, F-04, F-06, F-07, J-21, Q-01..Q-11: row rules that emit issues.

Rules are Column expressions in one pass over the table: every rule adds a ``when`` to
one array, which is compacted and exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.html import attribute_pattern
from tracebound.functions.lets import extract, found, matches, non_blank
from tracebound.functions.text import is_json, is_timestamp, js_trim
from tracebound.operators.issues import issue_rows
from tracebound.plans.lineage import cut


def flag_rows(df: DataFrame, flags: list[tuple[str, Column]], subject: str,
              severity: str = "error", detail: Column | None = None) -> DataFrame:
    """One issue per row and failing flag."""
    codes = F.array_compact(
        F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for code, test in flags])
    )
    rows = df.withColumn("__code", F.explode(codes))
    return issue_rows(rows, F.col("__code"), subject, detail, severity)


def check_constraints(df: DataFrame, spec: dict[str, dict], subject: str) -> DataFrame:
    """Q-01: ``required, enum, pattern, min, min_length, unique_items`` per column."""
    flags = []
    for name, rules in spec.items():
        value = F.col(name)
        if rules.get("required"):
            flags.append((f"{name}:required", value.isNull()))
        if "enum" in rules:
            flags.append((f"{name}:enum", ~value.isin(*rules["enum"])))
        if "pattern" in rules:
            flags.append((f"{name}:pattern", ~found(value, rules["pattern"])))
        if "min" in rules:
            flags.append((f"{name}:min", value < rules["min"]))
        if "min_length" in rules:
            flags.append((f"{name}:min_length", F.length(value) < rules["min_length"]))
        if rules.get("unique_items"):
            flags.append(
                (f"{name}:unique_items", F.size(F.array_distinct(value)) < F.size(value))
            )
    return flag_rows(df, flags, subject)


def unsafe_content(files: DataFrame, key: str, text: str, kind: str | None = None,
                   rules=fixed.UNSAFE_CONTENT_RULES,
                   kinds: dict[str, str] = fixed.UNSAFE_CONTENT_KINDS) -> DataFrame:
    """F-03: one issue per file and matching rule.

    ``kind`` names a column with the kind of file; rules in ``kinds`` then only count for theirs.
    """
    def test(code: str, pattern: str) -> Column:
        hit = found(F.col(text), pattern)
        return hit & (F.col(kind) == kinds[code]) if kind and code in kinds else hit

    return flag_rows(files, [(code, test(code, p)) for code, p in rules], key)


def external_resources(pages: DataFrame, key: str, text: str,
                       attr: str = fixed.EXTERNAL_ATTR,
                       css: str = fixed.EXTERNAL_CSS_URL) -> DataFrame:
    """F-04: distinct remote URLs per page."""
    urls = F.array_distinct(
        F.concat(matches(F.col(text), attr, 1), matches(F.col(text), css, 1))
    )
    return pages.select(key, F.explode(urls).alias("url"))


def allowlist_kind(files: DataFrame, path: str = "path") -> DataFrame:
    """F-06: keep declared inputs and label their kind."""
    value = F.col(path)
    kind = F.when(value.isin(*fixed.ALLOWED_SOURCE_FILES), "source-pack")
    for name, label in fixed.ALLOWED_FILE_KINDS:
        kind = kind.when(value == name, label)
    for prefix, label in fixed.ALLOWED_PREFIX_KINDS:
        kind = kind.when(value.startswith(prefix), label)
    return files.withColumn("kind", kind).filter(F.col("kind").isNotNull())


def dialog_policy(turns: DataFrame, max_questions: int = fixed.MAX_QUESTIONS,
                  forbidden: str = fixed.FORBIDDEN_QUESTION,
                  delegation: str = fixed.EXPLICIT_DELEGATION) -> DataFrame:
    """F-07: issues of whole dialogues.

    ``turns(conv_id, text, is_question, is_delegated)``. A dialogue is reduced to a few
    counts; its turns are never collected.
    """
    text = F.coalesce("text", F.lit(""))
    counts = turns.groupBy("conv_id").agg(
        F.count_if(js_trim(text) == "").alias("blank"),
        F.count_if("is_question").alias("questions"),
        F.count_if(F.col("is_question") & found(text, forbidden)).alias("forbidden"),
        F.count_if(F.col("is_delegated")).alias("delegated"),
        F.count_if(found(text, delegation)).alias("explicit"),
    )
    return flag_rows(
        counts,
        [
            ("blank-turn", F.col("blank") > 0),
            ("too-many-questions", F.col("questions") > max_questions),
            ("forbidden-topic", F.col("forbidden") > 0),
            ("delegation-not-explicit", (F.col("delegated") > 0) & (F.col("explicit") == 0)),
        ],
        "conv_id",
    )


def topic_coverage(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Q-11: answered topics that no evidence covers.

    ``answers(conv_id, topic)``, ``evidence(conv_id, topic)``.
    """
    missing = answers.select("conv_id", "topic").distinct().join(
        evidence.select("conv_id", "topic").distinct(), ["conv_id", "topic"], "left_anti"
    )
    return issue_rows(missing, "topic-not-evidenced", "conv_id", "topic")


def remap_codes(df: DataFrame, column: str, aliases: dict[str, str],
                migrations: dict[str, str]) -> DataFrame:
    """J-21: alias, then migration map; identity when unmapped.

    The maps are parameters of a few entries and become map literals in the plan.
    """
    def lookup(table, value):
        if not table:
            return value
        literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.coalesce(F.try_element_at(literal, value), value)

    mapped = lookup(migrations, lookup(aliases, F.col(column)))
    return df.withColumn("remapped", mapped).withColumn(
        "changed", ~F.col("remapped").eqNullSafe(F.col(column))
    )


# --- provenance ----------------------------------------------------------------


def missing_provenance(nodes: DataFrame, node_refs: DataFrame,
                       transformations=fixed.TRANSFORMATIONS) -> DataFrame:
    """Q-02: text without a source, without a transformation, or with an unknown one.

    ``nodes(node_id, type, text, transformation)``, ``node_refs(node_id)``.
    """
    cited = node_refs.select("node_id").distinct().withColumn("__cited", F.lit(True))
    rows = nodes.filter(F.col("type") != "legacyHtml").join(cited, "node_id", "left")
    has_text = js_trim(F.coalesce("text", F.lit(""))) != ""
    given = non_blank(F.col("transformation"))
    return flag_rows(
        rows,
        [
            ("source-reference-missing", has_text & F.col("__cited").isNull()),
            ("transformation-missing", has_text & given.isNull()),
            ("transformation-unsupported", ~given.isin(*transformations)),
        ],
        "node_id",
    )


def _has_attribute(raw: Column, name: str) -> Column:
    return found(raw, attribute_pattern(name))


def numeric_without_source(pages: DataFrame, key: str, html: str,
                           edit_attr: str = "data-edit-id",
                           source_attr: str = "data-source-ref") -> DataFrame:
    """Q-03: editable elements that show a digit and name no source."""
    pattern = fixed.ELEMENT_WITH.replace("ATTRIBUTE", edit_attr)
    elements = pages.select(key, F.explode(matches(F.col(html), pattern)).alias("__element"))
    attributes = extract("__element", pattern, 2)
    text = F.regexp_replace(extract("__element", pattern, 4), "<[^>]+>", " ")
    return issue_rows(
        elements.filter(text.rlike(r"\d") & ~_has_attribute(attributes, source_attr)),
        "numeric-without-source", key, extract("__element", pattern, 3),
    )


def derived_without_formula(pages: DataFrame, key: str, html: str,
                            derived_attr: str = "data-derived", derived_value: str = "true",
                            formula_attr: str = "data-formula",
                            identity_attrs=("data-edit-id", "data-chart-id")) -> DataFrame:
    """Q-04: derived values without a formula."""
    pattern = fixed.TAG_WITH.replace("ATTRIBUTE", derived_attr).replace("VALUE", derived_value)
    tags = pages.select(key, F.explode(matches(F.col(html), pattern)).alias("__tag"))
    identity = extract(
        "__tag", fixed.VALUE_OF.replace("ATTRIBUTE", "|".join(identity_attrs)), 1
    )
    return issue_rows(
        tags.filter(~_has_attribute(F.col("__tag"), formula_attr)),
        "derived-without-formula", key, F.coalesce(non_blank(identity), F.lit("unknown")),
    )


def charts_without_data(charts: DataFrame, payloads: DataFrame) -> DataFrame:
    """Q-05: charts need a source, a payload and valid JSON.

    ``charts(chart_id, source_ref)``, ``payloads(chart_id, json)``; of several payloads of a
    chart only the first counts, where a column ``pos`` gives their order.
    """
    if "pos" in payloads.columns:
        payloads = payloads.groupBy("chart_id").agg(F.min_by("json", "pos").alias("json"))
    rows = charts.join(
        payloads.withColumn("__present", F.lit(True)), "chart_id", "left"
    )
    return flag_rows(
        rows,
        [
            ("source-missing", non_blank(F.col("source_ref")).isNull()),
            ("payload-missing", F.col("__present").isNull()),
            ("payload-invalid", F.col("__present").isNotNull()
             & ~F.coalesce(is_json(F.col("json")), F.lit(False))),
        ],
        "chart_id",
    )


def page_charts(pages: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """Charts and payloads declared in pages, ready for ``charts_without_data``."""
    chart_tag = fixed.TAG_WITH.replace("ATTRIBUTE", "data-chart-id").replace("VALUE", r"[^\"']+")
    payload = fixed.CHART_PAYLOAD
    charts = pages.select(key, F.explode(matches(F.col(html), chart_tag)).alias("t")).select(
        F.concat_ws("/", key, extract("t", attribute_pattern("data-chart-id"), 1))
        .alias("chart_id"),
        extract("t", attribute_pattern("data-source-ref"), 1).alias("source_ref"),
    )
    payloads = pages.select(
        key, F.posexplode(matches(F.col(html), payload)).alias("pos", "s")
    ).select(
        F.concat_ws("/", key, extract("s", payload, 1)).alias("chart_id"),
        extract("s", payload, 2).alias("json"), "pos",
    )
    return charts, payloads


def incomplete_metrics(metrics: DataFrame, key: str,
                       fields=fixed.METRIC_FIELDS) -> DataFrame:
    """Q-07: missing parts of each metric, listed in ``detail``."""
    missing = F.array_compact(
        F.array(
            *[F.when(F.coalesce(F.col(f).cast("string"), F.lit("")) == "", F.lit(f))
              for f in fields]
        )
    )
    rows = metrics.withColumn("__missing", missing).filter(F.size("__missing") > 0)
    return issue_rows(rows, "incomplete-metric", key, F.array_join("__missing", ","))


def invalid_omissions(omissions: DataFrame, key: str = "source_id") -> DataFrame:
    """Q-08: an omission needs a reason, the authorizer ``user`` and a valid time."""
    return flag_rows(
        omissions,
        [
            ("reason-missing", js_trim(F.coalesce("reason", F.lit(""))) == ""),
            ("not-authorized", ~F.col("authorized_by").eqNullSafe(F.lit("user"))),
            ("invalid-time", ~is_timestamp(F.col("authorized_at"))),
        ],
        key,
    )


def valid_override(fields=fixed.OVERRIDE_FIELDS,
                   cell_field: str = fixed.OVERRIDE_CELL_FIELD) -> Column:
    """Provenance rule of a user override, over its columns."""
    return F.coalesce(
        (F.col("provenance") == "user-override")
        & (F.coalesce("node_id", F.lit("")) != "")
        & (F.col("field").isin(*fields) | F.col("field").rlike(cell_field))
        & is_timestamp(F.col("changed_at")),
        F.lit(False),
    )


def invalid_overrides(overrides: DataFrame, **parameters) -> DataFrame:
    """Q-09: overrides without valid provenance."""
    return issue_rows(
        overrides.filter(~valid_override(**parameters)), "invalid-override", "node_id", "field"
    )


def assessment_rules(assessments: DataFrame, min_chars: int = fixed.ASSESSMENT_MIN_CHARS,
                     key: str = "source_id") -> DataFrame:
    """Q-10: enumerations, description length and cross-column rules of assessments.

    ``source_id, asset_path, description, rationale, content_role, information_loss,
    value, treatment, source_binding``.
    """
    def short(column, least):
        return F.length(js_trim(F.coalesce(column, F.lit("")))) < least

    def outside(column, allowed):
        return ~F.coalesce(F.col(column).isin(*allowed), F.lit(False))

    bad_level = (
        outside("content_role", fixed.CONTENT_ROLES)
        | outside("information_loss", fixed.LEVELS)
        | outside("value", fixed.LEVELS)
        | outside("treatment", fixed.TREATMENTS)
    )
    # An unsupported level ends the judgment of a row: the rules below do not apply.
    def judged(test):
        return ~bad_level & test

    return flag_rows(
        assessments,
        [
            ("asset-path-missing", short("asset_path", 1)),
            ("description-too-short", short("description", min_chars)),
            ("rationale-too-short", short("rationale", min_chars)),
            ("unsupported-level", bad_level),
            (
                "high-information-omitted",
                judged(
                    (F.col("treatment") == "omit") & (F.col("information_loss") == "high")
                    & F.col("content_role").isin(*fixed.LOSS_SENSITIVE_ROLES)
                ),
            ),
            ("high-value-omitted",
             judged((F.col("treatment") == "omit") & (F.col("value") == "high"))),
            ("redraw-without-binding",
             judged((F.col("treatment") == "redraw") & short("source_binding", 1))),
        ],
        key,
    )


def json_numbers(df: DataFrame, key: str, json: str,
                 skip=fixed.NON_VALUE_KEYS) -> DataFrame:
    """N-05: every JSON number in a document, at any depth: ``key, field, value``.

    ``field`` joins the object keys on the way with dots; array elements share their array's
    name. Strings, booleans and nulls do not count, and whatever stands under a key of
    ``skip`` is left out at every depth. ``value`` is the text of the number, so ``18.0`` reads
    ``18``. Invalid JSON has no numbers. One round per level of nesting; a level only carries
    the objects and arrays that are left.
    """
    spark = df.sparkSession
    level = df.select(F.col(key).alias("__k"), F.lit("").alias("field"),
                      F.try_parse_json(F.col(json)).alias("__v"))
    kind = F.schema_of_variant("value")
    out = None
    while True:
        entries = (
            level.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
            .filter(F.col("key").isNull() | ~F.col("key").isin(*skip))
            .select("__k", F.concat_ws(".", F.nullif("field", F.lit("")), "key").alias("field"),
                    "value", kind.alias("__kind"))
        )
        leaves = entries.filter(F.col("__kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")).select(
            "__k", "field", F.col("value").cast("string").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        level = cut(entries.filter(F.col("__kind").rlike("^(OBJECT|ARRAY)<")).select(
            "__k", "field", F.col("value").alias("__v")))
        if level.isEmpty():
            break
    return out.select(
        F.col("__k").alias(key), "field",
        F.regexp_replace(F.regexp_replace("value", r"(\.\d*?)0+$", "$1"), r"\.$", "").alias("value"))
