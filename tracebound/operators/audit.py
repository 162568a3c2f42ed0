"""J-01..J-09, J-13, J-14, J-18, J-19, A-16, A-19, A-24: claims against sources.

Tokens are reduced inside the row first. What is shuffled is (id, token) pairs, so a
frequent token never makes a hot key on its own. Lookups of one source by many claims
are plain equi-joins whose many-side may be split by adaptive skew handling: no
operator below needs the join's partitioning afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.lets import computed, empty_strings, non_blank
from tracebound.functions.text import (
    comparable_numbers, is_timestamp, js_trim, lexical_terms, protected_tokens,
    qualification_tokens,
)
from tracebound.operators.issues import issue_rows
from tracebound.operators.rules import json_numbers


def unknown_references(refs: DataFrame, universe: DataFrame, key: str,
                       subject: str) -> DataFrame:
    """J-01: references to an identifier that does not exist.

    The distinct identifiers are checked first, so a much-cited one is looked up once.
    """
    unknown = refs.select(key).distinct().join(universe.select(key).distinct(), key, "left_anti")
    return issue_rows(refs.join(unknown, key, "left_semi"), "unknown-reference", subject, key)


def uncovered_sources(units: DataFrame, covered: DataFrame, omitted: DataFrame) -> DataFrame:
    """J-02: substantive units neither cited nor validly omitted."""
    accounted = covered.select("source_id").union(omitted.select("source_id")).distinct()
    return issue_rows(
        units.filter("substantive").join(accounted, "source_id", "left_anti"),
        "content-plan-missing", "source_id",
    )


def coverage_orphans(coverage: DataFrame, refs: DataFrame) -> DataFrame:
    """J-03: pending, omitted without a reason, or marked used but not referenced."""
    used = refs.select("source_id").distinct().withColumn("__used", F.lit(True))
    code = (
        F.when(F.col("substantive") & (F.col("status") == "pending"), "unmapped-source")
        .when(
            (F.col("status") == "omitted") & (F.coalesce("reason", F.lit("")) == ""),
            "omitted-without-reason",
        )
        .when(F.col("status").isin("preserved", "merged") & F.col("__used").isNull(),
              "not-referenced")
    )
    rows = coverage.join(used, "source_id", "left").withColumn("code", code)
    return issue_rows(rows.filter("code IS NOT NULL"), F.col("code"), "source_id", "status")


def _fact_tokens(bindings: DataFrame, facts: DataFrame, dialect: str) -> DataFrame:
    tokens = facts.select(
        "fact_id", F.array_distinct(comparable_numbers(F.col("raw_text"), dialect)).alias("tokens")
    )
    # repeats do no harm where this is used, and finding them would shuffle every pair again
    return bindings.select("content_id", "fact_id").join(tokens, "fact_id").select(
        "content_id", F.explode("tokens").alias("token"))


def unbound_numbers(claims: DataFrame, bindings: DataFrame, facts: DataFrame,
                    dialect: str = "audit") -> DataFrame:
    """J-04: set fidelity. Claim numbers that no bound fact contains.

    ``claims(content_id, text)``, ``bindings(content_id, fact_id)``,
    ``facts(fact_id, raw_text)``.
    """
    wanted = claims.select(
        "content_id",
        F.explode(F.array_distinct(comparable_numbers(F.col("text"), dialect))).alias("token"),
    )
    missing = wanted.join(
        _fact_tokens(bindings, facts, dialect), ["content_id", "token"], "left_anti"
    )
    return issue_rows(missing, "fact-distortion", "content_id", "token")


def token_counts(df: DataFrame, key: str, text: str, dialect: str) -> DataFrame:
    return (
        df.select(key, F.explode(comparable_numbers(F.col(text), dialect)).alias("token"))
        .groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))
    )


def unsupported_numbers(claims: DataFrame, refs: DataFrame, units: DataFrame,
                        dialect: str = "editorial", edited: DataFrame | None = None) -> DataFrame:
    """J-05: multiset fidelity. Numbers a claim uses more often than its sources do.

    ``claims(claim_id, text)``, ``refs(claim_id, source_id)``, ``units(source_id, text)``. Claims in
    ``edited(claim_id)``, which a person has overridden, are exempt.
    Returns ``claim_id, token, needed, available``.
    """
    needed = token_counts(_unedited(claims, edited), "claim_id", "text", dialect)
    return _more_than_cited(needed, refs, units, dialect)


def unsupported_dataset_numbers(datasets: DataFrame, refs: DataFrame, units: DataFrame,
                                edited: DataFrame | None = None,
                                dialect: str = "editorial") -> DataFrame:
    """J-05 for datasets and facts: their JSON numbers against the sources that they cite.

    ``datasets(claim_id, json)``; the rest as in ``unsupported_numbers``.
    """
    numbers = json_numbers(_unedited(datasets, edited), "claim_id", "json")
    return _more_than_cited(
        token_counts(numbers, "claim_id", "value", dialect), refs, units, dialect)


def uncited_datasets(datasets: DataFrame, refs: DataFrame) -> DataFrame:
    """J-05: issues for datasets and facts that cite nothing."""
    return issue_rows(
        datasets.join(refs, "claim_id", "left_anti"), "dataset-not-source-derived", "claim_id")


def _unedited(claims: DataFrame, edited: DataFrame | None) -> DataFrame:
    return claims if edited is None else claims.join(edited, "claim_id", "left_anti")


def _more_than_cited(needed: DataFrame, refs: DataFrame, units: DataFrame, dialect: str) -> DataFrame:
    needed = needed.withColumnRenamed("n", "needed")
    tokens = units.select("source_id", comparable_numbers(F.col("text"), dialect).alias("tokens"))
    available = (
        refs.join(tokens, "source_id")
        .select("claim_id", F.explode("tokens").alias("token"))
        .groupBy("claim_id", "token").agg(F.count(F.lit(1)).alias("available"))
    )
    return (
        needed.join(available, ["claim_id", "token"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .filter(F.col("needed") > F.col("available"))
    )


def unsupported_number_issues(found: DataFrame) -> DataFrame:
    return issue_rows(found, "numeric-token-absent", "claim_id", "token")


def dropped_qualifiers(claims: DataFrame, bindings: DataFrame, facts: DataFrame,
                       terms=fixed.QUALIFIERS_AUDIT, dialect: str = "audit") -> DataFrame:
    """J-06: a fact and a claim share a number, but a qualifier of the fact is gone."""
    fact_side = computed(
        facts.select("fact_id", "raw_text"),
        fact_numbers=F.array_distinct(comparable_numbers(F.col("raw_text"), dialect)),
        qualifiers=F.array_distinct(qualification_tokens(F.col("raw_text"), terms)),
    ).drop("raw_text").filter((F.size("qualifiers") > 0) & (F.size("fact_numbers") > 0))
    claim_side = computed(
        claims.select("content_id", "text"),
        claim_numbers=F.array_distinct(comparable_numbers(F.col("text"), dialect)),
    ).filter(F.size("claim_numbers") > 0)
    dropped = (
        bindings.select("content_id", "fact_id")
        .join(fact_side, "fact_id")
        .join(claim_side, "content_id")
        .filter(F.arrays_overlap("claim_numbers", "fact_numbers"))
        .select(
            "content_id",
            F.explode(
                F.filter("qualifiers", lambda q: ~F.contains(F.col("text"), q))
            ).alias("qualifier"),
        )
        .distinct()
    )
    return issue_rows(dropped, "dropped-qualification", "content_id", "qualifier")


def _claim_sums(claims: DataFrame, sources: DataFrame, terms, set_dialect: str,
                count_dialect: str) -> DataFrame:
    """``claim_id, token, codes``: the checks that a token of a claim fails; no claim is left out."""
    # joins follow, so these are computed once per row as they are
    own = claims.select(
        "claim_id", "text",
        F.array_distinct(comparable_numbers(F.col("text"), set_dialect)).alias("own_set"),
        comparable_numbers(F.col("text"), count_dialect).alias("own_count"),
    )
    facts = sources.select(
        "source_id",
        F.array_distinct(comparable_numbers(F.col("text"), set_dialect)).alias("fact_set"),
        comparable_numbers(F.col("text"), count_dialect).alias("fact_count"),
        F.array_distinct(qualification_tokens(F.col("text"), terms)).alias("qualifiers"),
    )
    # Narrow pairs go to the sources and bring their tokens back; the claim's text stays where it is.
    # The sums below need no shuffle then: everything about a claim already lies together.
    cited = claims.select(F.inline(F.transform("source_ids", lambda source, pos: F.struct(
        # the id within the generator: a filter on it would make another plan of ``claims``, read twice
        F.col("claim_id").alias("claim_id"), pos.alias("pos"), source.alias("source_id"))))
    ).join(facts, "source_id", "left").drop("source_id")

    def or_none(tokens):
        return F.coalesce(tokens, empty_strings())

    pairs = own.join(cited, "claim_id", "left").select(
        "claim_id", "text", "own_set", "own_count", "qualifiers",
        (F.coalesce("pos", F.lit(0)) == 0).alias("first"),
        or_none(F.array_intersect("own_set", "fact_set")).alias("shared"),
        or_none(F.filter("fact_count", lambda t: F.array_contains("own_count", t))).alias("met"),
    )

    # one row of numbers per token: wanted and found as a set, wanted and found as often, qualifier
    def tallies(tokens, set_wanted=0, set_found=0, wanted=0, found=0, dropped=0):
        def number(value, t, name):
            return (value(t).cast("int") if callable(value) else F.lit(value)).alias(name)

        return F.transform(tokens, lambda t: F.struct(
            t.alias("token"), number(set_wanted, t, "set_wanted"), number(set_found, t, "set_found"),
            number(wanted, t, "wanted"), number(found, t, "found"), number(dropped, t, "dropped")))

    def has(tokens):
        return lambda t: F.array_contains(tokens, t)

    none = F.array().cast(
        "array<struct<token:string,set_wanted:int,set_found:int,wanted:int,found:int,dropped:int>>")
    needs = F.when(F.col("first"), F.concat(
        tallies(F.array(F.lit(""))),  # the claim itself
        tallies("own_count", set_wanted=has("own_set"), wanted=1),
        tallies(F.array_except("own_set", "own_count"), set_wanted=1),
    )).otherwise(none)
    gone = F.when(
        (F.size("shared") > 0) & (F.size("qualifiers") > 0),
        tallies(F.filter("qualifiers", lambda q: ~F.contains(F.col("text"), q)), dropped=1),
    ).otherwise(none)
    rows = F.concat(
        needs, tallies("met", set_found=has("shared"), found=1),
        tallies(F.array_except("shared", "met"), set_found=1), gone)
    sums = (
        pairs.select("claim_id", F.explode(rows).alias("t"))
        .groupBy("claim_id", F.col("t.token").alias("token"))
        .agg(*[F.sum(f"t.{c}").alias(c) for c in ("set_wanted", "set_found", "wanted", "found", "dropped")])
    )
    return sums.select("claim_id", "token", F.array_compact(F.array(
        F.when((F.col("set_wanted") > 0) & (F.col("set_found") == 0), "fact-distortion"),
        F.when(F.col("wanted") > F.col("found"), "numeric-token-absent"),
        F.when(F.col("dropped") > 0, "dropped-qualification"),
    )).alias("codes"))


def claim_issues(claims: DataFrame, sources: DataFrame, terms=fixed.QUALIFIERS_AUDIT,
                 set_dialect: str = "audit", count_dialect: str = "editorial") -> DataFrame:
    """J-04, J-05 and J-06 together: one join and one aggregation for all three checks.

    ``claims(claim_id, text, source_ids ARRAY)`` with unique ids, ``sources(source_id, text)``. Each pair
    of a claim and a cited source tallies the tokens that both hold, and the first pair of
    a claim also tallies what the claim needs; the sums per (claim, token) decide.
    """
    sums = _claim_sums(claims, sources, terms, set_dialect, count_dialect)
    failed = sums.filter(F.size("codes") > 0).select("claim_id", "token", F.explode("codes").alias("code"))
    return issue_rows(failed, F.col("code"), "claim_id", "token")


def claim_verdicts(claims: DataFrame, sources: DataFrame, terms=fixed.QUALIFIERS_AUDIT,
                   set_dialect: str = "audit", count_dialect: str = "editorial") -> DataFrame:
    """A-23 over ``claim_issues``, for every claim, without reading the claims again."""
    sums = _claim_sums(claims, sources, terms, set_dialect, count_dialect)
    return sums.groupBy("claim_id").agg(
        F.sum(F.size("codes")).cast("bigint").alias("errors")
    ).select(
        F.col("claim_id").cast("string").alias("subject_id"), "errors",
        F.lit(0).cast("bigint").alias("warnings"), (F.col("errors") == 0).alias("valid"),
    )


def unsupported_terms(claims: DataFrame, refs: DataFrame, units: DataFrame,
                      terms=fixed.PROTECTED_TERMS) -> DataFrame:
    """J-07: protected words of a claim that none of its sources contains."""
    wanted = computed(
        claims.select("claim_id", "text"),
        terms=F.array_distinct(F.transform(protected_tokens(F.col("text"), terms), F.lower)),
    ).select("claim_id", "terms").filter(F.size("terms") > 0)
    found = (
        refs.select("claim_id", "source_id").distinct()
        .join(wanted, "claim_id")
        .join(units.select("source_id", F.lower("text").alias("source_text")), "source_id")
        .select(
            "claim_id",
            F.explode(
                F.filter("terms", lambda t: F.contains(F.col("source_text"), t))
            ).alias("term"),
        )
        .distinct()
    )
    missing = (
        wanted.select("claim_id", F.explode("terms").alias("term"))
        .join(found, ["claim_id", "term"], "left_anti")
    )
    return issue_rows(missing, "unsupported-term", "claim_id", "term")


def _bits(terms: str, kept: Column) -> Column:
    """One bit per term, set for those in ``kept``, as words of 64 bits."""
    def word(number):
        part = F.slice(terms, number * 64 + 1, F.lit(64))
        bits = F.transform(part, lambda t, i: F.when(
            F.array_contains(kept, t), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
        ).otherwise(F.lit(0).cast("bigint")))
        return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))

    last = F.floor((F.size(terms) - 1) / 64).cast("int")
    return F.transform(F.sequence(F.lit(0), last), word)


def lexical_support(claims: DataFrame, refs: DataFrame, units: DataFrame,
                    share: float = fixed.LEXICAL_SUPPORT_SHARE,
                    exempt: DataFrame | None = None) -> DataFrame:
    """J-08: ``claim_id, terms, shared, required, supported`` for claims with any term.

    Claims in ``exempt(claim_id)`` are not judged: those that a person has overridden, and nodes
    that only group others (sections, entity groups, images).
    """
    claim_terms = computed(
        _unedited(claims, exempt).select("claim_id", "text"), claim_terms=lexical_terms(F.col("text"))
    ).select("claim_id", "claim_terms").filter(F.size("claim_terms") > 0)
    source_terms = computed(
        units.select("source_id", "text"), source_terms=lexical_terms(F.col("text"))
    ).select("source_id", "source_terms")
    # what a source shares is a bit per term of the claim; bits of several sources are or-ed
    shared = (
        refs.select("claim_id", "source_id").distinct()
        .join(claim_terms, "claim_id").join(source_terms, "source_id")
        .withColumn("both", F.array_intersect("claim_terms", "source_terms"))
        .select("claim_id", F.posexplode(_bits("claim_terms", F.col("both"))).alias("word", "bits"))
        .groupBy("claim_id", "word").agg(F.bit_or("bits").alias("bits"))
        .groupBy("claim_id").agg(F.sum(F.bit_count("bits")).alias("shared"))
    )
    return (
        claim_terms.select("claim_id", F.size("claim_terms").cast("bigint").alias("terms"))
        .join(shared, "claim_id", "left")
        .withColumn("shared", F.coalesce("shared", F.lit(0)).cast("bigint"))
        .withColumn(
            "required", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.lit(share))).cast("bigint")
        )
        .withColumn("supported", F.col("shared") >= F.col("required"))
    )


def attribute_by_number(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """J-09: texts whose every number points to exactly one source, the same one.

    ``texts(text_id, text)`` with unique ids, ``facts(ref, raw_text)``. A token is kept only when its
    smallest and largest source agree, so no set of sources is ever collected.
    """
    unique = (
        facts.select(
            "ref",
            F.explode(F.array_distinct(comparable_numbers(F.col("raw_text"), "bare")))
            .alias("token"),
        )
        .groupBy("token").agg(F.min("ref").alias("ref"), F.max("ref").alias("__max"))
        .filter(F.col("ref") == F.col("__max")).drop("__max")
    )
    tokens = computed(
        texts.select("text_id", "text"), found=F.array_distinct(comparable_numbers(F.col("text"), "bare"))
    ).select("text_id", F.size("found").cast("bigint").alias("tokens"), F.explode("found").alias("token"))
    return (
        # tokens that point nowhere end here; their text then has fewer left than it had
        tokens.join(unique, "token")
        .groupBy("text_id", "tokens")
        .agg(F.count(F.lit(1)).alias("resolved"), F.min("ref").alias("ref"), F.max("ref").alias("__max"))
        .filter((F.col("tokens") == F.col("resolved")) & (F.col("ref") == F.col("__max")))
        .select("text_id", "ref", "tokens")
    )


def reconcile(expected: DataFrame, decisions: DataFrame) -> DataFrame:
    """J-13: decisions against the expected assets.

    ``expected(asset, source_ref)``,
    ``decisions(asset, seq, source_ref, content_value, decision, rationale)``. The first
    decision on an asset is judged; later ones are duplicates, counted in ``detail``.
    """
    used = ("use-original", "redraw")
    first = decisions.groupBy("asset").agg(
        F.min_by(
            F.struct("source_ref", "content_value", "decision", "rationale"), "seq"
        ).alias("d"),
        F.count(F.lit(1)).alias("n"),
    )
    known, decided = F.col("expected_ref").isNotNull(), F.col("n").isNotNull()
    both = known & decided

    def outside(field, allowed):
        return ~F.coalesce(F.col(field).isin(*allowed), F.lit(False))

    short = (
        F.length(js_trim(F.coalesce("d.rationale", F.lit("")))) < fixed.DECISION_MIN_CHARS
    )
    codes = F.array_compact(
        F.array(
            F.when(decided & ~known, "unknown-asset"),
            F.when(known & ~decided, "missing-decision"),
            F.when(both & (F.col("n") > 1), "duplicate-decision"),
            F.when(both & ~F.col("d.source_ref").eqNullSafe(F.col("expected_ref")),
                   "source-mismatch"),
            F.when(both & outside("d.content_value", fixed.LEVELS), "invalid-value"),
            F.when(both & outside("d.decision", fixed.TREATMENTS), "invalid-decision"),
            F.when(both & short, "rationale-too-short"),
            F.when(
                both & (F.col("d.content_value") == "high") & outside("d.decision", used),
                "high-value-not-used",
            ),
        )
    )
    rows = (
        expected.select("asset", F.col("source_ref").alias("expected_ref"))
        .join(first, "asset", "full_outer")
        .withColumn("code", F.explode(codes))
    )
    extra = F.when(F.col("code") == "duplicate-decision", F.col("n") - 1)
    return issue_rows(rows, F.col("code"), "asset", extra)


def inherited_judgments(current: DataFrame, previous: DataFrame,
                        levels=fixed.LEVELS) -> DataFrame:
    """J-14: judgments that are new, misquoted or lowered without a rationale.

    ``current(source_id, value, declared_value, change_rationale)``,
    ``previous(source_id, value)``.
    """
    order = F.array(*[F.lit(x) for x in levels])
    before = previous.select("source_id", F.col("value").alias("before"))
    rank_now, rank_before = (F.array_position(order, F.col(c)) for c in ("value", "before"))
    code = F.when(F.col("before").isNull(), F.array(F.lit("judgment-missing"))).otherwise(
        F.array_compact(
            F.array(
                F.when(
                    non_blank(F.col("declared_value")).isNotNull()
                    & (F.col("declared_value") != F.col("before")),
                    "declared-value-mismatch",
                ),
                F.when(
                    (rank_now > 0) & (rank_before > 0) & (rank_now < rank_before)
                    & (js_trim(F.coalesce("change_rationale", F.lit(""))) == ""),
                    "unexplained-downgrade",
                ),
            )
        )
    )
    rows = current.join(before, "source_id", "left").withColumn("code", F.explode(code))
    return issue_rows(rows, F.col("code"), "source_id")


def all_rows_flags(assessments: DataFrame, group: str | None = None) -> DataFrame:
    """A-24: warn when every row is low value, or every row is omitted or decorative.

    With ``group`` each group is judged for itself and named in the warning.
    """
    rows = assessments.groupBy(group) if group else assessments
    totals = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value") == "low").alias("low"),
        F.count_if(
            (F.col("treatment") == "omit") | (F.col("content_role") == "decorative")
        ).alias("unused"),
    ).withColumn(
        "code",
        F.explode(
            F.array_compact(
                F.array(
                    F.when((F.col("n") > 0) & (F.col("n") == F.col("low")), "all-low-value"),
                    F.when((F.col("n") > 0) & (F.col("n") == F.col("unused")), "none-used"),
                )
            )
        ),
    )
    return issue_rows(totals, F.col("code"), group or F.lit("all"), severity="warning")


def coverage_division(facets: DataFrame, contents: DataFrame, content_sources: DataFrame,
                      final: bool = True) -> DataFrame:
    """A-16: which facets and entities are fully bound.

    ``facets(entity_id, facet_id, source_id)`` lists what each facet requires;
    ``contents(entity_id, facet_id, content_id, tier)`` what serves it (``facet_id``
    NULL serves the whole entity); ``content_sources(content_id, source_id)``. Content of
    the appendix tier never counts. Returns ``entity_id, facet_id, required, bound,
    passes``; ``final`` keeps the facets of entities that nothing serves.
    """
    serving = (
        contents.filter(F.col("tier") != "appendix")
        .join(content_sources, "content_id")
        .select("entity_id", "facet_id", "source_id").distinct()
    )
    own = serving.filter(F.col("facet_id").isNotNull())
    shared = serving.filter(F.col("facet_id").isNull()).select("entity_id", "source_id")
    required = facets.select("entity_id", "facet_id", "source_id").distinct()
    bound = (
        required.join(own, ["entity_id", "facet_id", "source_id"], "left_semi")
        .unionByName(required.join(shared, ["entity_id", "source_id"], "left_semi"))
        .distinct().withColumn("__bound", F.lit(1))
    )
    result = (
        required.join(bound, ["entity_id", "facet_id", "source_id"], "left")
        .groupBy("entity_id", "facet_id")
        .agg(F.count(F.lit(1)).alias("required"), F.count("__bound").alias("bound"))
        .withColumn("passes", F.col("required") == F.col("bound"))
    )
    if final:
        return result
    represented = contents.select("entity_id").distinct()
    return result.join(represented, "entity_id", "left_semi")


def bulk_share(units: DataFrame, appendix: DataFrame, authorized: DataFrame,
               group: str = "doc_id", min_units: int = fixed.BULK_MIN_UNITS,
               share: float = fixed.BULK_APPENDIX_SHARE) -> DataFrame:
    """A-19: groups with most of their substantive units in the appendix, unauthorized.

    ``units(group, source_id, substantive)``, ``appendix(source_id)``,
    ``authorized(group)``.
    """
    marked = appendix.select("source_id").distinct().withColumn("__appendix", F.lit(1))
    totals = (
        units.filter("substantive").select(group, "source_id")
        .join(marked, "source_id", "left")
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("units"), F.count("__appendix").alias("appendix_units"))
    )
    return totals.filter(
        (F.col("units") >= min_units) & (F.col("appendix_units") / F.col("units") >= share)
    ).join(authorized.select(group).distinct(), group, "left_anti")


def valid_authorization(by, reason, at):
    """Reason, authorizer ``user`` and a valid time."""
    return F.coalesce(
        (by == "user") & (js_trim(reason) != "") & is_timestamp(at), F.lit(False)
    )


def lineage_check(children: DataFrame, parents: DataFrame) -> DataFrame:
    """J-18: children whose named parent is unknown or has another digest.

    ``children(child_id, parent_id, parent_sha256)``, ``parents(parent_id, sha256)``.
    """
    rows = children.join(
        parents.select("parent_id", F.col("sha256").alias("__sha"), F.lit(True).alias("__known")),
        "parent_id", "left",
    ).withColumn(
        "code",
        F.when(F.col("__known").isNull(), "unknown-parent")
        .when(~F.col("parent_sha256").eqNullSafe(F.col("__sha")), "parent-hash-mismatch"),
    )
    return issue_rows(rows.filter("code IS NOT NULL"), F.col("code"), "child_id", "parent_id")


def verify_receipts(receipts: DataFrame, current: DataFrame, keys: list[str],
                    fields: list[str]) -> DataFrame:
    """J-19: the recorded fields that no longer hold, one row per field."""
    now = current.select(
        *keys, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__present")
    )
    changed = F.when(
        F.col("__present").isNull(), F.array(F.lit("missing"))
    ).otherwise(
        F.array_compact(
            F.array(
                *[F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields]
            )
        )
    )
    return receipts.join(now, keys, "left").select(*keys, F.explode(changed).alias("field"))
