"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.lets import found, let, matches, non_blank, one_of

NUL = "\u0000"


def js_trim(value: Column) -> Column:
    """Trim the Unicode whitespace set on both ends."""
    return F.btrim(value, F.lit(fixed.WS_CHARS))


def _replace_ws(value: Column, replacement: str) -> Column:
    """Replace each run of the Unicode whitespace set.

    Java's Unicode ``\\s`` is several times faster than a class that lists the set. The two
    differ in U+FEFF, which is made a space first, and in U+0085: text that has it takes the
    explicit class.
    """
    fast = F.regexp_replace(
        F.replace(value, F.lit("\ufeff"), F.lit(" ")), r"(?U)\s+", replacement
    )
    listed = F.regexp_replace(value, f"[{fixed.WS}]+", replacement)
    return F.when(F.contains(value, F.lit("\u0085")), listed).otherwise(fast)


def collapse_ws(value: Column) -> Column:
    return F.trim(_replace_ws(value, " "))


def normalize_ws(value: Column) -> Column:
    """Remove all whitespace."""
    return _replace_ws(value, "")


def normalize_rationale(value: Column, punctuation: str = fixed.RATIONALE_PUNCTUATION) -> Column:
    """Trimmed, lower-case, single-spaced, without punctuation."""
    flat = collapse_ws(F.lower(F.coalesce(value, F.lit(""))))
    return F.translate(flat, punctuation, "")


def split_lines(value: Column) -> Column:
    return F.split(value, "\r?\n")


def text_lines(value: Column) -> Column:
    """Trimmed lines without the blank ones."""
    return F.filter(
        F.transform(split_lines(F.coalesce(value, F.lit(""))), js_trim), lambda x: x != ""
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the first 16 hex digits of the digest of the NUL-joined parts."""
    joined = F.concat_ws(NUL, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 16))


def numeric_tokens(value: Column, dialect: str) -> Column:
    """Numeric tokens as text, in order, repeats kept."""
    tokens = matches(value, fixed.NUMERIC_PATTERNS[dialect])
    if dialect == "editorial":
        return F.transform(tokens, lambda t: F.replace(t, F.lit(","), F.lit("")))
    return tokens


def normalize_number(token: Column, dialect: str) -> Column:
    """Comparable form of one token. Tokens stay text: ``1`` and ``1.0`` differ."""
    plain = F.replace(token, F.lit(","), F.lit(""))
    if dialect == "editorial":
        return plain
    if dialect == "audit":
        return F.lower(plain)
    if dialect == "preflight":
        return F.regexp_replace(plain, fixed.PREFLIGHT_UNIT_SUFFIX, "")
    if dialect == "bare":
        return non_blank(F.regexp_extract(plain, fixed.LEADING_NUMBER, 0))
    raise ValueError(f"unknown dialect {dialect!r}")


# Which token pattern and which normal form go together in one check.
FIDELITY_DIALECTS = {
    "audit": ("ledger", "audit"),
    "preflight": ("preflight", "preflight"),
    "editorial": ("editorial", "editorial"),
    "bare": ("bare", "bare"),
}


def comparable_numbers(value: Column, dialect: str) -> Column:
    """Normalized numeric tokens of a text for one fidelity check."""
    pattern, form = FIDELITY_DIALECTS[dialect]
    tokens = numeric_tokens(value, pattern)
    if (pattern, form) == ("editorial", "editorial"):
        return tokens  # already without commas
    normal = F.transform(tokens, lambda t: normalize_number(t, form))
    # only the bare form may find nothing in a token
    return F.filter(normal, lambda t: t.isNotNull()) if form == "bare" else normal


def qualification_tokens(value: Column, terms=fixed.QUALIFIERS_AUDIT) -> Column:
    return matches(value, one_of(terms))


def protected_tokens(value: Column, terms=fixed.PROTECTED_TERMS) -> Column:
    return matches(value, "(?i)" + one_of(terms))


def lexical_terms(value: Column) -> Column:
    """Distinct ASCII words of three or more characters and CJK bigrams."""
    lowered = F.lower(F.coalesce(value, F.lit("")))
    bigrams = F.flatten(
        F.transform(
            matches(lowered, fixed.CJK_RUN),
            lambda run: F.transform(
                F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2))
            ),
        )
    )
    return F.array_distinct(F.concat(matches(lowered, fixed.LEXICAL_WORD), bigrams))


def cjk_length(value: Column) -> Column:
    # Counting what is left after deleting everything else keeps no match array.
    return F.length(F.regexp_replace(value, r"[^\x{3400}-\x{9fff}]+", "")).cast("bigint")


def utf16_length(value: Column) -> Column:
    return (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("bigint")


def parse_numeric_cell(value: Column) -> Column:
    """STRUCT<raw, value DOUBLE, unit> of a numeric cell, or NULL."""
    raw = js_trim(F.coalesce(value, F.lit("")))
    number = F.regexp_extract(raw, fixed.NUMERIC_CELL, 1)
    return F.when(
        number != "",
        F.struct(
            raw.alias("raw"),
            F.replace(number, F.lit(","), F.lit("")).try_cast("double").alias("value"),
            js_trim(F.regexp_extract(raw, fixed.NUMERIC_CELL, 2)).alias("unit"),
        ),
    )


def unit_from_label(value: Column, units=fixed.LABEL_UNITS) -> Column:
    return F.regexp_extract(F.coalesce(value, F.lit("")), one_of(units), 0)


def split_sentences(value: Column, ends: str = fixed.SENTENCE_ENDS) -> Column:
    return matches(value, f"[^{ends}]+[{ends}]?")


def classify_by_rules(value: Column, rules=fixed.TEXT_DIMENSION_RULES,
                      opening_chars: int = fixed.OPENING_CHARS) -> Column:
    """Label of the first rule that matches, or NULL.

    A rule is ``(label, where, pattern)``; ``where`` is ``opening`` or ``text``.
    """
    text = js_trim(F.coalesce(value, F.lit("")))
    result = None
    for label, where, pattern in rules:
        target = F.substring(text, 1, opening_chars) if where == "opening" else text
        test = found(target, pattern)
        result = F.when(test, F.lit(label)) if result is None else result.when(test, F.lit(label))
    return F.lit(None).cast("string") if result is None else result


def is_safe_id(value: Column) -> Column:
    return F.coalesce(value.rlike(fixed.SAFE_ID), F.lit(False))


def canonical_json(*columns: str) -> Column:
    """JSON text with keys in name order. NULL values are kept as ``null``."""
    parts = [F.col(c).alias(c) for c in sorted(columns)]
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def canonical_map_json(value: Column) -> Column:
    """JSON text of a map, keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(value))))


def row_digest(*columns: str) -> Column:
    return F.sha2(canonical_json(*columns), 256)


def _code_point(number: Column) -> Column:
    """Character of one code point; NULL when there is none."""
    return F.when(
        number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF),
        F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"),
    )


def _decode_references(value: Column, pattern: str, to_number) -> Column:
    # One pass: the pieces between the references, each followed by its character. Each
    # distinct reference of a text is decoded once.
    def pieces(refs: Column) -> Column:
        known = F.array_distinct(refs)
        table = F.map_from_arrays(
            known, F.transform(known, lambda r: F.coalesce(_code_point(to_number(r)), r))
        )
        return let(
            table,
            lambda chars: F.array_join(
                F.zip_with(
                    F.split(value, pattern, -1),
                    refs,
                    lambda piece, ref: F.concat(
                        F.coalesce(piece, F.lit("")),
                        F.coalesce(F.try_element_at(chars, ref), F.lit("")),
                    ),
                ),
                "",
            ),
        )

    return let(matches(value, f"({pattern})", 1), pieces)


def decode_entities(value: Column) -> Column:
    """Decode lt, gt, quot, apos, then amp, then decimal and hexadecimal references."""
    text = value
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))

    def numbered(t: Column) -> Column:
        decimal = _decode_references(
            t, r"&#\d+;",
            lambda r: F.regexp_extract(r, r"\d+", 0).try_cast("bigint"),
        )
        return let(
            decimal,
            lambda d: _decode_references(
                d, r"(?i)&#x[0-9a-f]+;",
                lambda r: F.conv(F.regexp_extract(r, r"(?i)&#x([0-9a-f]+);", 1), 16, 10)
                .try_cast("bigint"),
            ),
        )

    return let(text, lambda t: F.when(F.contains(t, F.lit("&#")), numbered(t)).otherwise(t))


def unit_text(dialect: str, text: Column, items: Column, rows: Column, caption: Column,
              alt: Column, path: Column) -> Column:
    """Text of a unit: ``id``, ``ledger`` or ``audit`` order of preference."""
    blank = F.lit("")
    if dialect == "id":
        return F.coalesce(non_blank(text), F.to_json(rows), alt, path, blank)
    if dialect == "ledger":
        return F.coalesce(
            text,
            F.array_join(items, "\n"),
            F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ")), "\n"),
            F.concat_ws(" ", non_blank(caption), non_blank(alt)),
        )
    if dialect == "audit":
        return F.coalesce(
            non_blank(text),
            non_blank(F.concat_ws("\n", non_blank(caption), non_blank(alt))),
            F.array_join(F.flatten(rows), "\n"),
            F.array_join(items, "\n"),
            blank,
        )
    raise ValueError(f"unknown dialect {dialect!r}")


def is_substantive(kind: Column, text: Column) -> Column:
    """Non-blank text, an image or a table."""
    return (js_trim(F.coalesce(text, F.lit(""))) != "") | kind.isin("image", "table")


def comparable_value(value: Column, unit: Column, calendar=fixed.CALENDAR_UNITS) -> Column:
    """Finite, not negative, with a unit that is not a calendar unit."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return finite & (value >= 0) & (F.coalesce(unit, F.lit("")) != "") & ~unit.isin(*calendar)


def is_timestamp(value: Column) -> Column:
    """An ISO date, or date and time with an optional offset, that exists."""
    form = (r"^\d{4}-\d{2}-\d{2}"
            r"([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    return value.rlike(form) & F.try_to_timestamp(value).isNotNull()


def is_json(value: Column) -> Column:
    return F.try_parse_json(value).isNotNull()


