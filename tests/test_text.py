"""Column functions on the inputs of the reference's own tests."""

import pytest
from pyspark.sql import functions as F

from tracebound.functions import fixed, html as H, text as T


@pytest.fixture
def one(spark):
    def run(value, fn):
        df = spark.createDataFrame([(value,)], "v string")
        return df.select(fn(F.col("v")).alias("r")).first()[0]

    return run


@pytest.mark.parametrize("dialect, text, expected", [
    ("editorial", "1,234.5 and 42", ["1234.5", "42"]),
    ("ledger", "约 -3,5% 到 189 亿元, 12kW 189.", ["-3,5%", "189", "12kW", "189."]),
    ("ledger", "189亿元", ["189亿元"]),
    ("preflight", "5亿美元 7元", ["5亿美元", "7"]),
    ("bare", "+7,000.5x", ["+7,000.5"]),
    ("analysis", "a1 b 2 +3% x4.5 6.7‰", ["2", "+3%", "5", "6.7‰"]),
])
def test_numeric_dialects(one, dialect, text, expected):
    assert one(text, lambda c: T.numeric_tokens(c, dialect)) == expected


@pytest.mark.parametrize("token, dialect, expected", [
    ("1,200亿元", "audit", "1200亿元"), ("12KW", "audit", "12kw"),
    ("1,200亿元", "preflight", "1200"), ("5%", "preflight", "5"),
    ("+7,000.5,", "bare", "+7000.5"), (".", "bare", None), ("1,0", "editorial", "10"),
])
def test_normalize_number(one, token, dialect, expected):
    assert one(token, lambda c: T.normalize_number(c, dialect)) == expected


def test_tokens_are_text_not_values(one):
    assert one("1.0 1", lambda c: T.comparable_numbers(c, "audit")) == ["1.0", "1"]


def test_qualifiers_and_protected_terms(one):
    assert one("预计达到约 189 亿元", T.qualification_tokens) == ["预计", "约"]
    assert one("取决于 5 KW 的元件", T.protected_tokens) == ["取决于", "KW", "元"]
    assert one("复合增速 复合增长", lambda c: T.qualification_tokens(c, fixed.QUALIFIERS_PREFLIGHT)) == [
        "复合增长"]


def test_lexical_terms(one):
    assert one("The cat, the CAT 数据源 xy", T.lexical_terms) == ["the", "cat", "数据", "据源"]


def test_whitespace_is_unicode(one):
    assert one("　 a \tb ﻿", T.js_trim) == "a \tb"
    assert one("　 a \tb ﻿", T.collapse_ws) == "a b"
    assert one("a　b\n c ", T.normalize_ws) == "abc"


def test_rationale(one):
    assert one("  Same,\n reason。 ", T.normalize_rationale) == "same reason"


def test_lengths(one):
    assert one("a😀", T.utf16_length) == 3
    assert one("数据 ab 源", T.cjk_length) == 3


@pytest.mark.parametrize("cell, expected", [
    ("465 亿美元", (465.0, "亿美元")), ("-1,234.50", (-1234.5, "")), ("12%", (12.0, "%")),
    ("合计", None), ("12 3", None), ("", None), ("1,23", None),
])
def test_numeric_cells(one, cell, expected):
    got = one(cell, T.parse_numeric_cell)
    assert (got and (got["value"], got["unit"])) == expected


def test_entities_in_order(one):
    assert one("&amp;lt; &lt;b&gt; &#65;&#x42; &copy; &#38;#67;", T.decode_entities) == (
        "&lt; <b> AB &copy; &#67;")
    assert one("&#99999999; &#x1F600;", T.decode_entities) == "&#99999999; 😀"


def test_stable_id_is_prefix_of_digest(one):
    import hashlib

    expected = "src-" + hashlib.sha256("n\0" "0\0paragraph\0x".encode()).hexdigest()[:16]
    got = one("x", lambda c: T.stable_id("src", F.lit("n"), F.lit(0), F.lit("paragraph"), c))
    assert got == expected


def test_canonical_json_ignores_order(spark):
    df = spark.createDataFrame([(1, "x", None)], "b int, a string, c string")
    assert df.select(T.canonical_json("b", "c", "a")).first()[0] == '{"a":"x","b":1,"c":null}'
    m = spark.sql("SELECT map('b', 1, 'a', 2) AS m").select(T.canonical_map_json(F.col("m")))
    assert m.first()[0] == '{"a":2,"b":1}'


def test_default_rules(one):
    assert one("我国市场", T.classify_by_rules) == "国内"
    assert one("深圳企业集中", T.classify_by_rules) == "深圳"
    assert one("全球规模", T.classify_by_rules) == "全球"
    assert one("无关", T.classify_by_rules) is None


def test_ascii_word_boundary(one):
    # A letter outside ASCII is no word character.
    assert one("éThe", lambda c: T.classify_by_rules(c, (("x", "text", r"\bThe\b"),))) == "x"


def test_html_text(one):
    page = "<style>p{}</style><h1>Evidence &amp; action</h1><script>1</script><p>Revenue  42</p>"
    assert one(page, H.visible_text) == "Evidence & action\nRevenue 42"


def test_resources(one):
    for url, kind in (("https://x", "remote"), ("//x", "remote"), ("data:a", "data"),
                      ("#a", "fragment"), ("a.png", "local")):
        assert one(url, H.classify_resource) == kind


def test_timestamps_and_json(one):
    assert one("2024-01-05T10:00:00Z", T.is_timestamp) and not one("yesterday", T.is_timestamp)
    assert one("2024-02-29", T.is_timestamp) and one("2024-01-05 10:00:00", T.is_timestamp)
    for bad in ("10:00", "2023-02-29", "2024-13-01", "2024", "Jan 5, 2024", ""):
        assert not one(bad, T.is_timestamp)
    assert one('{"a":[1]}', T.is_json) and not one("{a", T.is_json)


def test_safe_id(one):
    assert one("a.B-9:_x", T.is_safe_id) and not one("a b", T.is_safe_id)
    assert not one("a\n", T.is_safe_id)


def test_unit_text_dialects(spark):
    df = spark.sql("""SELECT * FROM VALUES
      (CAST(NULL AS STRING), CAST(NULL AS ARRAY<STRING>), array(array('a','b'), array('c','d')), 'cap', 'alt', 'p'),
      ('t', NULL, NULL, NULL, NULL, NULL), (NULL, array('x','y'), NULL, NULL, NULL, NULL)
      AS t(text, items, rows, caption, alt, path)""")
    cols = [F.col(c) for c in ("text", "items", "rows", "caption", "alt", "path")]
    got = df.select(*[T.unit_text(d, *cols) for d in ("id", "ledger", "audit")]).collect()
    assert tuple(got[0]) == ('[["a","b"],["c","d"]]', "a | b\nc | d", "cap\nalt")
    assert tuple(got[1]) == ("t", "t", "t")
    assert tuple(got[2])[1:] == ("x\ny", "x\ny")


def test_whitespace_set_is_exact(one):
    assert one("a\u0085 ﻿ b", T.collapse_ws) == "a\u0085 b"
    assert one("a﻿　 b", T.normalize_ws) == "ab"
    assert one("﻿ x\u0085", T.js_trim) == "x\u0085"
