"""All keyed queries on tables where one key or one text holds a third of the rows."""

import duckdb
import pytest
from compare import TABLES, connect, duck_rows, spark_rows

import __spark_entry__ as entry

SKEWED = {
    "documents": """SELECT doc_id, lang,
        CASE WHEN doc_id%3=0 THEN (SELECT text FROM {t} WHERE doc_id=1) ELSE text END AS text,
        CASE WHEN doc_id%3=0 THEN 'src0' ELSE source END AS source,
        CASE WHEN doc_id%3=0 THEN (SELECT n_chars FROM {t} WHERE doc_id=1) ELSE n_chars END AS n_chars
        FROM {t}""",
    "lineitem": """SELECT * REPLACE (CASE WHEN (l_partkey+l_suppkey)%3=0 THEN 7 ELSE l_orderkey END
        AS l_orderkey) FROM {t}""",
    "events": """SELECT * REPLACE (CASE WHEN event_id%3=0 THEN 5 ELSE user_id END AS user_id,
        CASE WHEN event_id%3=0 THEN TIMESTAMP '2024-01-03' + INTERVAL (event_id) SECOND ELSE ts END
        AS ts) FROM {t}""",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey%3=0 THEN 11 ELSE o_custkey END AS o_custkey) FROM {t}",
    "part": "SELECT * REPLACE (CASE WHEN p_partkey%3=0 THEN 'Brand#1' ELSE p_brand END AS p_brand) FROM {t}",
    "pages": """SELECT * REPLACE (CASE WHEN page_id%3=0 THEN (SELECT html FROM {t} WHERE page_id=1)
        ELSE html END AS html) FROM {t}""",
    "conversations": """SELECT CASE WHEN rn%3=0 THEN 1 ELSE conv_id END AS conv_id,
        CASE WHEN rn%3=0 THEN rn+1000 ELSE turn END AS turn, role, text
        FROM (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS rn FROM {t})""",
}
NAMES = (
    "s03_html_units", "f07_dialog_policy", "j01_unknown_references", "j04_unbound_numbers",
    "j05_unsupported_numbers", "j06_dropped_qualifiers", "a23_audit_verdict", "j08_lexical_support",
    "j09_attribute_by_number", "j10_verbatim_exposure", "j11_protected_fragment_leaks",
    "j12_near_duplicates", "j17_nearest_ancestor_value", "a01_coverage_map", "a06_table_series",
    "a08_comparable_groups", "a10_scale_bars", "a12_duplicates", "a13_repeated_text",
    "a13_repeated_text_members", "a14_fingerprint", "a16_coverage_division", "a17_plan_digest",
    "a18_signature", "a21_dimension_matrix", "o01_top_rows", "t01_apply_patches", "t02_replay",
    "t02_applied_patches", "t03_coverage_on_delete", "t04_write_once", "w04_carry_label",
    "w05_order_in_document", "w06_version_parents", "w07_delete_versions", "w10_last_write_wins",
    "w13_dirty_flag", "n07_edit_cells",
)


@pytest.fixture(scope="module")
def skewed(folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        source = f"'{folder}/{name}.parquet'"
        sql = SKEWED.get(name, "SELECT * FROM {t}").format(t=source)
        con.execute(f"COPY ({sql}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_skewed(spark, skewed, name):
    assert spark_rows(entry.queries()[name](spark, skewed)) == duck_rows(
        connect(skewed), entry.oracle_sql()[name])
