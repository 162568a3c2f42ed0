"""Building blocks of the DuckDB statements."""

from __future__ import annotations

from tracebound.functions import fixed
from tracebound.functions.lets import one_of

WS_CHARS = fixed.WS_CHARS
WS = fixed.WS


def trim(x: str) -> str:
    return f"trim({x}, '{WS_CHARS}')"


def collapse(x: str) -> str:
    return trim(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def decode(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


def strip_tags(x: str) -> str:
    return collapse(decode(f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"))


def no_scripts(x: str) -> str:
    for tag in ("script", "style"):
        x = f"regexp_replace({x}, '(?i)<{tag}\\b[^>]*>[\\s\\S]*?</{tag}>', '', 'g')"
    return x


def lines(x: str) -> str:
    return (
        f"list_filter(list_transform(regexp_split_to_array({x}, '\\r?\\n'), "
        f"lambda x: {trim('x')}), lambda x: x <> '')"
    )


def stable_id(prefix: str, *parts: str) -> str:
    joined = "||chr(0)||".join(f"({p})::VARCHAR" for p in parts)
    return f"'{prefix}-'||substr(sha256({joined}),1,16)"


def tokens(x: str, dialect: str) -> str:
    if dialect == "analysis":
        return (
            f"regexp_extract_all(regexp_replace({x},'([%‰])','\\1 ','g'), "
            "'(?:^|[^\\p{L}\\p{N}])([-+]?\\d+(?:[.,]\\d+)*(?:%|‰)?)', 1)"
        )
    found = f"regexp_extract_all({x}, '{fixed.NUMERIC_PATTERNS[dialect]}')"
    if dialect == "editorial":
        return f"list_transform({found}, lambda t: replace(t, ',', ''))"
    return found


def number_form(t: str, dialect: str) -> str:
    plain = f"replace({t}, ',', '')"
    if dialect == "audit":
        return f"lower({plain})"
    if dialect == "preflight":
        return f"regexp_replace({plain}, '{fixed.PREFLIGHT_UNIT_SUFFIX}', '')"
    if dialect == "bare":
        return f"nullif(regexp_extract({plain}, '{fixed.LEADING_NUMBER}'), '')"
    return plain


def numbers(x: str, dialect: str) -> str:
    pattern = {"audit": "ledger"}.get(dialect, dialect)
    return (
        f"list_filter(list_transform({tokens(x, pattern)}, lambda t: {number_form('t', dialect)}), "
        "lambda t: t IS NOT NULL)"
    )


def terms(x: str, words) -> str:
    return f"regexp_extract_all({x}, '{one_of(words)}')"


def rationale(x: str) -> str:
    flat = f"regexp_replace(lower({trim(x)}), '[{WS}]+', ' ', 'g')"
    return f"translate({flat}, '{fixed.RATIONALE_PUNCTUATION}', '')"


def issue(code: str, subject: str, detail: str = "NULL", severity: str = "error") -> str:
    return (
        f"'{severity}' AS severity, {code} AS code, CAST({subject} AS VARCHAR) AS subject_id, "
        f"CAST({detail} AS VARCHAR) AS detail"
    )


UNITS = f"""units AS (
  SELECT doc_id, lang, source, ord, text,
         {stable_id('src', 'doc_id', 'ord', "'paragraph'", 'text')} AS source_id
  FROM (SELECT doc_id, lang, source, unnest(l) AS text, generate_subscripts(l,1)-1 AS ord
        FROM (SELECT doc_id, lang, source, {lines('text')} AS l FROM documents)))"""

TYPED = UNITS + f""",
typed AS (
  SELECT doc_id, lang, source, source_id, ord, text AS line,
    CASE ord%4 WHEN 0 THEN 'image' WHEN 1 THEN 'chart' WHEN 2 THEN 'table'
      ELSE 'paragraph' END AS type,
    CASE WHEN ord%4 = 3 THEN text END AS text,
    (ord%4 = 2 OR (ord%4 = 1 AND contains(text, '.'))) AS has_rows,
    CASE WHEN ord%4 = 0 AND contains(text, ',')
      THEN 'assets/'||doc_id||'-'||ord||'.png' END AS asset_path,
    CASE WHEN ord%4 = 0 THEN text END AS alt,
    CASE WHEN ord%4 <> 3 THEN lang END AS caption,
    length(text) < 15 AS fallback
  FROM units)"""

MARKDOWN = f"""md AS (
  SELECT doc_id, i, {trim('line')} AS line FROM (
    SELECT doc_id, generate_subscripts(l,1)-1 AS i, unnest(l) AS line FROM (
      SELECT doc_id, regexp_split_to_array(array_to_string(list_transform({lines('text')},
        lambda x, i: CASE (i-1)%8 WHEN 0 THEN '## '||x WHEN 3 THEN '- '||x WHEN 4 THEN '1. '||x
          WHEN 5 THEN '| '||lang||' | '||x||' |' WHEN 6 THEN '| --- | --- |' WHEN 7 THEN ''
          ELSE x END), chr(10)), '\\r?\\n') AS l
      FROM documents)))"""

MARKDOWN_BLOCKS = MARKDOWN + rf""",
kinds AS (
  SELECT *, CASE WHEN regexp_matches(line, '^(#{{1,6}})[{WS}]+(.+)$') THEN 'heading'
      WHEN regexp_matches(line, '^([-*+] |\d+[.)] )(.+)$') THEN 'list'
      WHEN regexp_matches(line, '^\|.*\|$') THEN 'table'
      WHEN line = '' THEN 'blank' ELSE 'paragraph' END AS kind FROM md),
starts AS (
  SELECT *, CASE WHEN kind IN ('paragraph','table')
      AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) IS NOT DISTINCT FROM kind
      THEN 0 ELSE 1 END AS s FROM kinds),
blocks AS (
  SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM starts),
cells AS (
  SELECT doc_id, block, i,
    list_transform(string_split(regexp_replace(line, '^\||\|$', '', 'g'), '|'),
      lambda c: {trim('c')}) AS cs
  FROM blocks WHERE kind = 'table' AND NOT regexp_matches(
    regexp_replace(regexp_replace(line, '\|[{WS}]*$', ''), '^\|', ''), '^\|?[{WS}]*:?-{{3,}}'))"""

HTML_TABLES = f"""tables AS (
  SELECT page_id, generate_subscripts(t,1)-1 AS table_no, unnest(t) AS tbl FROM (
    SELECT page_id, regexp_extract_all({no_scripts(
        "replace(replace(replace(replace(html,'<ul>','<table><tr>'),'</ul>','</tr></table>'),"
        "'<li>','<td>'),'</li>','</td>')")}, '(?i)<table\\b[\\s\\S]*?</table>') AS t FROM pages)),
trs AS (
  SELECT page_id, table_no, generate_subscripts(r,1)-1 AS row_idx, unnest(r) AS tr FROM (
    SELECT page_id, table_no, regexp_extract_all(tbl, '{fixed.HTML_ROW}') AS r FROM tables)),
tds AS (
  SELECT page_id, table_no, row_idx, generate_subscripts(c,1)-1 AS col_idx, unnest(c) AS td FROM (
    SELECT page_id, table_no, row_idx, regexp_extract_all(tr, '{fixed.HTML_CELL}') AS c FROM trs))"""

PAGE_UNITS = f"""page_units AS (
  SELECT page_id, ord, CASE WHEN regexp_matches(b, '(?i)^<h[1-6]') THEN 'heading'
      ELSE 'paragraph' END AS type,
    try_cast(nullif(regexp_extract(b, '(?i)^<h([1-6])', 1), '') AS INTEGER) AS level,
    {strip_tags('b')} AS text
  FROM (SELECT page_id, generate_subscripts(l,1)-1 AS ord, unnest(l) AS b FROM (
    SELECT page_id, regexp_extract_all({no_scripts('html')}, '{fixed.HTML_BLOCK}') AS l
    FROM pages)))"""

ORDER_LINES = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey, l_quantity, l_extendedprice, l_linestatus) AS rn FROM lineitem)"""

CLAIMS = ORDER_LINES + """,
src AS (
  SELECT l_orderkey||'-'||rn AS source_id,
    CASE WHEN l_linestatus='F' THEN 'about ' ELSE '' END||'qty '||l_quantity::DECIMAL(15,2)
      ||' price '||l_extendedprice::DECIMAL(15,2) AS text FROM ranked),
parts AS (SELECT *, l_orderkey + ((rn-1)//8)*1000000000000 AS claim_id FROM ranked),
claims AS (
  SELECT claim_id, CASE WHEN claim_id%3 <> 0 THEN 'about ' ELSE '' END
    ||string_agg((l_quantity::DECIMAL(15,2))::VARCHAR, ' and ' ORDER BY rn) AS text
  FROM parts GROUP BY claim_id),
refs AS (
  SELECT claim_id, l_orderkey||'-'||rn AS source_id FROM parts
  WHERE (rn-1)%8 <> 1 OR claim_id%5 <> 0)"""

PARSED_CELL = (
    f"nullif(regexp_extract({trim('cell')}, '{fixed.NUMERIC_CELL}', 1), '')"
)

CELLS = f"""pc AS (
  SELECT p_brand AS dataset_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)-1
    AS row_idx, [p_partkey::VARCHAR, p_name, p_size||' cm', (p_retailprice::DECIMAL(15,2))::VARCHAR]
    AS cs FROM part),
cells AS (
  SELECT dataset_id, row_idx, generate_subscripts(cs,1)-1 AS col_idx, unnest(cs) AS cell FROM pc),
typed_cells AS (
  SELECT *, {PARSED_CELL} AS num,
    {trim(f"regexp_extract({trim('cell')}, '{fixed.NUMERIC_CELL}', 2)")} AS unit,
    {trim('cell')} <> '' AND {PARSED_CELL} IS NULL AS is_text FROM cells)"""

SERIES = """series AS (
  SELECT o_orderstatus AS dataset_id, strftime(o_orderdate, '%Y-%m') AS x,
    o_orderpriority AS series, sum(o_totalprice::DECIMAL(15,2))::DOUBLE AS value,
    year(o_orderdate)*12+month(o_orderdate) AS x_idx
  FROM orders GROUP BY ALL)"""

PATCHES = """patches AS (
  SELECT user_id||'/'||day AS project_id, seq, event_type, k, k%8 AS node, changed_at,
    CASE event_type WHEN 'view' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'patch' END AS op,
    (seq-1)//2 - CASE WHEN k%7=0 THEN 1 ELSE 0 END AS base_revision
  FROM (SELECT *, ts::DATE AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS changed_at,
      json_extract_string(props, '$.k')::BIGINT AS k,
      row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS seq
    FROM events))"""

VERSIONS = """versions AS (
  SELECT o_orderkey AS version_id, o_custkey AS variant_id, o_orderdate AS created_at,
    sha256((o_totalprice::DECIMAL(15,2))::VARCHAR) AS sha256,
    CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'publishing' ELSE 'failed' END
      AS status,
    CASE WHEN o_orderkey%3=0 THEN 'public' ELSE 'local' END AS target
  FROM orders)"""

SNAPSHOTS = """before_ AS (SELECT doc_id, text, lang, source FROM documents),
after_ AS (
  SELECT doc_id, CASE WHEN doc_id%7=0 THEN text||'!' ELSE text END AS text, lang, source
  FROM documents WHERE doc_id%11 <> 0
  UNION ALL SELECT doc_id+1000000, text, lang, source FROM documents WHERE doc_id%13=0)"""

NODES = """nodes AS (
  SELECT DISTINCT c_mktsegment AS doc, 'n'||c_nationkey AS node_id, NULL::VARCHAR AS parent_id,
    n_regionkey::BIGINT AS ord FROM customer JOIN nation ON n_nationkey=c_nationkey
  UNION ALL SELECT c_mktsegment, 'c'||c_custkey, 'n'||c_nationkey, c_custkey%3+12345678900 FROM customer
  UNION ALL SELECT c_mktsegment, 'o'||o_orderkey, 'c'||c_custkey, o_orderkey+12345678900
  FROM orders JOIN customer ON o_custkey=c_custkey)"""

ASSESSMENTS = """assessments AS (
  SELECT doc_id AS source_id, 'assets/'||doc_id AS asset_path, CASE WHEN doc_id%7=0 THEN 'brief' ELSE text END AS description,
    CASE WHEN doc_id%5=0 THEN ' because ' ELSE text END AS rationale,
    CASE lang WHEN 'en' THEN 'evidence' WHEN 'de' THEN 'context' WHEN 'fr' THEN 'decorative'
      ELSE 'unknown' END AS content_role,
    CASE WHEN coalesce(toxic,0)=1 THEN 'high' ELSE 'low' END AS information_loss,
    CASE WHEN coalesce(quality,0)=1 THEN 'high' ELSE 'low' END AS value,
    CASE n_chars%3 WHEN 0 THEN 'omit' WHEN 1 THEN 'redraw' ELSE 'use-original' END AS treatment,
    CASE WHEN n_chars%2=0 THEN source ELSE '' END AS source_binding
  FROM documents LEFT JOIN labels USING (doc_id))"""


def fingerprint(rows: str, group: str, name: str, digest: str) -> str:
    """The two-level hash tree over ``rows(group, name, digest)``."""
    line = f"{name}||chr(0)||{digest}||chr(0)||n"
    return f"""
counted AS (SELECT {group}, {name}, {digest}, count(*) AS n FROM {rows} GROUP BY ALL),
leaves AS (SELECT {group}, n, sha256({line}) AS d FROM counted),
buckets AS (SELECT {group}, substr(d,1,4) AS b, sha256(string_agg(d, '' ORDER BY d)) AS d,
  sum(n) AS n FROM leaves GROUP BY {group}, substr(d,1,4)),
digests AS (SELECT {group}, sha256(string_agg(d, '' ORDER BY b)) AS sha256,
  sum(n)::BIGINT AS rows FROM buckets GROUP BY {group})"""
