"""Readers and scalar functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracebound.functions import fixed, html as H, text as T
from tracebound.functions.lets import one_of
from tracebound.operators import ledger
from tracebound.sources import registry as R
from tracebound.sources import units as U
from tracebound.workload import frames as B
from tracebound.workload import sql as S
from tracebound.workload.registry import query


def big(column, name=None):
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint").alias(name or column)


# --- sources -----------------------------------------------------------------


@query("s01_plain_units", f"WITH {S.UNITS} SELECT doc_id, ord, source_id, text FROM units")
def _(spark, folder):
    return B.text_units(spark, folder).select("doc_id", "ord", "source_id", "text")


@query("s02_markdown_units", rf"""WITH {S.MARKDOWN_BLOCKS},
grouped AS (
  SELECT doc_id, block, min(i) AS first_i, kind, string_agg(line, ' ' ORDER BY i) AS line
  FROM blocks WHERE kind <> 'blank' GROUP BY doc_id, block, kind),
tabled AS (
  SELECT doc_id, block, string_agg(array_to_string(cs,'|'), chr(10) ORDER BY i) AS body
  FROM cells GROUP BY doc_id, block)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_i)-1 AS ord, kind AS type,
  CASE WHEN kind='heading' THEN length(regexp_extract(line, '^(#+)', 1)) END::BIGINT AS level,
  CASE kind WHEN 'heading' THEN regexp_extract(line, '^(#{{1,6}})[{S.WS}]+(.+)$', 2)
    WHEN 'list' THEN regexp_extract(line, '^([-*+] |\d+[.)] )(.+)$', 2)
    WHEN 'table' THEN body ELSE line END AS content,
  CASE WHEN kind='list' THEN regexp_matches(line, '^\d') END AS ordered
FROM grouped LEFT JOIN tabled USING (doc_id, block) WHERE kind <> 'table' OR body IS NOT NULL""")
def _(spark, folder):
    units = U.read_markdown_units(B.markdown_docs(spark, folder))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")
    return units.select(
        "doc_id", "ord", "type", big("level"), F.coalesce("text", rows).alias("content"), "ordered"
    )


@query("s03_html_units",
       f"WITH {S.PAGE_UNITS} SELECT page_id, ord, type, level::BIGINT AS level, text FROM page_units")
def _(spark, folder):
    return B.page_units(spark, folder).select("page_id", "ord", "type", big("level"), "text")


_VISIBLE_SQL = f"""array_to_string(list_filter(list_transform(regexp_split_to_array({S.decode(
    "regexp_replace(regexp_replace(" + S.no_scripts('html') + ", '" + fixed.HTML_BREAK_TAG
    + "', chr(10), 'g'), '<[^>]+>', '', 'g')")}, '\\r?\\n'), lambda x: {S.collapse('x')}),
  lambda x: x <> ''), chr(10))"""


@query("s04_html_visible_text", f"SELECT page_id, {_VISIBLE_SQL} AS text FROM pages")
def _(spark, folder):
    pages = B.table(spark, folder, "pages")
    return pages.select("page_id", H.visible_text(F.col("html")).alias("text"))


@query("s05_decode_entities", "SELECT doc_id, text FROM documents")
def _(spark, folder):
    # Encode the five named entities and some letters as numeric references, then decode.
    text = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"),
                         ("'", "&apos;"), ("é", "&#233;"), ("ü", "&#xFC;"), ("e", "&#x65;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    docs = B.table(spark, folder, "documents")
    return docs.select("doc_id", T.decode_entities(text).alias("text"))


@query("s06_pipe_tables", f"""WITH {S.MARKDOWN_BLOCKS}
SELECT doc_id, table_no, row_idx, generate_subscripts(cs,1)-1 AS col_idx, unnest(cs) AS cell
FROM (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY block)-1 AS table_no,
  row_number() OVER (PARTITION BY doc_id, block ORDER BY i)-1 AS row_idx FROM cells)""")
def _(spark, folder):
    tables = U.read_pipe_tables(B.markdown_docs(spark, folder))
    return U.explode_rows(tables, ["doc_id", "table_no"])


@query("s07_html_tables", f"""WITH {S.HTML_TABLES}
SELECT page_id, table_no, row_idx, col_idx, {S.strip_tags('td')} AS cell FROM tds""")
def _(spark, folder):
    tables = U.read_html_tables(B.html_table_pages(spark, folder))
    return U.explode_rows(tables, ["page_id", "table_no"])


@query("s08_classify_media", """
WITH p AS (SELECT source||'/'||doc_id||CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.HTML'
  WHEN 'fr' THEN '.txt' ELSE '.bin' END AS path, lang FROM documents)
SELECT path, CASE lang WHEN 'en' THEN 'text/markdown' WHEN 'de' THEN 'text/html'
  WHEN 'fr' THEN 'text/plain' END AS media_type,
  CASE WHEN lang NOT IN ('en','de','fr') THEN 'unsupported-format' END AS code FROM p""")
def _(spark, folder):
    ending = (
        F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "de", ".HTML")
        .when(F.col("lang") == "fr", ".txt").otherwise(".bin")
    )
    files = B.table(spark, folder, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"))
    return R.classify_media(files)


@query("s09_register_sources", """
SELECT source||'/'||doc_id AS name, strlen(text) AS size, sha256(text) AS sha256 FROM documents""")
def _(spark, folder):
    docs = B.table(spark, folder, "documents")
    return R.register_contents(
        docs, F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("text"))


_JSON_ROWS = "'[[\"lang\",\"line\"],['||to_json(lang)||','||to_json(line)||']]'"


@query("s11_extraction_warnings", f"""WITH {S.TYPED}
SELECT source_id, 'missing-target' AS code FROM typed WHERE type='image' AND asset_path IS NULL
UNION ALL SELECT source_id, 'no-cached-data' FROM typed WHERE type='chart' AND NOT has_rows
UNION ALL SELECT source_id, 'fallback-used' FROM typed WHERE fallback""")
def _(spark, folder):
    return R.extraction_warnings(B.typed_units(spark, folder))


@query("s13_asset_inventory", f"""WITH {S.TYPED}
SELECT source_id, asset_path, alt, caption FROM typed WHERE type='image'""")
def _(spark, folder):
    return R.asset_inventory(B.typed_units(spark, folder))


# --- scalar functions -----------------------------------------------------------


_HEADED = """CASE WHEN ord=0 THEN text||'报告' WHEN ord%4=1 THEN '二、'||text
  WHEN ord%4=2 THEN '（三）'||text ELSE text END"""


@query("p01_normalize_headings", f"""WITH {S.UNITS},
h AS (SELECT doc_id, ord, {_HEADED} AS text, count(*) OVER (PARTITION BY doc_id) AS n FROM units)
SELECT doc_id, ord, text, CASE WHEN level IS NULL THEN 'paragraph' ELSE 'heading' END AS type,
  level FROM (SELECT *, CASE WHEN regexp_matches(text, '^[一二三四五六七八九十百]+、\\S') THEN 1
    WHEN regexp_matches(text, '^（[一二三四五六七八九十百]+）\\S') THEN 2
    WHEN ord=0 AND n>1 AND length(text)<=80 AND text LIKE '%报告' THEN 0 END::BIGINT AS level
  FROM h)""")
def _(spark, folder):
    text = (
        F.when(F.col("ord") == 0, F.concat("text", F.lit("报告")))
        .when(F.col("ord") % 4 == 1, F.concat(F.lit("二、"), "text"))
        .when(F.col("ord") % 4 == 2, F.concat(F.lit("（三）"), "text"))
        .otherwise(F.col("text"))
    )
    docs = B.table(spark, folder, "documents").select("doc_id", "text")
    units = ledger.normalize_headings(
        U.read_plain_units(docs, count="units").withColumn("text", text), count="units")
    return units.select("doc_id", "ord", "text", "type", big("level"))


@query("p02_unit_text", f"""WITH {S.TYPED}
SELECT source_id,
  coalesce(text, CASE WHEN has_rows THEN {_JSON_ROWS} END, alt, asset_path, '') AS id_text,
  coalesce(text, CASE WHEN has_rows THEN 'lang | line'||chr(10)||lang||' | '||line END,
    concat_ws(' ', nullif(caption,''), nullif(alt,''))) AS ledger_text,
  coalesce(nullif(text,''), nullif(concat_ws(chr(10), nullif(caption,''), nullif(alt,'')),''), '')
    AS audit_text FROM typed""")
def _(spark, folder):
    args = [F.col(c) for c in ("text", "items", "rows", "caption", "alt", "asset_path")]
    return B.typed_units(spark, folder).select(
        "source_id", *[T.unit_text(d, *args).alias(f"{d}_text") for d in ("id", "ledger", "audit")])


@query("p03_is_substantive", f"""WITH {S.TYPED}
SELECT source_id, type IN ('image','table') OR has_rows OR trim(coalesce(text,'')) <> ''
  AS substantive FROM typed""")
def _(spark, folder):
    return ledger.mark_substantive(B.typed_units(spark, folder)).select("source_id", "substantive")


@query("p04_stable_id", f"""
SELECT page_id, {S.stable_id('doc', 'page_id', 'url')} AS stable_id FROM pages""")
def _(spark, folder):
    pages = B.table(spark, folder, "pages")
    return pages.select(
        "page_id", T.stable_id("doc", F.col("page_id"), F.col("url")).alias("stable_id"))


_DIALECTS = ("analysis", "editorial", "ledger", "preflight", "bare")


@query("p05_numeric_tokens", " UNION ALL ".join(
    f"""SELECT doc_id, '{d}' AS dialect, generate_subscripts(t,1)-1 AS pos, unnest(t) AS token
    FROM (SELECT doc_id, {S.tokens('text', d)} AS t FROM documents)""" for d in _DIALECTS))
def _(spark, folder):
    docs = B.table(spark, folder, "documents")
    found = F.array(*[
        F.struct(F.lit(d).alias("dialect"), T.numeric_tokens(F.col("text"), d).alias("tokens"))
        for d in _DIALECTS])
    return docs.select("doc_id", F.explode(found).alias("f")).select(
        "doc_id", "f.dialect", F.posexplode("f.tokens").alias("pos", "token")
    ).withColumn("pos", big("pos"))


@query("p06_normalize_number", f"""
SELECT doc_id, token, {S.number_form('token','editorial')} AS editorial,
  {S.number_form('token','audit')} AS audit, {S.number_form('token','preflight')} AS preflight,
  {S.number_form('token','bare')} AS bare
FROM (SELECT doc_id, unnest({S.tokens('text','ledger')}) AS token FROM documents)""")
def _(spark, folder):
    docs = B.table(spark, folder, "documents")
    rows = docs.select("doc_id", F.explode(T.numeric_tokens(F.col("text"), "ledger")).alias("token"))
    return rows.select(
        "doc_id", "token",
        *[T.normalize_number(F.col("token"), d).alias(d)
          for d in ("editorial", "audit", "preflight", "bare")])


@query("p07_qualification_tokens", f"""WITH {S.UNITS}
SELECT source_id, len(q)::BIGINT AS n, array_to_string(q, '|') AS tokens
FROM (SELECT source_id, {S.terms('text', B.TEST_TERMS)} AS q FROM units)""")
def _(spark, folder):
    q = T.qualification_tokens(F.col("text"), B.TEST_TERMS)
    return B.text_units(spark, folder).select(
        "source_id", big(F.size(q), "n"), F.array_join(q, "|").alias("tokens"))


@query("p08_protected_tokens", f"""WITH {S.UNITS}
SELECT source_id, array_to_string(
  regexp_extract_all(text, '(?i){one_of(B.TEST_TERMS)}'), '|') AS tokens FROM units""")
def _(spark, folder):
    return B.text_units(spark, folder).select(
        "source_id",
        F.array_join(T.protected_tokens(F.col("text"), B.TEST_TERMS), "|").alias("tokens"))


_CJK = "translate(text, 'aeiou', '数据来源可')"


@query("p09_lexical_terms", f"""WITH {S.UNITS},
c AS (SELECT source_id, lower({_CJK}) AS t FROM units),
w AS (SELECT source_id, unnest(regexp_extract_all(t, '[a-z0-9]{{3,}}')) AS term FROM c
  UNION ALL SELECT source_id, unnest(list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))
  FROM (SELECT source_id, unnest(regexp_extract_all(t, '{fixed.CJK_RUN}')) AS r FROM c))
SELECT DISTINCT source_id, term FROM w""")
def _(spark, folder):
    text = F.translate("text", "aeiou", "数据来源可")
    return B.text_units(spark, folder).select(
        "source_id", F.explode(T.lexical_terms(text)).alias("term"))


@query("p10_normalize_ws", f"""
SELECT doc_id, sha256(regexp_replace(text, '[{S.WS}]+', '', 'g')) AS sha256,
  length(regexp_replace(text, '[{S.WS}]+', '', 'g')) AS n_chars FROM documents""")
def _(spark, folder):
    flat = T.normalize_ws(F.col("text"))
    return B.table(spark, folder, "documents").select(
        "doc_id", F.sha2(flat, 256).alias("sha256"), big(F.length(flat), "n_chars"))


@query("p11_normalize_rationale",
       f"WITH {S.UNITS} SELECT source_id, {S.rationale('text')} AS rationale FROM units")
def _(spark, folder):
    return B.text_units(spark, folder).select(
        "source_id", T.normalize_rationale(F.col("text")).alias("rationale"))


@query("p12_cjk_length", f"""
SELECT doc_id, len(regexp_extract_all({_CJK}, '{fixed.CJK_CHAR}'))::BIGINT AS cjk,
  len(regexp_extract_all({_CJK}, '{fixed.CJK_CHAR}')) > 600 AS too_long FROM documents""")
def _(spark, folder):
    n = T.cjk_length(F.translate("text", "aeiou", "数据来源可"))
    return B.table(spark, folder, "documents").select(
        "doc_id", n.alias("cjk"), (n > fixed.BLOCK_MAX_CJK).alias("too_long"))


@query("p13_char_count", """
SELECT doc_id, (length(text) + length(text) - length(replace(text,'a','')))::BIGINT AS chars
FROM documents""")
def _(spark, folder):
    emoji = F.replace(F.col("text"), F.lit("a"), F.lit("😀"))
    return B.table(spark, folder, "documents").select(
        "doc_id", T.utf16_length(emoji).alias("chars"))


@query("p14_parse_numeric_cell", f"""WITH {S.CELLS}
SELECT dataset_id, row_idx, col_idx, cell, replace(num, ',', '')::DOUBLE AS value,
  CASE WHEN num IS NOT NULL THEN unit END AS unit FROM typed_cells""")
def _(spark, folder):
    num = T.parse_numeric_cell(F.col("cell"))
    return B.part_cells(spark, folder).select(
        "dataset_id", "row_idx", "col_idx", "cell", num["value"].alias("value"),
        num["unit"].alias("unit"))


@query("p15_unit_from_label", f"""WITH {S.UNITS}
SELECT source_id, regexp_extract(text, '{one_of(fixed.LABEL_UNITS)}') AS unit FROM units""")
def _(spark, folder):
    return B.text_units(spark, folder).select(
        "source_id", T.unit_from_label(F.col("text")).alias("unit"))


@query("p16_split_sentences", f"""WITH {S.UNITS}
SELECT source_id, generate_subscripts(s,1)-1 AS pos, unnest(s) AS sentence
FROM (SELECT source_id, regexp_extract_all(text, '[^.!?]+[.!?]?') AS s FROM units)""")
def _(spark, folder):
    return B.text_units(spark, folder).select(
        "source_id", F.posexplode(T.split_sentences(F.col("text"), ".!?")).alias("pos", "sentence")
    ).withColumn("pos", big("pos"))


RULES = (
    ("german", "opening", r"(?:\bder\b|\bdie\b|\bund\b)"),
    ("spanish", "text", r"^(?:El|La|Los|Que)\b"),
    ("english", "opening", r"\bthe\b.*\bof\b"),
    ("french", "text", r"\bdans\b"),
)


@query("p17_classify_by_rules", f"""WITH {S.UNITS}
SELECT source_id, CASE WHEN regexp_matches(substr(text,1,48), '{RULES[0][2]}') THEN 'german'
  WHEN regexp_matches(text, '{RULES[1][2]}') THEN 'spanish'
  WHEN regexp_matches(substr(text,1,48), '{RULES[2][2]}') THEN 'english'
  WHEN regexp_matches(text, '{RULES[3][2]}') THEN 'french' END AS label FROM units""")
def _(spark, folder):
    return B.text_units(spark, folder).select(
        "source_id", T.classify_by_rules(F.col("text"), RULES).alias("label"))


@query("p18_extract_attribute", """
SELECT page_id, generate_subscripts(v,1)-1 AS pos, unnest(v) AS value FROM (
  SELECT page_id, regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1) AS v
  FROM pages)""")
def _(spark, folder):
    return B.table(spark, folder, "pages").select(
        "page_id", F.posexplode(H.extract_attribute(F.col("html"), "href")).alias("pos", "value")
    ).withColumn("pos", big("pos"))


@query("p19_classify_resource", """
SELECT page_id, 'page' AS origin, url AS resource, CASE WHEN regexp_matches(url, '(?i)^(?:https?:)?//')
  THEN 'remote' WHEN starts_with(url,'data:') THEN 'data' WHEN starts_with(url,'#') THEN 'fragment'
  ELSE 'local' END AS kind FROM pages
UNION ALL SELECT page_id, 'link', v, CASE WHEN regexp_matches(v, '(?i)^(?:https?:)?//')
  THEN 'remote' WHEN starts_with(v,'data:') THEN 'data' WHEN starts_with(v,'#') THEN 'fragment'
  ELSE 'local' END FROM (SELECT page_id, unnest(
    regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']([^"'']+)["'']', 1)) AS v FROM pages)""")
def _(spark, folder):
    pages = B.table(spark, folder, "pages")
    urls = F.concat(
        F.array(F.struct(F.lit("page").alias("origin"), F.col("url").alias("resource"))),
        F.transform(
            H.extract_attribute(F.col("html"), "href"),
            lambda v: F.struct(F.lit("link").alias("origin"), v.alias("resource"))),
    )
    return pages.select("page_id", F.explode(urls).alias("u")).select(
        "page_id", "u.origin", "u.resource",
        H.classify_resource(F.col("u.resource")).alias("kind"))


@query("p20_row_digest", """
SELECT c_custkey, sha256('{"acctbal":"'||c_acctbal::DECIMAL(15,2)||'","mktsegment":"'||c_mktsegment
  ||'","name":"'||c_name||'","nation":'||c_nationkey||'}') AS sha256 FROM customer""")
def _(spark, folder):
    rows = B.table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        B.money("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    return rows.select(
        "c_custkey", T.row_digest("name", "nation", "acctbal", "mktsegment").alias("sha256"))


@query("p21_is_safe_id", f"""
SELECT 'url' AS kind, url AS value, regexp_matches(url, '{fixed.SAFE_ID}') AS safe FROM pages
UNION ALL SELECT 'brand', p_brand, regexp_matches(p_brand, '{fixed.SAFE_ID}') FROM part
UNION ALL SELECT 'source', source||':'||doc_id, regexp_matches(source||':'||doc_id,
  '{fixed.SAFE_ID}') FROM documents""")
def _(spark, folder):
    parts = (
        B.table(spark, folder, "pages").select(F.lit("url").alias("kind"), F.col("url").alias("value")),
        B.table(spark, folder, "part").select(F.lit("brand"), "p_brand"),
        B.table(spark, folder, "documents").select(
            F.lit("source"), F.concat_ws(":", "source", F.col("doc_id").cast("string"))),
    )
    rows = parts[0].union(parts[1]).union(parts[2])
    return rows.select("kind", "value", T.is_safe_id(F.col("value")).alias("safe"))


# --- ledger -----------------------------------------------------------------------


@query("f01_substantive_ledger", f"""WITH {S.TYPED},
l AS (SELECT *, coalesce(text, CASE WHEN has_rows THEN 'lang | line'||chr(10)||lang||' | '||line END,
    concat_ws(' ', nullif(caption,''), nullif(alt,''))) AS raw_text FROM typed
  WHERE type IN ('image','table') OR has_rows OR trim(coalesce(text,'')) <> '')
SELECT 'fact-'||substr(source_id,5) AS fact_id, source_id, doc_id::VARCHAR AS document, ord,
  type AS kind, raw_text, array_to_string({S.tokens('raw_text','ledger')},'|') AS numeric_tokens,
  array_to_string({S.terms('raw_text', B.TEST_TERMS)},'|') AS qualifications FROM l""")
def _(spark, folder):
    units = ledger.mark_substantive(B.typed_units(spark, folder))
    facts = ledger.fact_ledger(units, terms=B.TEST_TERMS)
    return facts.withColumns({
        c: F.array_join(c, "|") for c in ("numeric_tokens", "qualifications")})


@query("s10_source_pack", f"""WITH {S.TYPED},
sub AS (SELECT *, type IN ('image','table') OR has_rows OR trim(coalesce(text,'')) <> ''
  AS substantive FROM typed),
l AS (SELECT *, coalesce(text, CASE WHEN has_rows THEN 'lang | line'||chr(10)||lang||' | '||line END,
    concat_ws(' ', nullif(caption,''), nullif(alt,''))) AS raw_text FROM sub WHERE substantive),
w AS (SELECT source_id, 'missing-target' AS code FROM typed WHERE type='image' AND asset_path IS NULL
  UNION ALL SELECT source_id, 'no-cached-data' FROM typed WHERE type='chart' AND NOT has_rows
  UNION ALL SELECT source_id, 'fallback-used' FROM typed WHERE fallback),
pack AS (
  SELECT 'readable-source' AS part, '' AS name, sha256(to_json({{'name': doc_id::VARCHAR,
    'text': text}})::VARCHAR) AS digest FROM documents
  UNION ALL SELECT 'fact-ledger', '', sha256(to_json({{'document': doc_id::VARCHAR,
    'fact_id': 'fact-'||substr(source_id,5), 'kind': type,
    'numeric_tokens': {S.tokens('raw_text','ledger')}, 'ord': ord,
    'qualifications': {S.terms('raw_text', B.TEST_TERMS)}, 'raw_text': raw_text,
    'source_id': source_id}})::VARCHAR) FROM l
  UNION ALL SELECT 'source-map', '', sha256(to_json({{'doc_id': doc_id, 'ord': ord,
    'source_id': source_id, 'substantive': substantive, 'type': type}})::VARCHAR) FROM sub
  UNION ALL SELECT 'tables-and-datasets', '', sha256(to_json({{'caption': coalesce(caption,''),
    'rows': CASE WHEN has_rows THEN to_json([['lang','line'],[lang,line]])::VARCHAR END,
    'source_id': source_id, 'type': type}})::VARCHAR) FROM sub WHERE type IN ('table','chart')
  UNION ALL SELECT 'extraction-warnings', '', sha256(to_json({{'code': code,
    'source_id': source_id}})::VARCHAR) FROM w),
{S.fingerprint('pack', 'part', 'name', 'digest')}
SELECT part, sha256, rows FROM digests""")
def _(spark, folder):
    docs = B.table(spark, folder, "documents")
    units = ledger.mark_substantive(B.typed_units(spark, folder))
    parts = ledger.source_pack(docs, units, R.extraction_warnings(units), B.TEST_TERMS)
    return ledger.pack_manifest(parts)


@query("u01_compile_facts", f"""WITH {S.TYPED}
SELECT {S.stable_id('fact', "'v1'", "'claim'", 'source_id')} AS fact_id, 'claim' AS type,
  source_id AS node_id, text AS content, NULL AS unit FROM typed
  WHERE type='paragraph' AND trim(coalesce(text,'')) <> ''
UNION ALL SELECT {S.stable_id('fact', "'v1'", "'metric'", 'source_id', 'length(line)%3')},
  'metric', source_id, length(line)::VARCHAR, lang FROM typed WHERE has_rows
UNION ALL SELECT {S.stable_id('fact', "'v1'", "'evidence'", 'source_id')}, 'evidence', source_id,
  type, NULL FROM typed WHERE type IN ('table','image')""")
def _(spark, folder):
    units = B.typed_units(spark, folder)
    nodes = units.select(
        F.col("source_id").alias("node_id"), "type",
        F.lit(None).cast("string").alias("original_type"), "text")
    line = F.element_at(F.element_at("rows", 2), 2)
    metrics = units.filter(F.col("rows").isNotNull()).select(
        F.col("source_id").alias("node_id"), (F.length(line) % 3).alias("idx"),
        F.length(line).alias("value"), F.col("lang").alias("unit"), F.lit("").alias("label"))
    return ledger.compile_facts(nodes, metrics, "v1")
