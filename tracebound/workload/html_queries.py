"""Pages: tags, structure, safety and provenance attributes; trees; verbatim reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.operators import ledger, reuse, rules, tree
from tracebound.workload import frames as B
from tracebound.workload import sql as S
from tracebound.workload.registry import query

_LEAVES = ",".join(f"'{t}'" for t in (*fixed.VOID_TAGS, *fixed.OPTIONAL_CLOSE_TAGS))

_TAGS = f"""stream AS (
  SELECT page_id, generate_subscripts(t,1)-1 AS pos, unnest(t) AS raw FROM (
    SELECT page_id, regexp_extract_all({S.no_scripts('html')}, '</?[A-Za-z][^<>]*>') AS t FROM pages)),
steps AS (SELECT *, lower(regexp_extract(raw, '^</?([A-Za-z][A-Za-z0-9-]*)', 1)) AS tag,
  starts_with(raw, '</') AS closing FROM stream),
levels AS (SELECT *, sum(step) OVER (PARTITION BY page_id ORDER BY pos) AS after_ FROM (
  SELECT *, CASE WHEN tag IN ({_LEAVES}) OR raw LIKE '%/>' THEN 0 WHEN closing THEN -1 ELSE 1 END
    AS step FROM steps)),
lv AS (SELECT *, CASE WHEN step > 0 THEN after_-1 ELSE after_ END AS level FROM levels),
tags AS (SELECT page_id, pos, tag, raw, greatest(0, level)::BIGINT AS depth, CASE WHEN step=0 THEN pos
    ELSE (SELECT min(n.pos) FROM lv n WHERE n.page_id=l.page_id AND n.pos > l.pos AND n.step <> 0
      AND n.after_ <= l.level) END AS end_pos
  FROM lv l WHERE NOT closing)"""


def _tags(spark, folder):
    return tree.tag_tree(B.table(spark, folder, "pages").select("page_id", "html"))


@query("w11_tag_tree", f"WITH {_TAGS} SELECT page_id, pos, tag, depth, end_pos FROM tags")
def _(spark, folder):
    return _tags(spark, folder).drop("raw")


@query("j17_nearest_ancestor_value", f"""WITH {_TAGS},
o AS (SELECT page_id, pos, end_pos, depth, regexp_extract(raw,
  '(?i)\\b(?:lang|class)\\s*=\\s*["'']([^"'']+)["'']', 1) AS value FROM tags),
own AS (SELECT * FROM o WHERE value <> '')
SELECT page_id, pos, tag, coalesce(
  (SELECT arg_max(value, own.pos) FROM own WHERE own.page_id=t.page_id AND t.pos > own.pos
    AND (own.end_pos IS NULL OR t.pos < own.end_pos)),
  (SELECT arg_min(value, own.pos) FROM own WHERE own.page_id=t.page_id AND own.pos > t.pos
    AND (t.end_pos IS NULL OR own.pos < t.end_pos))) AS value FROM tags t""")
def _(spark, folder):
    return tree.nearest_ancestor_value(_tags(spark, folder), "(?:lang|class)")


@query("f05_statically_visible", f"""WITH {_TAGS},
h AS (SELECT page_id, pos, end_pos FROM tags WHERE tag IN ('nav','div'))
SELECT page_id, pos, tag FROM tags t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.page_id=t.page_id
  AND (t.pos=h.pos OR (t.pos > h.pos AND (h.end_pos IS NULL OR t.pos < h.end_pos))))""")
def _(spark, folder):
    # The pages hide nothing, so the rule here hides navigation and boxes.
    hidden = F.col("tag").isin("nav", "div")
    return tree.statically_visible(_tags(spark, folder), hidden).select("page_id", "pos", "tag")


_SHINGLES = _TAGS + """,
seq AS (SELECT page_id, pos, depth||':'||tag||':' AS sig FROM tags),
tri AS (SELECT DISTINCT page_id, shingle FROM (SELECT page_id, sig||'>'||lead(sig) OVER w||'>'
  ||lead(sig, 2) OVER w AS shingle FROM seq WINDOW w AS (PARTITION BY page_id ORDER BY pos))
  WHERE shingle IS NOT NULL)"""


def _shingles(spark, folder):
    return reuse.trigrams(
        tree.tag_signature(_tags(spark, folder)), "page_id", "pos", "signature")


@query("w12_trigrams", f"WITH {_SHINGLES} SELECT page_id, shingle FROM tri")
def _(spark, folder):
    return _shingles(spark, folder)


@query("j12_near_duplicates", f"""WITH {_SHINGLES},
p AS (SELECT page_id, list_sort(list(shingle)) AS s FROM tri GROUP BY page_id),
d AS (SELECT s, count(*) AS members, min(page_id) AS item FROM p GROUP BY s),
x AS (SELECT a.item AS item_a, b.item AS item_b, a.members AS members_a, b.members AS members_b,
    len(list_intersect(a.s, b.s))::BIGINT AS shared, len(a.s)+len(b.s) AS total
  FROM d a JOIN d b ON a.item < b.item)
SELECT item_a, item_b, members_a, members_b, shared,
  round(shared::DOUBLE/(total-shared), 6) AS similarity FROM x
WHERE shared::DOUBLE/(total-shared) > 0.85""")
def _(spark, folder):
    sets = reuse.structure_sets(_shingles(spark, folder), "page_id")
    return reuse.near_duplicates(sets).withColumn("similarity", F.round("similarity", 6))


@query("j12_members", f"""WITH {_SHINGLES},
p AS (SELECT page_id, list_sort(list(shingle)) AS s FROM tri GROUP BY page_id),
a AS (SELECT DISTINCT page_id, coalesce(s, []) AS s FROM pages LEFT JOIN p USING (page_id))
SELECT page_id, min(page_id) OVER w AS first_item, count(*) OVER w AS members FROM a
WINDOW w AS (PARTITION BY s)""")
def _(spark, folder):
    return reuse.set_members(
        _shingles(spark, folder), "page_id", B.table(spark, folder, "pages")).drop("set_id")


@query("a12_duplicate_structures", f"""WITH {_SHINGLES},
p AS (SELECT page_id, list_sort(list(shingle)) AS s FROM tri GROUP BY page_id)
SELECT min(page_id) AS first_item, count(*) AS members FROM p GROUP BY s HAVING count(*) > 1""")
def _(spark, folder):
    sets = reuse.structure_sets(_shingles(spark, folder), "page_id")
    return sets.filter("members > 1").select("first_item", "members")


# --- verbatim reuse ------------------------------------------------------------------


_FLAT = f"regexp_replace(text, '[{S.WS}]+', '', 'g')"


@query("j10_verbatim_exposure", f"""
WITH p AS (SELECT DISTINCT {_FLAT} AS passage FROM benchmark WHERE length({_FLAT}) >= 60),
d AS (SELECT doc_id, {_FLAT} AS text FROM documents),
h AS (SELECT doc_id, count(*) AS passages, sum(length(passage))::BIGINT AS matched_chars,
    any_value(length(text)) AS page_chars FROM d, p WHERE contains(text, passage) GROUP BY doc_id)
SELECT *, CASE WHEN matched_chars/page_chars > 0.45 THEN 'error'
  WHEN matched_chars/page_chars > 0.30 THEN 'warning' END AS severity,
  round(matched_chars/page_chars, 6) AS share FROM h""")
def _(spark, folder):
    docs = B.table(spark, folder, "documents").select("doc_id", "text")
    facts = B.table(spark, folder, "benchmark").select(F.col("text").alias("raw_text"))
    return reuse.verbatim_exposure(docs, facts).withColumn("share", F.round("share", 6))


@query("j11_protected_fragment_leaks", f"""
WITH f AS (SELECT DISTINCT {S.trim('f')} AS f FROM (
    SELECT unnest(regexp_extract_all(text, '[^.!?]+[.!?]?')) AS f FROM benchmark)
  WHERE length({S.trim('f')}) >= 16)
SELECT doc_id, sha256(f) AS fragment_id FROM documents, f WHERE contains(text, f)""")
def _(spark, folder):
    docs = B.table(spark, folder, "documents").select("doc_id", "text")
    sentences = B.table(spark, folder, "benchmark").select(
        F.explode(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]?"), F.lit(0))).alias("fragment"))
    return reuse.protected_fragment_leaks(docs, sentences)


@query("a12_duplicates", """
SELECT text_sha, count(*) AS n FROM (SELECT sha256(text) AS text_sha FROM documents)
GROUP BY text_sha HAVING count(*) > 1""")
def _(spark, folder):
    docs = B.table(spark, folder, "documents").select(F.sha2("text", 256).alias("text_sha"))
    return reuse.duplicates(docs, ["text_sha"])


_REPEATED = f"""{S.UNITS},
r AS (SELECT source_id, {S.rationale('text')} AS text FROM units),
k AS (SELECT text, count(*) AS n FROM r WHERE text <> '' GROUP BY text HAVING count(*) >= 3)"""


@query("a13_repeated_text", f"WITH {_REPEATED} SELECT sha256(text) AS text_sha, text, n FROM k")
def _(spark, folder):
    return reuse.repeated_text(B.text_units(spark, folder), "text")


@query("a13_repeated_text_members", f"""WITH {_REPEATED}
SELECT source_id, sha256(text) AS text_sha, n FROM r JOIN k USING (text)""")
def _(spark, folder):
    return reuse.repeated_text_members(B.text_units(spark, folder), ["source_id"], "text")


@query("a15_must_differ", f"""
WITH g AS (SELECT source, lang, sha256(text) AS sha, count(*) AS n FROM documents GROUP BY ALL
  HAVING count(*) > 1)
SELECT {S.issue("'shared-text'", "source||'/'||lang", 'count(*)')} FROM g GROUP BY source, lang""")
def _(spark, folder):
    docs = B.table(spark, folder, "documents").select(
        "source", "lang", F.sha2("text", 256).alias("sha"))
    return reuse.must_differ(docs, ["source", "lang"], "sha", "shared-text")


# --- safety and provenance --------------------------------------------------------------


#: A hit and a near miss of every rule, one per page in turn.
_SNIPPETS = (
    'fetch ("x")', 'prefetch("x")', "new  Function(a)", "evaluate(a)", "import( 'https://x')",
    "import('./x')", "@import  http://x/a.css", "url(data:x)", "<img alt=a src='https://x/a.png'>",
    "<img src='/a.png'>", "color:#ff00aa", "rgb (1,2,3)", "page #12", "hsl of it",
)
_SNIPPET_SQL = "CASE page_id%14 " + " ".join(
    f"WHEN {k} THEN '{x.replace(chr(39), chr(39) * 2)}'" for k, x in enumerate(_SNIPPETS)) + " END"


def _unsafe_sql() -> str:
    parts = []
    for code, pattern in fixed.UNSAFE_CONTENT_RULES:
        kind = fixed.UNSAFE_CONTENT_KINDS.get(code)
        parts.append(
            f"SELECT {S.issue(chr(39) + code + chr(39), 'page_id')} FROM files WHERE regexp_matches(text, "
            f"'{pattern.replace(chr(39), chr(39) * 2)}')" + (f" AND kind='{kind}'" if kind else ""))
    return (f"WITH files AS (SELECT page_id, html||{_SNIPPET_SQL} AS text, CASE page_id%3 WHEN 0 THEN 'css' "
            "WHEN 1 THEN 'js' ELSE 'html' END AS kind FROM pages) " + " UNION ALL ".join(parts))


@query("f03_unsafe_content", _unsafe_sql())
def _(spark, folder):
    snippet = F.element_at(
        F.array(*[F.lit(x) for x in _SNIPPETS]), (F.col("page_id") % 14 + 1).cast("int"))
    files = B.table(spark, folder, "pages").select(
        "page_id", F.concat("html", snippet).alias("text"),
        F.when(F.col("page_id") % 3 == 0, "css").when(F.col("page_id") % 3 == 1, "js")
        .otherwise("html").alias("kind"))
    return rules.unsafe_content(files, "page_id", "text", "kind")


@query("f04_external_resources", """
SELECT DISTINCT page_id, unnest(regexp_extract_all(replace(html, 'href="/', 'href="https://x.example/'),
  '(?i)(?:src|href)\\s*=\\s*["''](https?://[^"'']+)', 1)) AS url FROM pages""")
def _(spark, folder):
    pages = B.table(spark, folder, "pages").select(
        "page_id",
        F.replace("html", F.lit('href="/'), F.lit('href="https://x.example/')).alias("html"))
    return rules.external_resources(pages, "page_id", "html")


_MANIFEST = " UNION ALL ".join(
    f"""SELECT page_id, '{a}' AS kind, unnest(regexp_extract_all(html,
      '(?i)\\b{a}\\s*=\\s*["'']([^"'']+)["'']', 1)) AS value FROM pages""" for a in ("href", "class", "lang"))


@query("a22_identity_manifest", f"SELECT DISTINCT page_id, kind, value FROM ({_MANIFEST})")
def _(spark, folder):
    pages = B.table(spark, folder, "pages")
    return ledger.identity_manifest(pages, "page_id", "html", ["href", "class", "lang"])


@query("a12_repeated_identities", f"""
SELECT page_id, kind, value, count(*) AS n FROM ({_MANIFEST}) GROUP BY ALL HAVING count(*) > 1""")
def _(spark, folder):
    pages = B.table(spark, folder, "pages")
    return ledger.repeated_identities(pages, "page_id", "html", ["href", "class", "lang"])


def _editable(spark, folder):
    html = F.col("html")
    for old, new in (('<a href="/e', '<a data-source-ref="s" data-edit-id="/e'),
                     ('<a href="', '<a data-edit-id="'), ("a</a>", "a1</a>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    return B.table(spark, folder, "pages").select("page_id", html.alias("html"))


@query("q03_numeric_without_source", f"""
WITH p AS (SELECT page_id, replace(replace(replace(html, '<a href="/e',
    '<a data-source-ref="s" data-edit-id="/e'), '<a href="', '<a data-edit-id="'), 'a</a>', 'a1</a>')
    AS html FROM pages),
e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bdata-edit-id[\\s\\S]*?</a>')) AS e
  FROM p)
SELECT {S.issue("'numeric-without-source'", 'page_id', '''regexp_extract(e,
  'data-edit-id="([^"]+)"', 1)''')} FROM e
WHERE regexp_matches(regexp_replace(e, '<[^>]+>', ' ', 'g'), '\\d')
  AND NOT regexp_matches(e, '^<[^>]*data-source-ref')""")
def _(spark, folder):
    return rules.numeric_without_source(_editable(spark, folder), "page_id", "html")


@query("q04_derived_without_formula", f"""
SELECT {S.issue("'derived-without-formula'", 'page_id', "'box'")} FROM pages
WHERE page_id%2=1 AND contains(html, '<div class="ad">')""")
def _(spark, folder):
    formula = F.when(F.col("page_id") % 2 == 0, ' data-formula="a+b"').otherwise("")
    tag = F.concat(F.lit('<div data-derived="true" data-edit-id="box"'), formula, F.lit(">"))
    pages = B.table(spark, folder, "pages").select(
        "page_id", F.replace("html", F.lit('<div class="ad">'), tag).alias("html"))
    return rules.derived_without_formula(pages, "page_id", "html")


def _payload(json: str) -> str:
    return f'<script data-chart-data-for="c1">{json}</script>'


# Of two payloads the first counts.
@query("q05_charts_without_data", f"""
SELECT {S.issue("'source-missing'", "page_id||'/c1'")} FROM pages WHERE page_id%5=0
UNION ALL SELECT {S.issue("'payload-missing'", "page_id||'/c1'")} FROM pages WHERE page_id%3=2
UNION ALL SELECT {S.issue("'payload-invalid'", "page_id||'/c1'")} FROM pages WHERE page_id%3=1""")
def _(spark, folder):
    source = F.when(F.col("page_id") % 5 != 0, ' data-source-ref="s"').otherwise("")
    payload = (
        F.when(F.col("page_id") % 3 == 0, _payload('{"a":[1]}') + _payload('{"a":[1'))
        .when(F.col("page_id") % 3 == 1, _payload('{"a":[1') + _payload("[]"))
        .otherwise(""))
    chart = F.concat(payload, F.lit('<div data-chart-id="c1"'), source, F.lit(">"))
    pages = B.table(spark, folder, "pages").select(
        "page_id", F.replace("html", F.lit('<div class="ad">'), chart).alias("html"))
    return rules.charts_without_data(*rules.page_charts(pages, "page_id", "html"))


# --- trees --------------------------------------------------------------------------------


_FLAT_TREE = S.NODES + """,
flat AS (
  SELECT doc, node_id, parent_id, 0::BIGINT AS depth,
    '8'||lpad(hex(ord), 15, '0')||':'||hex(node_id) AS path, [node_id] AS up FROM nodes
  WHERE parent_id IS NULL
  UNION ALL SELECT n.doc, n.node_id, n.parent_id, f.depth+1,
    f.path||'.'||'8'||lpad(hex(n.ord), 15, '0')||':'||hex(n.node_id), list_append(f.up, n.node_id)
  FROM flat f JOIN nodes n ON n.parent_id=f.node_id AND n.doc=f.doc),
below AS (SELECT r.doc, r.node_id AS root_id, r.depth, d.node_id
  FROM (SELECT doc, node_id, unnest(up) AS a FROM flat) d JOIN flat r ON r.doc=d.doc AND r.node_id=d.a)"""


@query("n01_flatten_tree",
       f"WITH RECURSIVE {_FLAT_TREE} SELECT doc, node_id, parent_id, depth, path FROM flat")
def _(spark, folder):
    return tree.flatten_tree(B.segment_nodes(spark, folder), ["doc"]).drop("ancestors")


@query("n01_tree_intervals", f"""WITH RECURSIVE {_FLAT_TREE},
sizes AS (SELECT doc, root_id, count(*) AS size FROM below GROUP BY doc, root_id)
SELECT doc, node_id, parent_id, depth, enter, enter + size - 1 AS leave
FROM (SELECT doc, node_id, parent_id, depth, row_number() OVER (PARTITION BY doc ORDER BY path) - 1 AS enter FROM flat) f
JOIN sizes s USING (doc) WHERE s.root_id = f.node_id""")
def _(spark, folder):
    return tree.tree_intervals(B.segment_nodes(spark, folder), ["doc"])


@query("n02_subtree_intervals", f"""WITH RECURSIVE {_FLAT_TREE}
SELECT doc, root_id, node_id FROM below""")
def _(spark, folder):
    intervals = tree.tree_intervals(B.segment_nodes(spark, folder), ["doc"])
    return tree.subtree_intervals(intervals, intervals, ["doc"])


@query("n02_subtree", f"""WITH RECURSIVE {_FLAT_TREE}
SELECT doc, root_id, node_id FROM below WHERE depth <= 1""")
def _(spark, folder):
    flat = tree.flatten_tree(B.segment_nodes(spark, folder), ["doc"])
    return tree.subtree(flat, flat.filter("depth <= 1"), ["doc"])


@query("n02_subtree_refs", f"""WITH RECURSIVE {_FLAT_TREE}
SELECT DISTINCT doc, root_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS source_id FROM below
JOIN orders ON node_id='o'||o_orderkey WHERE depth = 0""")
def _(spark, folder):
    flat = tree.flatten_tree(B.segment_nodes(spark, folder), ["doc"])
    refs = B.table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"), "o_custkey",
        F.col("o_orderdate").cast("date").cast("string").alias("source_id"))
    refs = refs.join(
        B.table(spark, folder, "customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("doc")),
        "o_custkey").select("doc", "node_id", "source_id")
    return tree.subtree_refs(tree.subtree(flat, flat.filter("depth = 0"), ["doc"]), refs, ["doc"])
