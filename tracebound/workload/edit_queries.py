"""Document structure, edit logs, versions and publications."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracebound.functions.text import js_trim, split_lines
from tracebound.operators import edits, sections, tree
from tracebound.sources.units import line_islands
from tracebound.workload import frames as B
from tracebound.workload import sql as S
from tracebound.workload.audit_queries import OVERRIDES_SQL, overrides
from tracebound.workload.registry import query
from tracebound.workload.text_queries import RULES

# --- structure --------------------------------------------------------------------


@query("w01_assign_sections", f"""WITH {S.PAGE_UNITS},
h AS (SELECT *, max(CASE WHEN type='heading' THEN ord END) OVER (PARTITION BY page_id ORDER BY ord)
  AS section_ord FROM page_units)
SELECT h.page_id, h.ord, h.section_ord, coalesce(nullif(t.text,''), h.page_id::VARCHAR) AS section_title
FROM h LEFT JOIN page_units t ON t.page_id=h.page_id AND t.ord=h.section_ord""")
def _(spark, folder):
    return sections.assign_sections(B.page_units(spark, folder), "page_id").select(
        "page_id", "ord", "section_ord", "section_title")


@query("w02_line_islands", f"""WITH {S.MARKDOWN_BLOCKS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY block)-1 AS block, kind, n_lines
FROM (SELECT doc_id, block, any_value(kind) AS kind, count(*) AS n_lines FROM blocks
  WHERE kind <> 'blank' GROUP BY doc_id, block)""")
def _(spark, folder):
    lines = F.transform(split_lines(F.col("text")), js_trim)
    return B.markdown_docs(spark, folder).select(
        "doc_id", F.posexplode(line_islands(lines)).alias("block", "b")
    ).select("doc_id", F.col("block").cast("bigint").alias("block"), "b.kind",
             F.size("b.lines").cast("bigint").alias("n_lines"))


@query("w03_following_text", f"""WITH {S.TYPED}
SELECT source_id, type, coalesce(CASE WHEN lead(type) OVER w = 'paragraph' THEN lead(text) OVER w END, '')
  AS following_text FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY ord)""")
def _(spark, folder):
    return sections.following_text(B.typed_units(spark, folder)).select(
        "source_id", "type", "following_text")


@query("w03_describe_images", f"""WITH {S.TYPED},
f AS (SELECT *, coalesce(CASE WHEN lead(type) OVER w = 'paragraph' THEN lead(text) OVER w END, '')
  AS following_text FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
SELECT source_id, CASE WHEN hit THEN 'evidenceWarning' ELSE type END AS type,
  CASE WHEN hit THEN type END AS original_type FROM (SELECT *, type='image' AND regexp_matches(
    coalesce(alt,'')||' '||coalesce(caption,'')||' '||following_text, '(?i)tion|ein') AS hit FROM f)""")
def _(spark, folder):
    units = sections.following_text(B.typed_units(spark, folder))
    return sections.describe_images(units, "(?i)tion|ein").select(
        "source_id", "type", "original_type")


def _case(t: str) -> str:
    tests = [
        f"WHEN regexp_matches({f'substr({t},1,48)' if where == 'opening' else t}, '{pattern}') "
        f"THEN '{label}'"
        for label, where, pattern in RULES
    ]
    return "CASE " + " ".join(tests) + " END"


@query("w04_carry_label", f"""WITH RECURSIVE u AS (
  SELECT conv_id, turn AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text,
    regexp_extract_all(text, '[^.!?]+[.!?]?') AS s FROM conversations),
d AS (SELECT conv_id, ord, n, text, s, {_case(S.trim('text'))} AS w,
  list_transform(s, lambda x: {_case(S.trim('x'))}) AS d FROM u),
r AS (
  SELECT conv_id, 0::BIGINT AS n, NULL::BIGINT AS ord, '' AS text, []::VARCHAR[] AS s,
    []::VARCHAR[] AS labels, false AS split, NULL::VARCHAR AS w, 'none' AS before_, 'none' AS label
    FROM u WHERE n=1
  UNION ALL
  SELECT conv_id, n, ord, text, s, labels, split, w, before_,
    CASE WHEN split THEN labels[-1] ELSE coalesce(w, before_) END FROM (
    SELECT *, len(s) >= 2 AND len(list_distinct(labels)) > 1 AS split FROM (
      SELECT d.conv_id, d.n, d.ord, d.text, d.s, d.w, r.label AS before_,
        list_transform(range(1, len(d.s)+1), lambda i: coalesce(
          list_filter(d.d[1:i], lambda x: x IS NOT NULL)[-1], r.label)) AS labels
      FROM r JOIN d ON d.conv_id=r.conv_id AND d.n=r.n+1)))
SELECT conv_id, ord, 0::BIGINT AS sentence_no, text AS sentence, label FROM r WHERE n > 0 AND NOT split
UNION ALL SELECT conv_id, ord, generate_subscripts(s,1)-1, unnest(s), unnest(labels) FROM r WHERE split""")
def _(spark, folder):
    turns = B.table(spark, folder, "conversations").select(
        "conv_id", F.col("turn").alias("ord"), "text")
    return sections.carry_label(turns, "conv_id", RULES, "none", ".!?")


@query("w09_marker_run", f"""WITH {S.UNITS},
s AS (SELECT doc_id, min(ord) AS start_ FROM units WHERE length(text) < 20 GROUP BY doc_id),
a AS (SELECT u.* FROM units u JOIN s USING (doc_id) WHERE ord > start_),
b AS (SELECT doc_id, min(ord) AS stop_ FROM a WHERE NOT contains(text, ',') GROUP BY doc_id)
SELECT doc_id, ord, text FROM a LEFT JOIN b USING (doc_id) WHERE stop_ IS NULL OR ord < stop_""")
def _(spark, folder):
    units = B.text_units(spark, folder).select("doc_id", "ord", "text")
    return sections.marker_run(
        units, "doc_id", "ord", F.length("text") < 20, F.contains(F.col("text"), F.lit(",")))


@query("a20_repeated_entities", """
WITH d AS (SELECT conv_id//5 AS grp, conv_id, count(DISTINCT role) AS labels FROM conversations
  GROUP BY 1,2)
SELECT grp, count(*) AS entities FROM d GROUP BY grp HAVING count(*) >= 4 AND min(labels) >= 2""")
def _(spark, folder):
    turns = B.table(spark, folder, "conversations").select(
        F.floor(F.col("conv_id") / 5).alias("grp"), "conv_id", F.col("role").alias("label"))
    return sections.repeated_entities(turns, turns, "grp", "conv_id", min_dimensions=2)


@query("a21_dimension_matrix", """
SELECT conv_id, label, label_rank, position, turn, text, source_id,
  turn = min(turn) OVER (PARTITION BY conv_id, label, source_id) AS first_ref
FROM (SELECT conv_id, role AS label, CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 END::BIGINT
    AS label_rank, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS position, turn, text,
    turn//4 AS source_id FROM conversations) WHERE label_rank IS NOT NULL""")
def _(spark, folder):
    turns = B.table(spark, folder, "conversations").select(
        "conv_id", "turn", F.col("role").alias("label"), "text",
        F.floor(F.col("turn") / 4).alias("source_id"))
    return sections.dimension_matrix(turns, "conv_id", "turn", ("assistant", "user"))


# --- edit logs ----------------------------------------------------------------------


@query("t01_apply_patches", f"""WITH RECURSIVE {S.PATCHES},
r AS (
  SELECT project_id, seq, base_revision, base_revision=0 AS accepted,
    (base_revision=0)::BIGINT AS revision FROM patches WHERE seq=1
  UNION ALL SELECT p.project_id, p.seq, p.base_revision, p.base_revision=r.revision,
    r.revision + (p.base_revision=r.revision)::BIGINT
  FROM r JOIN patches p ON p.project_id=r.project_id AND p.seq=r.seq+1)
SELECT * FROM r""")
def _(spark, folder):
    return edits.apply_patches(B.patch_log(spark, folder), ["project_id"])


_REPLAY = f"""{S.PATCHES},
z AS (
  SELECT project_id, 0::BIGINT AS seq, 'none' AS op, false AS effective, 0::BIGINT AS cursor_,
    0::BIGINT AS length, 0::BIGINT AS revision FROM patches WHERE seq=1
  UNION ALL SELECT p.project_id, p.seq, p.op,
    p.op='patch' OR (p.op='undo' AND cursor_ > 0) OR (p.op='redo' AND cursor_ < length),
    CASE WHEN p.op='patch' THEN cursor_+1 WHEN p.op='undo' THEN greatest(cursor_-1, 0)
      ELSE least(cursor_+1, length) END,
    CASE WHEN p.op='patch' THEN cursor_+1 ELSE length END,
    revision + (p.op='patch' OR (p.op='undo' AND cursor_ > 0) OR (p.op='redo' AND cursor_ < length))::BIGINT
  FROM z JOIN patches p ON p.project_id=z.project_id AND p.seq=z.seq+1)"""


@query("t02_replay", f"""WITH RECURSIVE {_REPLAY}
SELECT project_id, seq, op, effective, cursor_ AS "cursor", length, revision FROM z WHERE seq > 0""")
def _(spark, folder):
    return edits.replay(B.patch_log(spark, folder), ["project_id"])


@query("t02_applied_patches", f"""WITH RECURSIVE {_REPLAY},
e AS (SELECT project_id, arg_max(cursor_, seq) AS last_ FROM z GROUP BY 1),
s AS (SELECT project_id, cursor_ AS slot, max(seq) AS seq FROM z WHERE op='patch' GROUP BY 1,2)
SELECT project_id, slot, seq FROM s JOIN e USING (project_id) WHERE slot <= last_""")
def _(spark, folder):
    replayed = edits.replay(B.patch_log(spark, folder), ["project_id"])
    return edits.applied_patches(replayed, ["project_id"])


@query("t03_coverage_on_delete", f"""WITH RECURSIVE {S.NODES},
up AS (SELECT doc, node_id, node_id AS a FROM nodes
  UNION ALL SELECT u.doc, u.node_id, n.parent_id FROM up u JOIN nodes n ON n.doc=u.doc AND n.node_id=u.a
  WHERE n.parent_id IS NOT NULL),
d AS (SELECT doc, node_id, (ord*7919)%1000003 AS seq FROM nodes
  WHERE (node_id LIKE 'c%' AND substr(node_id,2)::BIGINT%3<>0) OR (node_id LIKE 'o%' AND ord%5=0)),
g AS (SELECT up.doc, up.node_id, min({{'seq': d.seq, 'root': d.node_id}}) AS gone
  FROM up JOIN d ON d.doc=up.doc AND d.node_id=up.a GROUP BY 1,2),
e AS (SELECT DISTINCT n.doc, n.node_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS source_id FROM nodes n JOIN orders ON n.node_id='o'||o_orderkey),
c AS (SELECT e.doc, source_id, count(*) FILTER (gone IS NULL) AS nodes, max(gone) AS last_
  FROM e LEFT JOIN g ON g.doc=e.doc AND g.node_id=e.node_id GROUP BY 1,2)
SELECT doc, source_id, CASE WHEN nodes=0 THEN 'omitted' ELSE 'preserved' END AS status, nodes,
  CASE WHEN nodes=0 THEN 'user deleted report node "'||last_.root||'"' END AS reason FROM c""")
def _(spark, folder):
    nodes = B.segment_nodes(spark, folder)
    number = F.substring("node_id", 2, 20).cast("bigint")
    deleted = nodes.filter(
        (F.col("node_id").startswith("c") & (number % 3 != 0))
        | (F.col("node_id").startswith("o") & (F.col("ord") % 5 == 0))
    ).select("doc", "node_id", (F.col("ord") * 7919 % 1_000_003).alias("seq"))
    clerks = B.table(spark, folder, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id"),
        F.col("o_orderdate").cast("date").cast("string").alias("source_id"))
    refs = nodes.join(clerks, "node_id").select("doc", "node_id", "source_id")
    coverage = refs.select("doc", "source_id").distinct().withColumn("status", F.lit("preserved"))
    return edits.coverage_on_delete(
        coverage, refs, deleted, tree.flatten_tree(nodes, ["doc"]), ["doc"])


@query("t04_write_once", f"""WITH {S.PATCHES},
r AS (SELECT project_id AS subject, event_type AS stage, seq, sha256((k%3)::VARCHAR) AS digest FROM patches),
f AS (SELECT subject, stage, min(seq) AS first_, arg_min(digest, seq) AS kept FROM r GROUP BY 1,2)
SELECT subject, stage, seq, digest, CASE WHEN seq=first_ THEN 'written' WHEN digest=kept
  THEN 'unchanged' ELSE 'conflict' END AS outcome FROM r JOIN f USING (subject, stage)""")
def _(spark, folder):
    receipts = B.patch_log(spark, folder).select(
        F.col("project_id").alias("subject"), F.col("event_type").alias("stage"), "seq",
        F.sha2((F.col("k") % 3).cast("string"), 256).alias("digest"))
    return edits.write_once(receipts, ["subject", "stage"])


@query("t05_upsert_publications", f"""WITH {S.VERSIONS}
SELECT variant_id AS publication_id, max(version_id) AS seq, arg_max(status, version_id) AS status,
  arg_max(target, version_id) AS target FROM versions GROUP BY 1""")
def _(spark, folder):
    log = B.version_log(spark, folder).select(
        F.col("variant_id").alias("publication_id"), F.col("version_id").alias("seq"), "status",
        "target")
    return edits.upsert_publications(log)


@query("w10_last_write_wins", f"""WITH {OVERRIDES_SQL}
SELECT node_id, field, max(seq) AS seq, arg_max(value, seq) AS value,
  arg_max(changed_at, seq) AS changed_at, 'user-override' AS provenance
FROM overrides WHERE field <> 'shape' AND provenance='user-override' GROUP BY 1,2""")
def _(spark, folder):
    return edits.last_write_wins(overrides(spark, folder))


# --- versions -------------------------------------------------------------------------


@query("w06_version_parents", f"""WITH {S.VERSIONS}
SELECT version_id, variant_id, lag(version_id) OVER (PARTITION BY variant_id
  ORDER BY created_at, version_id) AS parent_version_id FROM versions""")
def _(spark, folder):
    return edits.version_parents(B.version_log(spark, folder)).select(
        "version_id", "variant_id", "parent_version_id")


@query("w07_delete_versions", f"""WITH RECURSIVE {S.VERSIONS},
p AS (SELECT version_id, variant_id, lag(version_id) OVER (PARTITION BY variant_id
  ORDER BY created_at, version_id) AS parent FROM versions),
c AS (SELECT version_id, variant_id, parent FROM p WHERE version_id%4 <> 0
  UNION ALL SELECT c.version_id, c.variant_id, p.parent FROM c JOIN p ON p.version_id=c.parent
  WHERE p.version_id%4 = 0)
SELECT version_id, variant_id, parent AS parent_version_id FROM c
WHERE parent IS NULL OR parent%4 <> 0""")
def _(spark, folder):
    versions = edits.version_parents(B.version_log(spark, folder)).select(
        "version_id", "variant_id", "parent_version_id")
    return edits.delete_versions(versions, versions.filter(F.col("version_id") % 4 == 0))


@query("w08_latest_publication", f"""WITH {S.VERSIONS}
SELECT variant_id AS version_id, arg_max(version_id, created_at::VARCHAR||lpad(version_id::VARCHAR,12,'0'))
  AS publication_id FROM versions WHERE target='local' AND status='published' GROUP BY 1""")
def _(spark, folder):
    publications = B.version_log(spark, folder).select(
        F.col("variant_id"), F.col("version_id").alias("publication_id"), "created_at", "target",
        "status").withColumnRenamed("variant_id", "version_id")
    return edits.latest_publication(publications).select("version_id", "publication_id")


@query("w13_dirty_flag", f"""WITH {S.VERSIONS},
l AS (SELECT variant_id, arg_max(version_id, created_at::VARCHAR||lpad(version_id::VARCHAR,12,'0'))
    AS latest_version_id, arg_max(sha256, created_at::VARCHAR||lpad(version_id::VARCHAR,12,'0')) AS saved
  FROM versions GROUP BY 1),
v AS (SELECT c_custkey AS variant_id, CASE WHEN c_custkey%2=0 THEN (SELECT max(sha256) FROM versions
  WHERE versions.variant_id=c_custkey) ELSE '' END AS sha256 FROM customer)
SELECT v.variant_id, latest_version_id, latest_version_id IS NULL OR sha256 <> saved AS dirty
FROM v LEFT JOIN l USING (variant_id)""")
def _(spark, folder):
    versions = B.version_log(spark, folder)
    customer = B.table(spark, folder, "customer").select(F.col("c_custkey").alias("variant_id"))
    largest = versions.groupBy("variant_id").agg(F.max("sha256").alias("sha256"))
    variants = customer.join(largest, "variant_id", "left").withColumn(
        "sha256", F.when(F.col("variant_id") % 2 == 0, F.col("sha256")).otherwise(""))
    return edits.dirty_flag(variants, versions)


@query("o02_list_publications", f"""WITH {S.VERSIONS}
SELECT version_id AS publication_id, status, created_at FROM versions ORDER BY created_at, 1""")
def _(spark, folder):
    publications = B.version_log(spark, folder).select(
        F.col("version_id").alias("publication_id"), "status", "created_at")
    return edits.list_publications(publications)


@query("o03_preferred_order", f"""WITH {S.VERSIONS}
SELECT version_id, status FROM versions ORDER BY CASE status WHEN 'published' THEN 1
  WHEN 'failed' THEN 2 ELSE 3 END, version_id""")
def _(spark, folder):
    versions = B.version_log(spark, folder).select("version_id", "status")
    return edits.preferred_order(versions, "status", ["published", "failed"], "version_id")


@query("s12_publication_records", f"""WITH {S.VERSIONS}
SELECT {S.stable_id('pub', 'version_id', "'local'")} AS publication_id, version_id, variant_id,
  created_at, sha256, 'local' AS target, 'published' AS status FROM versions""")
def _(spark, folder):
    return edits.publication_records(B.version_log(spark, folder))


# --- cells ------------------------------------------------------------------------------


_EDITS = """ed AS (SELECT p_brand AS dataset_id, p_size::BIGINT AS row_idx, p_partkey%5 AS col_idx,
  p_partkey AS seq, 'edited '||p_partkey AS value FROM part)"""


def _edit_inputs(spark, folder):
    changes = B.table(spark, folder, "part").select(
        F.col("p_brand").alias("dataset_id"), F.col("p_size").cast("bigint").alias("row_idx"),
        (F.col("p_partkey") % 5).alias("col_idx"), F.col("p_partkey").alias("seq"),
        F.concat(F.lit("edited "), F.col("p_partkey").cast("string")).alias("value"))
    return B.part_cells(spark, folder), changes


@query("n07_edit_cells", f"""WITH {S.CELLS}, {_EDITS},
w AS (SELECT dataset_id, row_idx, col_idx, arg_max(value, seq) AS value FROM ed GROUP BY 1,2,3)
SELECT c.dataset_id, c.row_idx, c.col_idx, coalesce(w.value, c.cell) AS cell,
  w.value IS NOT NULL AS edited FROM cells c LEFT JOIN w USING (dataset_id, row_idx, col_idx)""")
def _(spark, folder):
    return edits.edit_cells(*_edit_inputs(spark, folder))[0]


@query("n07_rejected_edits", f"""WITH {S.CELLS}, {_EDITS}
SELECT ed.* FROM ed WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.dataset_id=ed.dataset_id
  AND c.row_idx=ed.row_idx AND c.col_idx=ed.col_idx)""")
def _(spark, folder):
    return edits.edit_cells(*_edit_inputs(spark, folder))[1]
