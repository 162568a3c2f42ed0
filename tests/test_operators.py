"""Operators on small frames: a valid input passes, one change must be reported."""

import random

import pytest
from pyspark.sql import functions as F

from tracebound.operators import audit, edits, issues, ledger, reuse, rules, sections, snapshot
from tracebound.operators import tables, tree
from tracebound.sources import registry, units as U


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


# --- readers ---------------------------------------------------------------------


MARKDOWN = "# Evidence\nRevenue 42\nand more\n\n- a\n2) b\n| k | v |\n| --- | :--: |\n| x | 42 |\n\n|-|\nend"


def test_markdown(spark):
    docs = spark.createDataFrame([(1, MARKDOWN)], "doc_id int, text string")
    got = U.read_markdown_units(docs).orderBy("ord").collect()
    assert [(r.type, r.level, r.text, r.ordered, r.rows) for r in got] == [
        ("heading", 1, "Evidence", None, None),
        ("paragraph", None, "Revenue 42 and more", None, None),
        ("list", None, "a", False, None),
        ("list", None, "b", True, None),
        ("table", None, None, None, [["k", "v"], ["x", "42"]]),
        ("table", None, None, None, [["-"]]),
        ("paragraph", None, "end", None, None),
    ]


def test_markdown_empty_and_separator_only(spark):
    docs = spark.createDataFrame([(1, ""), (2, "|---|"), (3, None)], "doc_id int, text string")
    assert U.read_markdown_units(docs).count() == 0


def test_html_units(spark):
    html = ('<h2>T &lt;x&gt;</h2><p>a <b>b</b></p><img src="i.png" alt="pic">'
            "<table><tr><th>k</th><td>1</td></tr></table><table></table>")
    pages = spark.createDataFrame([(1, html), (2, "<div>one</div>two")], "page_id int, html string")
    got = U.read_html_units(pages).orderBy("page_id", "ord").collect()
    assert [(r.page_id, r.type, r.text) for r in got] == [
        (1, "heading", "T <x>"), (1, "paragraph", "a b"), (1, "image", None), (1, "table", None),
        (2, "paragraph", "one"), (2, "paragraph", "two")]
    assert got[2].asset_path == "i.png" and got[2].alt == "pic" and got[3].rows == [["k", "1"]]


def test_source_ids_depend_on_place_and_text(spark):
    docs = spark.createDataFrame([(1, "a\n\na\r\nb")], "doc_id int, text string")
    got = U.with_source_ids(U.read_plain_units(docs)).orderBy("ord").collect()
    assert [r.ord for r in got] == [0, 1, 2] and len({r.source_id for r in got}) == 3


def test_register_sources_and_media(spark, tmp_path):
    (tmp_path / "a.md").write_text("x")
    (tmp_path / "b.xyz").write_text("yy")
    got = rows(registry.register_sources(spark, str(tmp_path)))
    assert [(n, s) for n, s, _ in got] == [("a.md", 1), ("b.xyz", 2)]
    kinds = registry.classify_media(spark.createDataFrame(
        [("d/A.MARKDOWN",), ("x.htm",), ("x.pdf",), ("noext",)], "path string"))
    assert [r[1:] for r in rows(kinds)] == [
        ("text/markdown", None), (None, "unsupported-format"), ("text/html", None),
        ("application/pdf", None)]


def test_headings(spark):
    units = spark.createDataFrame(
        [(1, 0, "paragraph", "年度报告", None), (1, 1, "paragraph", "一、背景", None),
         (1, 2, "paragraph", "（二）现状", None), (1, 3, "paragraph", "正文", None),
         (2, 0, "paragraph", "只有报告", None)],
        "doc_id int, ord bigint, type string, text string, level int")
    got = rows(ledger.normalize_headings(units), "doc_id", "ord", "type", "level")
    assert got[:4] == [(1, 0, "heading", 0), (1, 1, "heading", 1), (1, 2, "heading", 2),
                       (1, 3, "paragraph", None)]
    assert got[4] == (2, 0, "paragraph", None)
    docs = spark.createDataFrame([(1, "年度报告\n一、背景"), (2, "只有报告")], "doc_id int, text string")
    counted = ledger.normalize_headings(U.read_plain_units(docs, count="n"), count="n")
    assert rows(counted, "doc_id", "ord", "type") == [
        (1, 0, "heading"), (1, 1, "heading"), (2, 0, "paragraph")]


def test_source_pack_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Qty 5 about\nend")], "doc_id int, text string")
    base = U.with_source_ids(U.read_plain_units(docs)).withColumn("caption", F.lit(None).cast("string"))
    units = ledger.mark_substantive(base)
    warnings = registry.extraction_warnings(units.withColumn("fallback", F.lit(False)))
    parts = ledger.source_pack(docs, units, warnings)
    manifest = rows(ledger.write_source_pack(parts, str(tmp_path / "pack")))
    assert manifest == rows(ledger.pack_manifest(parts))
    assert [m[0] for m in manifest] == ["fact-ledger", "readable-source", "source-map"]
    with pytest.raises(Exception):
        ledger.write_source_pack(parts, str(tmp_path / "pack"))


# --- claims ---------------------------------------------------------------------


def claim_frames(spark, text, sources=("预计达到 189 亿元",)):
    claims = spark.createDataFrame([("c", text)], "claim_id string, text string")
    units = spark.createDataFrame(
        [(f"s{i}", t) for i, t in enumerate(sources)], "source_id string, text string")
    refs = units.select(F.lit("c").alias("claim_id"), "source_id")
    return claims, refs, units


def as_bindings(claims, refs, units):
    return (
        claims.withColumnRenamed("claim_id", "content_id"),
        refs.select(F.col("claim_id").alias("content_id"), F.col("source_id").alias("fact_id")),
        units.select(F.col("source_id").alias("fact_id"), F.col("text").alias("raw_text")))


@pytest.mark.parametrize("text", ["预计达到 189 亿元", "no number"])
def test_quoting_the_source_passes(spark, text):
    claims, refs, units = claim_frames(spark, text, (text,))
    bound = as_bindings(claims, refs, units)
    assert audit.unbound_numbers(*bound).count() == 0
    assert audit.unsupported_numbers(claims, refs, units).count() == 0
    assert audit.dropped_qualifiers(*bound).count() == 0
    assert audit.unsupported_terms(claims, refs, units).count() == 0
    assert audit.lexical_support(claims, refs, units).filter("not supported").count() == 0


def test_changed_number(spark):
    frames = claim_frames(spark, "预计达到 198 亿元")
    assert rows(audit.unbound_numbers(*as_bindings(*frames)), "detail") == [("198",)]
    assert rows(audit.unsupported_numbers(*frames)) == [("c", "198", 1, 0)]


def test_set_passes_where_multiset_fails(spark):
    frames = claim_frames(spark, "5 and 5", ("qty 5",))
    assert audit.unbound_numbers(*as_bindings(*frames)).count() == 0
    assert rows(audit.unsupported_numbers(*frames)) == [("c", "5", 2, 1)]


def test_dropped_qualifier_and_changed_unit(spark):
    frames = claim_frames(spark, "达到 189 亿元")
    assert rows(audit.dropped_qualifiers(*as_bindings(*frames)), "detail") == [("预计",)]
    changed = claim_frames(spark, "预计 189 万元", ("预计 189 亿元",))
    assert rows(audit.unsupported_terms(*changed), "detail") == [("万元",)]


def test_combined_audit_equals_the_three_checks(spark):
    claims, refs, units = claim_frames(
        spark, "达到 189 和 7 和 7 亿元", ("预计达到 189 亿元", "约 7"))
    bound = as_bindings(claims, refs, units)
    separate = issues.collect_issues(
        audit.unbound_numbers(*bound),
        audit.unsupported_number_issues(audit.unsupported_numbers(claims, refs, units)),
        audit.dropped_qualifiers(*bound))
    together = audit.claim_issues(
        claims.withColumn("source_ids", F.array(F.lit("s0"), F.lit("s1"))), units)
    assert rows(together) == rows(separate) and together.count() == 3
    more = claims.union(spark.createDataFrame([("d", "none")], claims.schema))
    verdicts = audit.claim_verdicts(
        more.withColumn("source_ids", F.array(F.lit("s0"), F.lit("s1"))), units)
    assert rows(verdicts) == [("c", 3, 0, False), ("d", 0, 0, True)]


def test_claims_without_sources(spark):
    claims = spark.createDataFrame(
        [("a", "7", []), ("b", "8", None), ("c", "9", ["gone"])],
        "claim_id string, text string, source_ids array<string>")
    units = spark.createDataFrame([("s", "1")], "source_id string, text string")
    got = rows(audit.claim_issues(claims, units), "subject_id", "code")
    assert got == [(c, k) for c in "abc" for k in ("fact-distortion", "numeric-token-absent")]


def test_unrelated_prose_is_not_supported(spark):
    frames = claim_frames(spark, "completely different english prose", ("数据源说明",))
    assert rows(audit.lexical_support(*frames)) == [("c", 4, 0, 1, False)]


def test_attribution(spark):
    facts = spark.createDataFrame(
        [("a", "10 and 11"), ("b", "11 and 12")], "ref string, raw_text string")
    texts = spark.createDataFrame(
        [(1, "only 10"), (2, "shared 11"), (3, "10 then 12"), (4, "none"), (5, "12, 12")],
        "text_id int, text string")
    assert rows(audit.attribute_by_number(texts, facts)) == [(1, "a", 1), (5, "b", 1)]


def test_references_and_coverage(spark):
    units = spark.createDataFrame([("s1", True), ("s2", True), ("s3", False)],
                                  "source_id string, substantive boolean")
    s1 = units.filter("source_id = 's1'")
    assert rows(audit.uncovered_sources(units, s1, s1), "subject_id") == [("s2",)]
    coverage = spark.createDataFrame(
        [("s1", True, "preserved", None), ("s2", True, "pending", None),
         ("s3", False, "omitted", ""), ("s4", True, "merged", None)],
        "source_id string, substantive boolean, status string, reason string")
    assert rows(audit.coverage_orphans(coverage, s1), "subject_id", "code") == [
        ("s2", "unmapped-source"), ("s3", "omitted-without-reason"), ("s4", "not-referenced")]


def test_division(spark):
    facets = spark.createDataFrame([("e", "f", "s1"), ("e", "f", "s2"), ("e", "g", "s3"), ("x", "h", "s9")],
                                   "entity_id string, facet_id string, source_id string")
    contents = spark.createDataFrame([("e", "f", "c1", "main"), ("e", None, "c2", "detail"), ("e", "g", "c3", "appendix")],
                                     "entity_id string, facet_id string, content_id string, tier string")
    sources = spark.createDataFrame([("c1", "s1"), ("c2", "s2"), ("c3", "s3")], "content_id string, source_id string")
    got = rows(audit.coverage_division(facets, contents, sources))
    assert got == [("e", "f", 2, 2, True), ("e", "g", 1, 0, False), ("x", "h", 1, 0, False)]
    assert len(rows(audit.coverage_division(facets, contents, sources, final=False))) == 2


def test_verdict_counts(spark):
    found = spark.createDataFrame([("error", "a", "x", None), ("warning", "b", "x", None), ("warning", "b", "y", None)],
                                  "severity string, code string, subject_id string, detail string")
    subjects = spark.createDataFrame([("x",), ("y",), ("z",)], "subject_id string")
    assert rows(issues.audit_verdict(subjects, found)) == [
        ("x", 1, 1, False), ("y", 0, 1, True), ("z", 0, 0, True)]


def test_rules_accept_and_reject(spark):
    overrides = spark.createDataFrame(
        [("n", "text", "user-override", "2024-01-01T00:00:00Z"), ("n", "datasets.0.rows.1.2", "user-override", "2024-01-01"),
         ("n", "color", "user-override", "2024-01-01"), ("", "text", "user-override", "2024-01-01"), ("n", "text", "model", "2024-01-01"),
         ("n", "title", "user-override", "soon")],
        "node_id string, field string, provenance string, changed_at string")
    assert rules.invalid_overrides(overrides).count() == 4
    tables_ = spark.createDataFrame([(1, [1, 1]), (2, [1, 2])], "id int, xs array<int>")
    assert rows(rules.check_constraints(tables_, {"xs": {"unique_items": True}}, "id"), "subject_id") == [("1",)]
    files = spark.createDataFrame([("fact-ledger.json",), ("assets/x.png",), ("other.md",)], "path string")
    assert rows(rules.allowlist_kind(files)) == [("assets/x.png", "visual-reference"), ("fact-ledger.json", "source-pack")]
    mapped = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    assert {tuple(r) for r in rules.remap_codes(mapped, "c", {"a": "b"}, {"b": "d"}).collect()} == {
        ("a", "d", True), ("b", "d", True), ("z", "z", False), (None, None, False)}


def test_default_unsafe_rules(spark):
    pages = spark.createDataFrame(
        [(1, "fetch('x')"), (2, "new Function('a')"), (3, "import('https://x')"), (4, "@import https://x"),
         (5, '<img alt="a" src="https://x">'), (6, "a{color:#fff}"), (7, "prefetching (x)"), (8, "fine")],
        "id int, html string")
    assert [(int(s), c) for s, c in rows(rules.unsafe_content(pages, "id", "html"), "subject_id", "code")] == [
        (1, "network-runtime"), (2, "dynamic-code"), (3, "remote-dynamic-import"), (4, "remote-css"),
        (5, "remote-resource"), (6, "literal-color")]


# --- tables ---------------------------------------------------------------------


def cells(spark, *data):
    flat = [("d", r, c, v) for r, line in enumerate(data) for c, v in enumerate(line)]
    return spark.createDataFrame(flat, "dataset_id string, row_idx bigint, col_idx bigint, cell string")


def test_shifted_summary_row(spark):
    df = cells(spark, ("1", "掩膜版", "10 亿元", "a"), ("2", "光刻胶", "20 亿元", "b"), ("合计", "x", "30 亿元"))
    assert rows(tables.table_series(df), "label", "value") == [("x", 30.0), ("光刻胶", 20.0), ("掩膜版", 10.0)]


def test_numeric_label_falls_back(spark):
    df = cells(spark, ("1", "5", "t"), ("2", "6", "u"), ("3", "-7", "v"), ("4", "8", ""))
    assert rows(tables.table_series(df), "row_idx", "label", "value") == [
        (0, "t", 5.0), (1, "u", 6.0), (3, "4", 8.0)]


def test_repeated_value_is_one_point(spark):
    values = spark.createDataFrame([("d", 0, "a", 465.0, "亿美元"), ("d", 1, "b", 465.0, "亿美元")],
                                   "dataset_id string, ord bigint, label string, value double, unit string")
    assert tables.comparable_groups(values).count() == 0


def test_trend_rejects_an_empty_x(spark):
    series = spark.createDataFrame([("d", 0, "x", "s", 1.0), ("d", 1, "y", "s", None), ("e", 0, "x", "s", 1.0), ("e", 1, "y", "s", 2.0)],
                                   "dataset_id string, x_idx bigint, x string, series string, value double")
    assert rows(tables.trend_groups(series), "dataset_id") == [("e",), ("e",)]


# --- structure --------------------------------------------------------------------


def test_entities(spark):
    dims = spark.createDataFrame([(g, f"e{i}", l) for g, n in (("a", 4), ("b", 3)) for i in range(n) for l in "xyz"]
                                 + [("c", f"e{i}", l) for i in range(4) for l in "xy"], "g string, e string, label string")
    assert rows(sections.repeated_entities(dims, dims, "g", "e")) == [("a", 4)]


def test_tags_and_ancestors(spark):
    html = '<div class="a"><p>x<section><b>y</b></section><p>z</div><nav hidden><i>q</i></nav><u></u>'
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    tags = tree.tag_tree(pages)
    assert [(r.tag, r.depth) for r in tags.orderBy("pos").collect()] == [
        ("div", 0), ("p", 1), ("section", 1), ("b", 2), ("p", 1), ("nav", 0), ("i", 1), ("u", 0)]
    values = {r.tag: r.value for r in tree.nearest_ancestor_value(tags, "class").collect()}
    assert values["b"] == "a" and values["i"] is None and values["div"] is None
    assert "i" not in {r.tag for r in tree.statically_visible(tags).collect()}
    assert "nav" not in {r.tag for r in tree.statically_visible(tags).collect()}


def test_tree_and_subtree(spark):
    nodes = spark.createDataFrame([("r", None, 0), ("b", "r", 1), ("a", "r", 0), ("x", "a", 0)],
                                  "node_id string, parent_id string, ord bigint")
    flat = tree.flatten_tree(nodes)
    assert [r.node_id for r in flat.orderBy("path").collect()] == ["r", "a", "x", "b"]
    assert rows(tree.subtree(flat, flat.filter("node_id = 'a'"))) == [("a", "a"), ("a", "x")]


def test_forest_with_equal_and_long_positions(spark):
    big = 12345678901
    nodes = spark.createDataFrame(
        [("d", "A", None, 0), ("d", "B", None, 0), ("d", "a1", "A", big), ("d", "a2", "A", big + 1),
         ("d", "b1", "B", -1), ("d", "b2", "B", -1), ("d", "bx", "b2", 0), ("e", "A", None, 5), ("e", "q", "A", 0)],
        "doc string, node_id string, parent_id string, ord bigint")
    flat = tree.flatten_tree(nodes, ["doc"])
    order = [(r.doc, r.node_id) for r in flat.orderBy("doc", "path").collect()]
    assert order == [("d", x) for x in ("A", "a1", "a2", "B", "b1", "b2", "bx")] + [("e", "A"), ("e", "q")]
    roots = nodes.filter("doc = 'd' AND node_id IN ('A', 'b1')")
    assert rows(tree.subtree(flat, roots, ["doc"])) == [
        ("d", "A", "A"), ("d", "A", "a1"), ("d", "A", "a2"), ("d", "b1", "b1")]


def test_deep_trees_and_cycles(spark):
    schema = "node_id string, parent_id string, ord bigint"
    deep = spark.createDataFrame([(f"n{i}", f"n{i-1}" if i else None, 0) for i in range(70)], schema)
    assert tree.flatten_tree(deep).agg(F.max("depth")).first()[0] == 69
    loop = spark.createDataFrame([("r", None, 0), ("x", "y", 0), ("y", "x", 0), ("z", "?", 0)], schema)
    flat = tree.flatten_tree(loop)
    assert rows(flat.select("node_id")) == [("r",)]
    assert rows(tree.unreached(loop, flat).select("node_id")) == [("x",), ("y",), ("z",)]
    with pytest.raises(ValueError):
        tree.flatten_tree(loop.union(spark.createDataFrame([("x", "r", 0)], schema)))


def test_intervals_of_a_random_forest(spark):
    """Preorder places and all subtrees against a plain walk; a cycle and an unknown parent stay out."""
    rng = random.Random(5)
    nodes = [("d", "n0", None, 0)]
    for i in range(1, 60):
        doc = rng.choice("de")
        own = [n[1] for n in nodes if n[0] == doc]
        nodes.append((doc, f"n{i}", rng.choice(own) if own and i % 9 else None, rng.choice((-3, 0, 0, 5000))))
    below = {}
    for n in nodes:
        below.setdefault((n[0], n[2]), []).append(n)
    want, pairs = [], set()

    def walk(n, depth, at):
        first = at
        at += 1
        inside = [n[1]]
        for child in sorted(below.get((n[0], n[1]), []), key=lambda c: (c[3], c[1].encode().hex())):
            at, more = walk(child, depth + 1, at)
            inside += more
        want.append((n[0], n[1], n[2], depth, first, at - 1))
        pairs.update((n[0], n[1], x) for x in inside)
        return at, inside

    for doc in "de":
        at = 0
        for root in sorted(below.get((doc, None), []), key=lambda c: (c[3], c[1].encode().hex())):
            at, _ = walk(root, 0, at)
    stray = [("d", "x", "y", 0), ("d", "y", "x", 0), ("d", "z", "?", 0), ("d", "under", "x", 0)]
    frame = spark.createDataFrame(nodes + stray, "doc string, node_id string, parent_id string, ord bigint")
    intervals = tree.tree_intervals(frame, ["doc"])
    assert rows(intervals) == sorted(want, key=str)
    assert set(map(tuple, tree.subtree_intervals(intervals, frame, ["doc"]).collect())) == pairs


def test_all_checks_at_once_agree_with_each(spark):
    """Claims without sources, unknown and repeated sources, tokens of one form only, qualifiers."""
    rng = random.Random(5)
    words = ["1", "2", "1,000", "1000", "-3", "3", "4%", "4", "约", "至少", "x"]
    claims = [(i, " ".join(rng.choices(words, k=rng.randrange(6))),
               [f"s{rng.randrange(8)}" for _ in range(rng.randrange(4))] if i % 9 else None) for i in range(150)]
    sources = [(f"s{i}", " ".join(rng.choices(words, k=rng.randrange(9)))) for i in range(6)]
    claims = spark.createDataFrame(claims, "claim_id int, text string, source_ids array<string>")
    sources = spark.createDataFrame(sources, "source_id string, text string")
    refs = claims.select("claim_id", F.explode("source_ids").alias("source_id"))
    content = claims.withColumnRenamed("claim_id", "content_id")
    bound = refs.toDF("content_id", "fact_id"), sources.toDF("fact_id", "raw_text")
    want = issues.collect_issues(
        audit.unbound_numbers(content, *bound), audit.dropped_qualifiers(content, *bound),
        audit.unsupported_number_issues(audit.unsupported_numbers(claims, refs, sources)))
    assert rows(audit.claim_issues(claims, sources)) == rows(want) and want.count() > 50
    verdicts = issues.audit_verdict(claims.select(F.col("claim_id").cast("string").alias("subject_id")), want)
    assert rows(audit.claim_verdicts(claims, sources)) == rows(verdicts)


def test_intervals_of_a_long_chain(spark):
    """Rounds follow the logarithm of the depth, and no row holds its ancestors."""
    deep = spark.range(600).selectExpr(
        "concat('n', id) AS node_id", "IF(id > 0, concat('n', id - 1), NULL) AS parent_id", "0L AS ord")
    intervals = tree.tree_intervals(deep)
    assert intervals.agg(F.max("depth"), F.max("enter"), F.min("leave"), F.sum("leave")).first() == (
        599, 599, 599, 599 * 600)
    some = deep.filter("node_id IN ('n10', 'n590')")
    assert rows(tree.subtree_intervals(intervals, some).groupBy("root_id").count()) == [("n10", 590), ("n590", 10)]


# --- versions and snapshots -----------------------------------------------------------


def test_deleted_chain_collapses(spark):
    versions = spark.createDataFrame([(i, i - 1 if i else None) for i in range(12)],
                                     "version_id int, parent_version_id int")
    gone = versions.filter("version_id between 2 and 9 or version_id = 0")
    assert {tuple(r) for r in edits.delete_versions(versions, gone).collect()} == {(1, None), (10, 1), (11, 10)}


def test_deleted_cycle_ends(spark):
    schema = "version_id int, parent_version_id int"
    versions = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None), (5, 4), (6, 6), (7, 6)], schema)
    gone = versions.filter("version_id IN (1, 2, 4, 6)")
    assert rows(edits.delete_versions(versions, gone)) == [(3, None), (5, None), (7, None)]
    assert rows(edits.circular_versions(versions)) == [(i, "circular-version") for i in (1, 2, 3, 6, 7)]


def test_fingerprint_ignores_order_and_sees_copies(spark):
    data = [("g", f"n{i}", f"d{i}") for i in range(50)]
    schema = "g string, n string, d string"
    one = spark.createDataFrame(data, schema)
    two = spark.createDataFrame(list(reversed(data)), schema).repartition(3)
    digest = lambda df: df.select("sha256").first()[0]
    mark = digest(snapshot.fingerprint(one, ["g"], "n", "d"))
    assert mark == digest(snapshot.fingerprint(two, ["g"], "n", "d"))
    assert mark != digest(snapshot.fingerprint(one.union(one.limit(1)), ["g"], "n", "d"))
    assert mark != digest(snapshot.fingerprint(one.withColumn("d", F.lit("x")), ["g"], "n", "d"))


def test_signature_exact_and_counted(spark):
    df = spark.createDataFrame([("g", "b", "x"), ("g", "a", "y"), ("g", "b", "x")], "g string, c string, k string")
    assert snapshot.signature(df, "g", "c", "k").first().signature == "a:y|b:x|b:x"
    assert snapshot.signature(df, "g", "c", "k", counted=True).first().signature == "a:yx1|b:xx2"


def test_publish_is_immutable(spark, tmp_path):
    versions = spark.createDataFrame([(1, 7, "2024-01-01", "h")], "version_id int, variant_id int, created_at string, sha256 string")
    record = edits.publication_records(versions)
    name = record.first().publication_id
    edits.publish(versions, name, record, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/records")).count() == 1
    with pytest.raises(Exception):
        edits.publish(versions, name, record, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/records")).count() == 1


def test_cell_edit(spark):
    df = cells(spark, ("a", "42"), ("b", "37"))
    changes = spark.createDataFrame([("d", 0, 1, 1, "44"), ("d", 0, 1, 2, "43"), ("d", 9, 0, 3, "x")],
                                    "dataset_id string, row_idx bigint, col_idx bigint, seq bigint, value string")
    edited, rejected = edits.edit_cells(df, changes)
    assert rows(edited.filter("edited"), "cell") == [("43",)] and rows(rejected, "value") == [("x",)]


def test_delete_omits_only_the_last_reference(spark):
    refs = spark.createDataFrame([("n1", "s1"), ("n1", "s2"), ("n2", "s2")], "node_id string, source_id string")
    coverage = spark.createDataFrame([("s1", "preserved"), ("s2", "preserved"), ("s3", "pending")], "source_id string, status string")
    gone = spark.createDataFrame([("n1", 1)], "node_id string, seq int")
    got = rows(edits.coverage_on_delete(coverage, refs, gone))
    assert got == [("s1", "omitted", 0, 'user deleted report node "n1"'), ("s2", "preserved", 1, None), ("s3", "pending", 0, None)]


def test_delete_takes_the_subtree_and_names_the_last_deletion(spark):
    nodes = spark.createDataFrame([("p", None, 0), ("k", "p", 0), ("n9", None, 1), ("n1", None, 2)],
                                  "node_id string, parent_id string, ord bigint")
    refs = spark.createDataFrame([("k", "s1"), ("n9", "s2"), ("n1", "s2"), ("k", "s3"), ("n1", "s3")],
                                 "node_id string, source_id string")
    coverage = spark.createDataFrame([(s, "preserved") for s in ("s1", "s2", "s3")], "source_id string, status string")
    gone = spark.createDataFrame([("n9", 1), ("k", 2), ("p", 3), ("n1", 4)], "node_id string, seq int")
    got = rows(edits.coverage_on_delete(coverage, refs, gone, tree.flatten_tree(nodes)))
    reason = 'user deleted report node "{}"'.format
    assert got == [("s1", "omitted", 0, reason("k")), ("s2", "omitted", 0, reason("n1")), ("s3", "omitted", 0, reason("n1"))]
    parent = gone.filter("node_id = 'p'")
    assert rows(edits.coverage_on_delete(coverage, refs, parent, tree.flatten_tree(nodes)))[0] == (
        "s1", "omitted", 0, reason("p"))


def test_images_become_warnings_in_data_first_mode_only(spark):
    units = spark.createDataFrame(
        [("d", 1, "s1", "image", None, "growth chart", ""), ("d", 2, "s2", "paragraph", "it grew", None, None),
         ("d", 3, "s3", "image", None, "", "a cat"), ("d", 4, "s4", "image", None, "", "table"), ("d", 5, "s5", "heading", "h", None, None)],
        "doc_id string, ord int, source_id string, type string, text string, alt string, caption string")
    read = sections.following_text(units)
    got = {r.source_id: r for r in sections.describe_images(read).collect()}
    assert [got[f"s{k}"].type for k in range(1, 6)] == ["evidenceWarning", "paragraph", "image", "evidenceWarning", "heading"]
    assert got["s1"].source_refs == ["s1", "s2"] and got["s1"].warning_text == "it grew" and got["s1"].original_type == "image"
    assert got["s4"].source_refs == ["s4"] and got["s4"].warning_text == "table" and got["s3"].source_refs == ["s3"]
    other = sections.describe_images(read, mode="reading-first")
    assert {r.type for r in other.collect()} == {"image", "paragraph", "heading"}


LABELS = (("A", "opening", "aa"), ("B", "opening", "bb"), ("C", "opening", "x。y"))


def label_all(texts, default):
    """The rule, one text after the other."""
    import re

    def find(t):
        return next((name for name, _, p in LABELS if re.search(p, t.strip()[:48])), None)

    current, out = default, []
    for text in texts:
        parts = re.findall("[^。！？]+[。！？]?", text)
        label, labels = current, []
        for p in parts:
            label = find(p) or label
            labels.append(label)
        if len(parts) >= 2 and len(set(labels)) > 1:
            out += list(zip(parts, labels))
            current = labels[-1]
        else:
            current = find(text) or current
            out.append((text, current))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_labels_are_carried(spark, seed):
    import random

    rng = random.Random(seed)
    pieces = ["aa。", "bb。", "x。y bb。", "x。y。", "none。", "aa", "x。y aa。"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 4))) for _ in range(40)]
    units = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "d int, ord bigint, text string")
    got = sections.carry_label(units, "d", LABELS, "none", bucket_width=7).orderBy("ord", "sentence_no").collect()
    assert [(r.sentence, r.label) for r in got] == label_all(texts, "none")


def test_label_keeps_embedded_change(spark):
    units = spark.createDataFrame([(1, 0, "概览说明。国内产能提升。"), (1, 1, "后续。")], "d int, ord bigint, text string")
    got = sections.carry_label(units, "d").orderBy("ord", "sentence_no").collect()
    assert [(r.sentence, r.label) for r in got] == [
        ("概览说明。", "材料概览"), ("国内产能提升。", "国内"), ("后续。", "国内")]


def test_table_rows_by_label(spark):
    df = spark.createDataFrame([(1, [["维度", "x"], ["技术难点", "y"], ["价值链", "z"]]), (2, [["a", "b"]])],
                               "t int, rows array<array<string>>")
    assert rows(sections.split_table_rows(df, "t"), "t", "row_idx", "label") == [
        (1, 1, "技术难点"), (1, 2, "价值链分析")]


def test_json_numbers_at_every_depth(spark):
    df = spark.createDataFrame([
        (1, '{"a":1,"o":{"b":2},"rows":[[3,4],[5]],"x":[{"v":6}],"s":"7","order":8,"q":{"revision":9,"z":-0.50}}'),
        (2, "[18.0, [1e3]]"), (3, None), (4, "{bad"), (5, "12")], "k int, json string")
    assert rows(rules.json_numbers(df, "k", "json")) == [
        (1, "a", "1"), (1, "o.b", "2"), (1, "q.z", "-0.5"), (1, "rows", "3"), (1, "rows", "4"), (1, "rows", "5"),
        (1, "x.v", "6"), (2, "", "1000"), (2, "", "18")]


def test_forged_datasets(spark):
    data = spark.createDataFrame([("d1", '{"rows":[[10,10]]}'), ("d2", '{"n":10}'), ("d3", '{"n":99}'), ("d4", '{"n":5}')],
                                 "claim_id string, json string")
    refs = spark.createDataFrame([("d1", "s"), ("d2", "s"), ("d3", "s")], "claim_id string, source_id string")
    units = spark.createDataFrame([("s", "only 10 units")], "source_id string, text string")
    edited = spark.createDataFrame([("d3",)], "claim_id string")
    assert rows(audit.unsupported_dataset_numbers(data, refs, units, edited)) == [("d1", "10", 2, 1), ("d4", "5", 1, 0)]
    assert [r.subject_id for r in audit.uncited_datasets(data, refs).collect()] == ["d4"]
