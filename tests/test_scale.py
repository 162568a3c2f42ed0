"""Plans for hot keys give the same rows as the plain definitions, checked by brute force."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tracebound.operators import edits, reuse, tree
from tracebound.plans.hot import fits, salted_join
from tracebound.plans.ordered import _marked, carry_last, positions, running_sum


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows have one key; another key is NULL."""
    rng = random.Random(3)
    data = [
        ("hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{rng.randrange(40)}", i,
         None if rng.random() < 0.6 else f"v{i}", rng.randrange(5))
        for i in range(900)
    ]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, seq int, label string, n int").repartition(5).cache()


def same(left, right):
    assert sorted(map(str, left.collect())) == sorted(map(str, right.select(*left.columns).collect()))


@pytest.mark.parametrize("width", [7, 64, 100_000])
def test_positions(skewed, width):
    w = Window.partitionBy("k").orderBy("seq")
    got = positions(skewed, ["k"], [F.col("seq")], F.floor(F.col("seq") / width), "p", maxima={"m": "n"})
    want = skewed.withColumn("p", F.row_number().over(w)).withColumn("m", F.max("n").over(Window.partitionBy("k")))
    same(want, got)


@pytest.mark.parametrize("width", [7, 64])
@pytest.mark.parametrize("current", [True, False])
def test_carry_last(skewed, width, current):
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    got = carry_last(skewed, ["k"], [F.col("seq")], F.floor(F.col("seq") / width), F.col("label"), "c", current)
    same(skewed.withColumn("c", F.last("label", ignorenulls=True).over(w)), got)


def test_running_sum(skewed):
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    got = running_sum(skewed, ["k"], [F.col("seq")], F.floor(F.col("seq") / 10), F.col("n"), "s")
    same(skewed.withColumn("s", F.sum("n").over(w)), got)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(skewed, how):
    few = skewed.filter("k <> 'k3'").groupBy("k").agg(F.max("seq").alias("top"))
    got = salted_join(skewed, few, ["k"], ["seq"], how, hot_rows=50)
    same(skewed.join(few, "k", how), got)


def test_fits(skewed):
    assert fits(skewed, 900) and not fits(skewed, 899)


# --- edit logs -------------------------------------------------------------------


def log(rng, n, project):
    revision, out = 0, []
    for seq in range(1, n + 1):
        base = revision if rng.random() < 0.6 else max(0, revision - rng.randrange(4)) + rng.randrange(2)
        out.append((project, seq, base if rng.random() > 0.02 else None,
                    rng.choice(["patch", "patch", "undo", "redo"])))
        revision += base == revision
    return out


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(11)
    data = log(rng, 400, "hot") + [e for i in range(12) for e in log(rng, rng.randrange(1, 40), f"p{i}")]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "project string, seq bigint, base_revision bigint, op string")


def accept_all(data):
    out, revision = [], {}
    for project, seq, base, _ in sorted(data, key=lambda e: (e[0], e[1])):
        now = revision.get(project, 0)
        revision[project] = now + (base == now)
        out.append((project, seq, base, base == now, revision[project]))
    return out


@pytest.mark.parametrize("chunk", [3, 16, 1000])
def test_patches_by_prefix_scan(logs, chunk):
    data, df = logs
    got = edits.apply_patches(df, ["project"], chunk=chunk)
    rows = sorted(((r.project, r.seq, r.base_revision, r.accepted, r.revision) for r in got.collect()),
                  key=lambda r: r[:2])
    assert rows == accept_all(data)


def replay_all(data):
    out, state = [], {}
    for project, seq, _, op in sorted(data, key=lambda e: (e[0], e[1])):
        stack, cursor, revision = state.get(project, ([], 0, 0))
        effective = True
        if op == "undo":
            effective = cursor > 0
            cursor -= effective
        elif op == "redo":
            effective = cursor < len(stack)
            cursor += effective
        else:
            stack = stack[:cursor] + [seq]
            cursor += 1
        revision += effective
        state[project] = (stack, cursor, revision)
        out.append((project, seq, op, effective, cursor, len(stack), revision))
    return out, {p: s[:c] for p, (s, c, _) in state.items()}


@pytest.mark.parametrize("size", [60, 1_000_000])
def test_replay_in_rounds(logs, size):
    data, df = logs
    want, stacks = replay_all(data)
    got = edits.replay(df, ["project"], round_size=size)
    columns = ("project", "seq", "op", "effective", "cursor", "length", "revision")
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=lambda r: r[:2])
    assert rows == want
    applied = {}
    for r in edits.applied_patches(got, ["project"]).orderBy("slot").collect():
        applied.setdefault(r.project, []).append(r.seq)
    assert applied == {p: s for p, s in stacks.items() if s}


@pytest.mark.parametrize("size, mix", [
    (2, "undo undo undo redo patch"), (5, "undo redo redo patch patch"), (7, "undo redo"), (1, "patch undo")])
def test_replay_composes_pieces(spark, size, mix):
    """Logs that keep running into both ends, cut into pieces of a few operations."""
    rng = random.Random(mix)
    data = [("hot", seq, None, rng.choice(mix.split())) for seq in range(1, 81)]
    data += [(f"p{i}", seq, None, rng.choice([*mix.split(), None])) for i in range(5) for seq in range(1, 12 * i + 2)]
    df = spark.createDataFrame(data, "project string, seq bigint, base_revision bigint, op string").repartition(3)
    got = edits.replay(df, ["project"], round_size=size)
    columns = ("project", "seq", "op", "effective", "cursor", "length", "revision")
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=lambda r: r[:2])
    assert rows == replay_all(data)[0]


def test_replay_has_no_python_in_its_plan(logs):
    plan = edits.replay(logs[1], ["project"])._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "Pandas", "Arrow"))


# --- reuse ------------------------------------------------------------------------


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_passages_against_brute_force(spark, strategy):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé😀 ") for _ in range(n))
    passages = [word(rng.randrange(16, 90)) for _ in range(25)]
    docs = [(i, word(rng.randrange(50)) + rng.choice(passages) + word(rng.randrange(50)) + rng.choice(passages)[3:])
            for i in range(60)]
    # A third of the documents are copies of one.
    docs += [(1000 + i, docs[0][1]) for i in range(30)]
    left = spark.createDataFrame(docs, "doc_id int, text string")
    right = spark.createDataFrame([(p,) for p in passages], "fragment string")
    got = reuse.protected_fragment_leaks(left, right, strategy=strategy)
    kept = {p.strip(" ") for p in passages if len(p.strip(" ")) >= 16}
    assert got.count() == sum(p in text for _, text in docs for p in kept)


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_passages_with_a_common_opening(spark, strategy):
    rng = random.Random(6)
    opening = "All passages of this source begin in the same way, word for word: "
    passages = [opening + "".join(rng.choice("abcdef") for _ in range(70)) for _ in range(30)]
    docs = [(i, "x" * (i % 31) + passages[i % 30] + "tail") for i in range(90)]
    docs += [(900 + i, opening * 3) for i in range(30)]
    left = spark.createDataFrame(docs, "doc_id int, text string")
    right = spark.createDataFrame([(p,) for p in passages], "fragment string")
    assert reuse.protected_fragment_leaks(left, right, strategy=strategy).count() == 90
    facts = right.withColumnRenamed("fragment", "raw_text")
    assert reuse.verbatim_exposure(left, facts, strategy=strategy).count() == 90


def test_exposure_share(spark):
    passage = "x1 " * 30
    docs = spark.createDataFrame([(1, passage), (2, passage + "y" * 100), (3, "z" * 80)], "doc_id int, text string")
    facts = spark.createDataFrame([(passage,), (passage.replace(" ", "\n"),), ("short",)], "raw_text string")
    got = {r.doc_id: (r.passages, round(r.share, 3), r.severity) for r in reuse.verbatim_exposure(docs, facts).collect()}
    assert got == {1: (1, 1.0, "error"), 2: (1, 0.375, "warning")}


@pytest.mark.parametrize("threshold", [0.5, 0.85])
def test_near_duplicates_against_brute_force(spark, threshold):
    rng = random.Random(9)
    base = [set(rng.sample(range(60), rng.randrange(1, 40))) for _ in range(12)]
    items = list(base)
    for s in base * 3:
        items.append((s - set(rng.sample(sorted(s), min(len(s) - 1, rng.randrange(3))))) | set(rng.sample(range(60), rng.randrange(2))))
    items += [base[0]] * 20
    data = [(i, f"t{t}") for i, s in enumerate(items) for t in s]
    sets = reuse.structure_sets(spark.createDataFrame(data, "item int, shingle string"), "item")
    assert sum(r.members for r in sets.collect()) == len(items)
    got = {(r.item_a, r.item_b): round(r.similarity, 9) for r in reuse.near_duplicates(sets, threshold).collect()}
    first = {}
    for i, s in enumerate(items):
        first.setdefault(frozenset(s), i)
    want = {}
    for a, i in first.items():
        for b, j in first.items():
            if i < j and len(a & b) / len(a | b) > threshold:
                want[(i, j)] = round(len(a & b) / len(a | b), 9)
    assert got == want


def test_members_of_equal_sets(spark):
    data = [(i, f"t{t}") for i, ts in enumerate(["ab", "ba", "xyz", "ab"]) for t in ts]
    items = spark.createDataFrame([(i,) for i in range(6)], "item int")
    got = reuse.set_members(spark.createDataFrame(data, "item int, shingle string"), "item", items).collect()
    assert sorted((r.item, r.first_item, r.members) for r in got) == [
        (0, 0, 3), (1, 0, 3), (2, 2, 1), (3, 0, 3), (4, 4, 2), (5, 4, 2)]
    assert len({r.set_id for r in got}) == 3


def test_row_order_does_not_matter(spark):
    lines = [(i, f"line {i % 4}.") for i in range(40)]
    schema = "id int, text string"
    one = spark.createDataFrame(lines, schema)
    two = spark.createDataFrame(lines[::-1], schema).repartition(4)
    same(reuse.repeated_text(one, "text"), reuse.repeated_text(two, "text"))
    assert reuse.repeated_text_members(one, ["id"], "text").count() == 40


@pytest.mark.parametrize("build", [
    lambda df, o, b: positions(df, ["k"], o, b, "out", maxima={"most": "v"}),
    lambda df, o, b: running_sum(df, ["k"], o, b, F.col("v"), "out"),
    lambda df, o, b: carry_last(df, ["k"], o, b, F.when(F.col("v") > 5, F.col("v")), "out"),
])
def test_ordered_plans_read_and_shuffle_their_rows_once(spark, tmp_path, build):
    spark.range(4000).selectExpr("id % 3 AS k", "id AS seq", "id % 11 AS v", "repeat('x', 50) AS text").write.parquet(
        str(tmp_path / "rows"))
    found = build(spark.read.parquet(str(tmp_path / "rows")), [F.col("seq")], F.floor(F.col("seq") / 100))
    assert found.count() == 4000
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    whole = [x for x in plan.splitlines() if "Exchange hash" in x and "REPARTITION_BY_COL" in x and "Reused" not in x]
    assert plan.count("FileScan parquet") == 1 and len(whole) == 1 and plan.count("ReusedExchange") == 1


def test_only_crowded_keys_are_cut(spark, skewed):
    """Short keys stay whole, whatever their buckets; results are those of the plain windows."""
    w = Window.partitionBy("k").orderBy("seq")
    marked = _marked(skewed, ["k"], 200).groupBy("k").agg(F.max("__spread").alias("cut")).collect()
    assert {r.k for r in marked if r.cut} >= {"hot"} and sum(r.cut for r in marked) < 3
    for slot_rows in (0, 20, 200, 100_000):
        got = positions(skewed, ["k"], [F.col("seq")], F.floor(F.col("seq") / 7), "p", start=0,
                        spread_hot=True, slot_rows=slot_rows)
        same(skewed.withColumn("p", F.row_number().over(w) - 1), got)
        got = running_sum(skewed, ["k"], [F.col("seq")], F.floor(F.col("seq") / 7), F.col("n"), "s",
                          spread_hot=True, slot_rows=slot_rows)
        total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
        same(skewed.withColumn("s", total), got)


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", [
    "u02_collect_issues", "a23_audit_verdict", "j04_unbound_numbers", "j05_unsupported_numbers"])
def test_lines_are_numbered_once_for_claims_and_once_for_sources(spark, folder, name):
    plan = _final_plan(entry.queries()[name](spark, folder))
    assert plan.count("row_number()") == 2, plan


@pytest.mark.parametrize("name", ["a23_issue_verdict", "a23_audit_verdict"])
def test_sums_of_a_claim_are_not_shuffled_by_token(spark, folder, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # plans as of large tables
    try:
        plan = entry.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and all(k.count("#") == 1 for k in keys), keys


def test_rejected_edits_send_only_edited_places_to_every_task(spark, folder):
    lines = _final_plan(entry.queries()["n07_rejected_edits"](spark, folder)).splitlines()
    depth = [len(x) - len(x.lstrip(" :+-|")) for x in lines]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            below = "\n".join(lines[i:end])
            assert "Generate" not in below or "LeftSemi" in below, below


def test_blocks_of_an_interval(spark):
    ends = [(a, a + n) for a in (0, 1, 15, 16, 255, 4095, 4096) for n in (0, 1, 14, 15, 16, 255, 256, 4095, 70_000)]
    got = spark.createDataFrame(ends, "a bigint, b bigint").select(
        "a", "b", tree._blocks(F.col("a"), F.col("b")).alias("blocks")).collect()
    for a, b, blocks in got:
        places = sorted(x for n, k in blocks for x in range(k << 4 * n, (k + 1) << 4 * n))
        assert places == list(range(a, b + 1)) and len(blocks) <= 30 * len({n for n, _ in blocks})
    assert [tuple(map(tuple, r.blocks)) for r in got if (r.a, r.b) == (0, 4095)] == [((3, 0),)]
