import random
import re

import pytest

from tracebound.llm import mixing


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = total - sum(2 * sizes[s] for s in full)
        left = sum(w for s, w in weight.items() if s not in full)
        new = {s for s in names if s not in full and free * weight[s] / left > 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in full else free * weight[s] / left for s in names}
        full |= new


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows_of(seed, n=900):
    rng = random.Random(seed)
    sources = ["a", "b", "é", None, "B", "z"]
    return [(i, rng.choice(["a"] * 5 + sources), " ".join("w" * rng.randrange(1, 90))) for i in range(n)]


@pytest.mark.parametrize("block", [4, 32])
def test_targets_and_limits(spark, block):
    rows = rows_of(1) + [(5000, "a", None), (5001, "empty", ""), (None, "b", "x y"), (7, "b", "t u"), (7, "b", "t u")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, block=block).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + words(t)
    targets, source_of = plain_targets(sizes), {}
    for i, s, t in rows:
        source_of.setdefault((i, words(t)), s)
    taken, largest = {}, {}
    for r in got:
        s = source_of[(r.doc_id, r.size)]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert r.taken == r.size * r.copies and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= largest[s]
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(7), block=block).collect()))


def test_expectations_are_kept(spark):
    rows = [(i, "ab"[i % 2], "w " * (1 + i % 7)) for i in range(400)]
    seen = [0] * 400
    for seed in range(4):
        mixing.SEED = 20_011 + 17 * seed
        df = spark.createDataFrame([(i, s, t) for i, s, t in rows], "doc_id long, source string, text string")
        for r in mixing.mix(df).collect():
            seen[r.doc_id] += r.copies
    mixing.SEED = 20_011
    wanted = plain_targets({s: sum(words(t) for _, x, t in rows if x == s) for s in "ab"})
    for k, s in enumerate("ab"):
        size = sum(words(t) for _, x, t in rows if x == s)
        for part in range(7):
            group = [seen[i] for i in range(k, 400, 2) if i % 7 == part]
            assert abs(sum(group) / len(group) / 4 - wanted[s] / size) < 0.2


def test_mixed_rows(spark):
    rows = [(i, s, t, f"x{i}") for i, s, t in rows_of(3, 300)] + [(1, "q", "a b", None)] * 40
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, m string")
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    allowed = {}
    for r in rows:
        allowed[r] = allowed.get(r, 0) + 2
    for r in map(tuple, out.collect()):
        allowed[r] -= 1
        assert allowed[r] >= 0


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(empty).collect() == []
    assert mixing.mixed_documents(empty).collect() == []


def test_no_python_in_the_plan(spark, folder):
    plan = mixing.mix(spark.read.parquet(f"{folder}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
