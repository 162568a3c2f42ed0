import hashlib
import random
import re

import pytest

from tracebound.llm import substrings as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    lists = [(i, WORD.findall(t or "")) for i, t in rows]
    count = {}
    for _, w in lists:
        for k in range(len(w) - 34):
            g = tuple(w[k:k + 35])
            count[g] = count.get(g, 0) + 1
    out = []
    for i, w in lists:
        gone = {j for k in range(len(w) - 34) if count[tuple(w[k:k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(3000))
    shared = [[word() for _ in range(n)] for n in (34, 35, 36, 50, 120, 400)]
    rows = []
    for i in range(150):
        words = [word() for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(max(1, len(p) - 60))
            words += p[a:a + rng.randrange(30, 200)] + [word() for _ in range(rng.randrange(5))]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(200, rows[3][1]), (200, rows[3][1]), (None, rows[4][1]), (201, None), (202, ""), (203, "one two"),
             (204, "same " * 300), (205, "x y " * 40), (206, " ".join(f"u{k}" for k in range(20_000)))]
    near = rows[5][1].split()
    for k in range(40):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"n{k}"
        rows.append((300 + k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("most,limit", [(S.PASSAGES, S.BROADCAST_ANCHORS), (3, 0)])
def test_against_brute_force(spark, most, limit):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, row int, found string")
    got = S.without_repeats(df, texts=False, most=most, limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def test_automaton_counts():
    rng = random.Random(3)
    lists = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    weights = [rng.randrange(1, 4) for _ in lists]
    automaton = S.SuffixAutomaton()
    for words, n in zip(lists, weights):
        automaton.add(words, n)
    automaton.total()
    for window in (1, 2, 3, 5, 9):
        for words in [*lists, [0, 1, 2, 5, 1, 1, 0, 2, 2, 1]]:
            for k, n in enumerate(automaton.occurrences(words, window)):
                g = words[k:k + window]
                assert n == sum(w * (x[j:j + window] == g) for x, w in zip(lists, weights) for j in range(len(x)))


def test_references(spark):
    rng = random.Random(8)
    ref = [f"r{rng.randrange(500)}" for _ in range(900)]
    docs = []
    for i in range(40):
        a, n = rng.randrange(800), rng.choice((20, 34, 35, 90))
        docs.append((i, " ".join(["a", "b", *ref[a:a + n], "c"])))
    docs += [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    references = spark.createDataFrame([(" ".join(ref),), (None,), ("short",)], "text string")
    windows = {tuple(ref[k:k + 35]) for k in range(len(ref) - 34)}
    for shard in (200, 100_000):
        for r in S.remove_references(df, references, shard_words=shard).collect():
            words = (dict(docs)[r.doc_id] or "").split()
            gone = {j for k in range(len(words)) if tuple(words[k:k + 35]) in windows for j in range(k, k + 35)}
            assert (r.n_words, r.n_removed) == (len(words), len(gone))
            assert r.kept == " ".join(w for j, w in enumerate(words) if j not in gone)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.without_repeats(empty).collect() == []
    assert S.remove_references(empty, empty).collect() == []


def test_bits_instead_of_numbers(spark):
    """More anchors and rows than may be broadcast as numbers, fewer than need a join."""
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    anchors = df.select("text").mapInArrow(S.anchor_counts, "anchor bigint, n bigint").groupBy("anchor").sum("n")
    anchors, limit = anchors.filter("`sum(n)` > 1").select("anchor"), 20
    held = [r.anchor for r in anchors.collect()]
    assert limit < len(held) <= S.BITMAP * limit
    assert S.member_test(anchors, len(held) // S.BITMAP) is None
    for most in (limit, len(held)):
        test = S.member_test(anchors, most)
        assert test(S.np.array(held)).all()
        assert test(S.np.random.default_rng(1).integers(-2**63, 2**63 - 1, 100_000)).sum() < 10
    got = S.without_repeats(df, texts=False, limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)


def shuffled_words(node) -> int:
    """How many shuffles of a physical plan carry the column ``words``."""
    own = node.nodeName() == "Exchange" and "words#" in node.output().mkString(" ")
    below = node.children()
    return own + sum(shuffled_words(below.apply(k)) for k in range(below.size()))


def test_words_are_shuffled_once_after_they_are_distinct(spark):
    df = spark.createDataFrame(corpus(3), "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan as it is before the run
    try:
        found = S.repeats(df, most=3)
        assert shuffled_words(found._jdf.queryExecution().executedPlan()) == 1
        spread = found.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for row in spread:
        # begin, end, ... : a span for each stretch of an anchor, not a number for each window
        assert len(row.found) % 2 == 0
        assert all(b - a >= S.WINDOW for a, b in zip(row.found[::2], row.found[1::2]))
