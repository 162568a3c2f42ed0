import random
import re
from collections import Counter

import numpy as np

from tracebound.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    again = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again),
            n < 50 or 100 * len(again) > 50 * n)


def texts():
    rng = random.Random(4)
    out = [None, "", " \n\t ", "a", "a a a a", "x\ny\nx\n\nx \nx", "é#ü |<>\x0b\x0c ok", "w " * 20_000]
    for _ in range(150):
        vocabulary = [rng.choice("abcdeéß") * rng.randrange(1, 5) for _ in range(rng.choice((3, 40, 400)))]
        out.append("".join(rng.choice(vocabulary) + rng.choice(" \n\t") for _ in range(rng.randrange(200))))
    return out


def test_counts_against_brute_force(spark):
    rows = list(enumerate(texts())) + [(None, "null key"), (9, "tie"), (9, "tie")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Q.quality(df, labels).collect()
    names = [*Q.COUNTS, "base_failed"]
    assert sorted(map(str, ((r.doc_id, *[r[c] for c in names]) for r in got))) == sorted(
        map(str, ((i, *plain(t)) for i, t in rows)))
    assert all(r.kept == (not r.base_failed) for r in got)


def test_forest_rejects_what_labels_call_bad(spark):
    rng = random.Random(6)

    def text(kind):
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
        return " ".join(w.upper() + "!!" if kind == "loud" else w + "###" if kind == "signs" else w for w in words)

    kinds = ["clean"] * 8 + ["loud", "signs"]
    rows = [(i, rng.choice(kinds)) for i in range(600)]
    df = spark.createDataFrame([(i, text(k)) for i, k in rows], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(k == "clean")) for i, k in rows[:300]] + [(i, None) for i, _ in rows[300:]],
        "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in Q.quality(df, labels).collect()}
    assert all(kept[i] == (k == "clean") for i, k in rows)
    stay = Q.kept_documents(df, labels)
    assert stay.columns == df.columns
    assert sorted(r.doc_id for r in stay.collect()) == sorted(i for i, k in rows if k == "clean")


def test_every_rule_statistic_reaches_a_forest(spark):
    rng = random.Random(8)

    def text(kind):
        words = ["".join(rng.choice("abcdefgh") for _ in range(9 if kind == "long" else 5)) for _ in range(100)]
        if kind == "lines":
            return "\n".join([" ".join(words[:75]), *["z y"] * 9, " ".join(words[75:])])
        if kind == "signs":
            words[10] += "#" * 9
        if kind == "huge":
            words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(6000)]
        return " ".join(words)

    for bad in ("lines", "long", "signs", "huge"):
        rows = [(i, bad if i % 10 == 0 else "clean") for i in range(300)]
        df = spark.createDataFrame([(i, text(k)) for i, k in rows], "doc_id long, text string")
        labels = spark.createDataFrame([(i, int(k == "clean")) for i, k in rows], "doc_id long, quality int")
        got = Q.quality(df, labels).collect()
        assert not any(r.base_failed for r in got)
        assert {r.doc_id for r in got if not r.kept} == {i for i, k in rows if k == bad}, bad


def test_isolation_depth():
    rows = np.concatenate([np.random.default_rng(0).normal(size=(500, 2)), [[9.0, 9.0]]])
    score = Q.Forest.grown(rows).score(rows)
    assert score.argmax() == 500 and score[500] > 0.6 > np.median(score)


def test_calibration():
    good, bad = np.zeros(10), np.zeros(10)
    good[1], bad[8] = 100, 10
    assert 0.1 < Q.calibrated(good, bad) <= 0.8
    assert Q.calibrated(good, np.zeros(10)) == 1.0
    good[9] = 50
    assert Q.calibrated(good, bad) == 1.0


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.quality(empty, labels).collect() == []
    assert Q.kept_documents(empty, labels).collect() == []
