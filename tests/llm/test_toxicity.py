import random
import zlib

import numpy as np
import pytest

from tracebound.llm import toxicity as T


@pytest.fixture(autouse=True)
def short_training(monkeypatch):
    monkeypatch.setattr(T, "STEPS", 250)


def corpus(n=900):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkl" for b in "aeiou" for c in ("n", "rt", "sam", "lo")]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 90))]
        toxic = rng.random() < 0.2
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(("Zounds!", "zoundsful", "quaxy,", "quaxies")))
        rows.append((i, " ".join(words), "en" if i % 3 else "xx", toxic))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_rules(spark):
    rows = corpus()
    extra = [(5000, None, "en", None), (5001, "", None, None), (None, "zounds quaxy", "en", None),
             (3, rows[3][1], "en", None), (5002, "w " * 50_000, "en", None)]
    df = spark.createDataFrame(
        [(i, t, g, 1.0) for i, t, g, _ in rows + extra], "doc_id long, text string, lang string, score double")
    # held-out labels are wrong on purpose: they must not matter
    labels = spark.createDataFrame(
        [(i, int(x != held(i))) for i, _, _, x in rows] + [(77_777, 1), (1, None)], "doc_id long, toxic int")
    got = T.toxicity(df, labels).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    right = [by[i].predicted == int(x) for i, _, _, x in rows if held(i)]
    assert sum(right) / len(right) > 0.95
    assert by[5000].score == by[5001].score and by[5000].predicted == 0


def test_scores_do_not_depend_on_neighbours():
    net = T.train([(np.array([T.buckets_of(w) for w in t.encode().split()]), int(x)) for _, t, _, x in corpus(200)])
    texts = [t.encode() for _, t, _, _ in corpus(30)] + [b"", b"zounds"]
    alone = np.concatenate([net.scores([t]) for t in texts])
    assert np.allclose(net.scores(texts), alone, atol=1e-5)


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in T.toxicity(df, labels).collect()] == [0]
    assert T.toxicity(df.limit(0), labels).collect() == []
