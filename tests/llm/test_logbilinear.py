import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracebound.llm import logbilinear as model

SCHEMA = "doc_id bigint, text string, row bigint, word string, score double"


def plain_base(docs):
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in tokens if i is not None and not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n,
             sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens]


def rows_of(spark, docs):
    table = spark.createDataFrame([(i, t, 7, "w", 0.5) for i, t in docs], SCHEMA)
    return model.language_scores(table).collect()


def chain(n, seed=0):
    """Texts of a small Markov chain: the word before says which three may follow."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k, words = int(rng.integers(40)), []
        for _ in range(int(rng.integers(20, 60))):
            k = (3 * k + int(rng.integers(3))) % 40
            words.append(f"Word{k}")
        out.append((i, " ".join(words)))
    return out


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(model, "WORDS", 50)
    monkeypatch.setattr(model, "ENDINGS", 8)


def test_counts_and_base_equal_plain_ones(spark, small, monkeypatch):
    monkeypatch.setattr(model, "FREQUENT", 20)  # most words take the join
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"W{int(x)}Ä" for x in rng.zipf(1.3, 30) % 500)) for i in range(80)]
    docs += [(101, None), (102, ""), (103, " \t"), (None, "w1 lost"), (7, docs[7][1]), (7, docs[7][1])]
    got = rows_of(spark, docs)
    key = lambda r: (str(r[0]), r[2], r[5])
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(plain_base(docs), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
    for ids in ((7,), (101, 102, 103)):  # equal texts, in products of other shapes
        scores = [r.score for r in got if r.doc_id in ids]
        assert scores == pytest.approx([scores[0]] * len(scores), rel=1e-6)


def test_held_out_texts_are_likelier_than_by_counts(spark, small):
    rows = rows_of(spark, chain(1500))
    held = [r for r in rows if r.held_out]
    base, score, n = (sum(getattr(r, c) for r in held) for c in ("base_score", "score", "n_tokens"))
    assert len(held) > 100
    assert score / n > base / n + 0.3  # tenfold per 3 tokens at least


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(3)
    weights = model.Weights.fresh(rng.integers(0, 50, 30).astype(float))
    weights.target = rng.normal(0, 1, weights.target.shape).astype(np.float32)
    for one, two in ((0, 5), (30, 30), (29, 30)):
        logs = model.log_probabilities(weights, np.arange(30), np.full(30, one), np.full(30, two))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-5)
        # the same by a plain loop
        guess = weights.context[one] @ weights.maps[0] + weights.context[two] @ weights.maps[1]
        scores = [float(guess @ t + b) for t, b in zip(weights.target, weights.bias)]
        total = math.log(sum(map(math.exp, scores)))
        assert logs == pytest.approx([s - total for s in scores], abs=1e-4)


def test_shares_within_an_ending_sum_to_one(spark, small):
    docs = spark.createDataFrame([(i, t) for i, t in [(1, "aa ba ca da da ab bb " * 3), (2, "zz yz")]], "doc_id bigint, text string")
    monkey = model.WORDS
    model.WORDS = 2
    try:
        counts = model.token_counts(docs)
        words = model.lexicon(counts)
        left = {r.word: r for r in counts.collect()}
        shares = np.zeros(model.ENDINGS)
        for r in left.values():
            if words.classes_of(np.array([r.word]), np.array([r.ending]))[0] >= 2:
                shares[r.ending] += (r.c + 1) / 10 ** words.ending_logs[r.ending]
        unseen = 1 / 10 ** words.ending_logs
        assert shares + unseen == pytest.approx(np.ones(model.ENDINGS))
    finally:
        model.WORDS = monkey


def test_gradient_follows_the_loss():
    """A batch moves every weight against a numeric derivative of the contrastive loss."""
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 50, 12).astype(float)
    weights = model.Weights.fresh(counts)
    right, one, two = (rng.integers(0, 12, 40) for _ in range(3))
    start = model.Trainer(weights, counts, 9)
    noise = np.searchsorted(start.upto, np.random.default_rng(9).random(model.NOISE))

    def loss(w):
        guess = w.predicted(one, two)
        good = (guess * w.target[right]).sum(axis=1) + w.bias[right] - start.log_noise[right]
        bad = guess @ w.target[noise].T + w.bias[noise] - start.log_noise[noise]
        return (np.log1p(np.exp(-good)).sum() + np.log1p(np.exp(bad)).sum()) / len(right)

    before = [x.copy() for x in (start.w.context, start.w.target, start.w.maps, start.w.bias)]
    start.batch(right, one, two)
    for k, name in enumerate(("context", "target", "maps", "bias")):
        moved = before[k] - getattr(start.w, name)
        at = np.unravel_index(abs(moved).argmax(), moved.shape)
        wide = model.Weights(*(x.astype(np.float64) for x in before))
        up, down = (model.Weights(*(x.astype(np.float64) for x in before)) for _ in range(2))
        getattr(up, name)[at] += 1e-4
        getattr(down, name)[at] -= 1e-4
        slope = (loss(up) - loss(down)) / 2e-4
        assert np.sign(slope) == np.sign(moved[at])
        seen = start.seen[k][at] - 1e-6
        assert seen == pytest.approx(slope ** 2, rel=0.05)
        assert loss(start.w) < loss(wide)


def test_words_are_cut_at_ascii_blanks_only():
    rng = np.random.default_rng(2)
    bits = ["a", "Bc", "É", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\u00a0", "\u2003", "  "]
    texts = ["".join(rng.choice(bits, 12)) for _ in range(300)] + ["", " ", None, "a " * 300_000 + "x" * 400_000]
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    numbers, offsets, words = model.numbered(column)
    assert len(set(words)) == len(words)
    for text, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert [words[n] for n in numbers[a:b]] == (text or "").encode().lower().split()


def test_nothing_to_learn_from_and_empty_table(spark, small):
    assert rows_of(spark, []) == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    found = rows_of(spark, [(held, "a b"), (None, "a")])
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in found) == [(2, 0, 0, 0.0), (3, 0, 0, 0.0)]
    assert all(r.score < 0 for r in found)
