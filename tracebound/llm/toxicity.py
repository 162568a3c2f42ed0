"""Toxicity with a convolutional text classifier (operator 10).

Words become sums of hashed embeddings (the whole word and its openings, so that unseen
inflections share weight), filters of several widths run over them, and each filter keeps its
largest answer in the text. A logistic layer turns these into a score. Training is plain numpy
on a bounded sample of labelled rows; scoring is one pass in which every distinct word meets the
filters once. Thresholds by language are calibrated on all labelled training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import index_words, pieces, shared
from tracebound.plans.lineage import cut

BUCKETS, DIMENSIONS, FILTERS, WIDTHS = 1 << 18, 8, 8, (1, 2, 3)
#: Code points of the word openings that have an embedding of their own.
OPENINGS = (3, 4, 5, 6, 7, 8)
#: Bounds of the training sample, by hash order of the key: rows per class, and words in all.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_WORDS = 1500, 2500, 2_000_000
STEPS, BATCH, RATE = 1600, 32, 0.03
#: Shares of words whose own embedding, or all of them, are hidden in a training step.
HIDE_WORD, HIDE_ALL = 0.85, 0.15
THRESHOLD, BINS = 0.3, 200
SEED = 11


def buckets_of(word: bytes) -> list[int]:
    """Bucket numbers of a word; case and punctuation at the ends do not count. 0 is padding."""
    text = word.decode(errors="replace").lower().strip(".,;:!?\"'()[]{}<>|*#$%&-_")
    forms = [text, *(f"{n}:{text[:n]}" for n in OPENINGS)]
    return [1 + xxhash.xxh3_64_intdigest(f.encode()) % (BUCKETS - 1) for f in forms]


@dataclass
class Network:
    """Weights: embeddings, per width a (width, dimensions, filters) block and a bias, the output layer."""

    table: np.ndarray
    blocks: list
    biases: list
    out: np.ndarray
    bias: float

    @classmethod
    def fresh(cls, seed: int = SEED) -> Network:
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.03, (BUCKETS, DIMENSIONS)).astype(np.float32)
        table[0] = 0
        blocks = [rng.normal(0, 1 / np.sqrt(w), (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(table, blocks, [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
                   rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), -1.0)

    def pooled(self, vectors: np.ndarray, words: np.ndarray, starts: np.ndarray, places: bool = False):
        """Largest answer of every filter per text, and where it was.

        ``words`` index ``vectors``, whose last row is padding; every text is followed by
        ``max(WIDTHS) - 1`` padding words, and each has one answer that sees padding only.
        """
        n = len(words) - max(WIDTHS) + 1
        pooled, where = [], []
        for block, bias, width in zip(self.blocks, self.biases, WIDTHS):
            answer = sum((vectors @ block[k])[words[k:k + n]] for k in range(width)) + bias
            answer[words[:n] == len(vectors) - 1] = bias  # padding sees only padding
            best = np.maximum.reduceat(answer, starts, axis=0)
            pooled.append(best)
            if places:
                ends = np.append(starts[1:], n)
                where.append(np.stack([a + answer[a:b].argmax(axis=0) for a, b in zip(starts, ends)]))
        return np.concatenate(pooled, axis=1), where

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled, 0) @ self.out + self.bias

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        numbers, offsets, words = index_words(texts)
        rows = np.array([buckets_of(w) for w in words] or np.empty((0, 1 + len(OPENINGS)), int))
        vectors = np.concatenate([self.table[rows].sum(axis=1), np.zeros((1, DIMENSIONS), np.float32)])
        padded, starts = with_padding(numbers, offsets, len(words))
        return sigmoid(self.logits(self.pooled(vectors, padded, starts)[0]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def with_padding(numbers: np.ndarray, offsets: np.ndarray, padding: int) -> tuple[np.ndarray, np.ndarray]:
    """Words with padding after every text, so that no filter sees two texts; and the text starts."""
    gap = max(WIDTHS) - 1
    lengths = np.diff(offsets)
    starts = offsets[:-1] + gap * np.arange(len(lengths))
    out = np.full(int(offsets[-1]) + gap * len(lengths) + 1, padding, np.int64)
    out[np.arange(len(numbers)) + gap * np.repeat(np.arange(len(lengths)), lengths)] = numbers
    return out, starts


def train(examples: list[tuple[np.ndarray, int]], seed: int = SEED) -> Network:
    """Fit the network to (bucket rows of a text, label) with Adam."""
    net, rng = Network.fresh(seed), np.random.default_rng(seed)
    labels = np.array([y for _, y in examples], np.float32)
    # both classes weigh alike in training
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-3), 0.5 / max(1 - labels.mean(), 1e-3))
    names = ["out", *range(len(WIDTHS))]
    moments = {k: [0.0, 0.0] for k in [*names, *[f"b{k}" for k in range(len(WIDTHS))], "bias"]}
    step, scale = 0, 0.0

    rate = RATE

    def adam(key, value, gradient):
        m, v = moments[key]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient ** 2
        moments[key] = [m, v]
        return value - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-7)

    while step < STEPS:
        for batch in np.array_split(rng.permutation(len(examples)), max(1, len(examples) // BATCH)):
            step += 1
            rate = RATE * max(0.02, 1 - step / STEPS)
            texts = [examples[k][0] for k in batch]
            offsets = np.cumsum([0, *map(len, texts)])
            rows = np.concatenate([*texts, np.zeros((1, 1 + len(OPENINGS)), np.int32)])
            rows[rng.random(len(rows)) < HIDE_WORD, 0] = 0
            rows[rng.random(len(rows)) < HIDE_ALL] = 0
            vectors = net.table[rows].sum(axis=1)
            padded, starts = with_padding(np.arange(offsets[-1]), offsets, offsets[-1])
            pooled, where = net.pooled(vectors, padded, starts, places=True)
            error = ((sigmoid(net.logits(pooled)) - labels[batch]) * weight[batch] / len(batch)).astype(np.float32)
            hidden = np.maximum(pooled, 0)
            back = error[:, None] * net.out * (pooled > 0)
            net.out = adam("out", net.out, error @ hidden + 1e-4 * net.out)
            net.bias = adam("bias", net.bias, error.sum())
            word_rows, word_gradients = [], []
            for j, width in enumerate(WIDTHS):
                g = back[:, j * FILTERS:(j + 1) * FILTERS]
                block = np.zeros_like(net.blocks[j])
                for k in range(width):
                    at = padded[where[j] + k]  # (texts, filters)
                    at[padded[where[j]] == offsets[-1]] = offsets[-1]
                    seen = vectors[at]  # (texts, filters, dimensions)
                    block[k] = np.einsum("tf,tfd->df", g, seen)
                    word_rows.append(rows[at].reshape(-1, rows.shape[1]))
                    word_gradients.append(np.einsum("tf,df->tfd", g, net.blocks[j][k]).reshape(-1, DIMENSIONS))
                net.blocks[j] = adam(j, net.blocks[j], block)
                net.biases[j] = adam(f"b{j}", net.biases[j], g.sum(axis=0))
            where_rows = np.concatenate(word_rows)
            used, inverse = np.unique(where_rows, return_inverse=True)
            total = np.zeros((len(used), DIMENSIONS), np.float32)
            np.add.at(total, inverse.reshape(where_rows.shape),
                      np.concatenate(word_gradients)[:, None, :])
            total[used == 0] = 0
            # one scale for the whole table: what many texts ask for moves more than what one does
            scale = max(scale, float((total ** 2).mean()))
            net.table[used] -= rate * total / (np.sqrt(scale) + 1e-7)
            net.table[0] = 0
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    net.bias -= np.log((1 - share) / share)  # the classes weighed alike; now their shares count
    return net


def is_held_out(key: str):
    """Rows that are never learnt from: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> Network:
    """Train on at most TOXIC_ROWS + CLEAN_ROWS labelled rows of at most TRAIN_WORDS words."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull()).filter(~is_held_out(key))
        .groupBy(key).agg(F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64(key, F.lit(SEED))
    chosen = (
        known.filter("toxic > 0").orderBy(order).limit(TOXIC_ROWS)
        .unionByName(known.filter("toxic <= 0").orderBy(order).limit(CLEAN_ROWS))
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            numbers, offsets, words = index_words(texts)
            rows = np.array([buckets_of(w) for w in words] or np.empty((0, 1 + len(OPENINGS)), int), np.int32)
            each = [rows[numbers[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([batch.column("h"), batch.column("toxic"), pa.array(each, pa.binary())],
                                  names=["h", "toxic", "rows"])

    # at most TOXIC_ROWS + CLEAN_ROWS keys are broadcast
    sample = (
        documents.select(key, "text").join(F.broadcast(chosen), key)
        .select(order.alias("h"), F.col("toxic").cast("int").alias("toxic"), "text")
        .mapInArrow(hashed, "h bigint, toxic int, rows binary")
    )
    # which rows fit is decided by their sizes; only those come to the driver
    sample = cut(sample.withColumn("r", F.xxhash64("rows")))
    order_of, words = [], 0
    width = 4 * (1 + len(OPENINGS))
    sizes = sample.select("h", "r", F.length("rows").alias("n")).orderBy("h", "r").limit(TOXIC_ROWS + CLEAN_ROWS)
    for h, r, n in sizes.collect():
        if words + n // width <= TRAIN_WORDS:
            order_of.append((h, r))
            words += n // width
    found: dict[tuple, list] = {}
    picked = documents.sparkSession.createDataFrame(sorted(set(order_of)), "h bigint, r bigint")
    for x in sample.join(F.broadcast(picked), ["h", "r"]).toLocalIterator():  # at most TRAIN_WORDS words
        rows = np.frombuffer(bytes(x.rows), np.int32).reshape(-1, 1 + len(OPENINGS))
        found.setdefault((x.h, x.r), []).append((rows, int(x.toxic > 0)))
    taken = [found[name].pop() for name in order_of]
    if len({y for _, y in taken}) < 2:  # nothing to tell apart
        net = Network.fresh()
        net.out[:] = 0
        return net
    return train(taken)


def scored(documents: DataFrame, net: Network, key: str = "doc_id", also: tuple[str, ...] = ()) -> DataFrame:
    sent = shared(documents.sparkSession, net)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            kept = [batch.column(c) for c in (key, *also)]
            yield pa.record_batch([*kept, pa.array(sent().scores(texts), pa.float64())],
                                  names=[key, *also, "score"])

    rows = documents.select(key, *also, "text")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *also))
    return rows.mapInArrow(judged, schema + ", score double")


def best_threshold(group: pd.DataFrame) -> pd.DataFrame:
    """The bin with the best F1 of one language; the middle of equally good ones."""
    bad, good = np.zeros(BINS), np.zeros(BINS)
    np.add.at(bad, group["bin"].to_numpy(int), group["bad"].to_numpy(float))
    np.add.at(good, group["bin"].to_numpy(int), group["good"].to_numpy(float))
    caught, wrong = np.cumsum(bad[::-1])[::-1], np.cumsum(good[::-1])[::-1]
    f1 = 2 * caught / np.maximum(caught + wrong + bad.sum(), 1)
    best = np.flatnonzero(f1 == f1.max())
    threshold = THRESHOLD if bad.sum() == 0 else float(best.mean()) / BINS
    return pd.DataFrame({"language": [group["language"].iloc[0]], "threshold": [threshold]})


def toxicity(documents: DataFrame, labels: DataFrame, key: str = "doc_id", language: str = "lang") -> DataFrame:
    """Key, held_out, score, predicted (score >= THRESHOLD) and flagged (score >= its language's threshold).

    The score sees the text alone. Null and empty texts are scored as texts without words; repeated
    rows get equal scores; null labels are no labels; a null key is never learnt from; a language
    without toxic labelled rows uses THRESHOLD. Without labels of both kinds all scores are equal. Texts
    of any length are scored whole; one that alone has more than TRAIN_WORDS words is not learnt from.
    """
    net = fit(documents, labels, key)
    rows = cut(scored(documents.withColumn("__language", F.coalesce(F.col(language).cast("string"), F.lit(""))),
                      net, key, ("__language",)).withColumnRenamed("__language", "language"))
    known = labels.filter("toxic IS NOT NULL").groupBy(key).agg(F.max("toxic").alias("toxic"))
    bins = (
        rows.join(known, key).filter(~is_held_out(key))
        .groupBy("language", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
        .agg(F.sum((F.col("toxic") > 0).cast("long")).alias("bad"),
             F.sum((F.col("toxic") <= 0).cast("long")).alias("good"))
    )
    thresholds = bins.groupBy("language").applyInPandas(best_threshold, "language string, threshold double")
    return rows.join(thresholds, "language", "left").select(
        key, is_held_out(key).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        (F.col("score") >= F.coalesce("threshold", F.lit(THRESHOLD))).alias("flagged"))
