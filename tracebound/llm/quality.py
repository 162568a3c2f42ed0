"""Quality rules with an isolation forest over rule statistics (operator 1).

Every text gets a few rule statistics. Two rules reject on their own (too few words, too many
repeated ones). For the others forests of random splits are grown on a bounded sample of labelled
rows, one over each statistic and one over all: a row that few splits separate from the rest is
anomalous. In the forest over all, the widest statistics hide the others; a row that is odd in one
statistic alone stands out in that one's forest. The score above which a forest rejects a row comes
from a histogram over all labelled rows, so that clean rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import index_words, pieces, shared, sum_by_text, tidy
from tracebound.plans.lineage import cut

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
#: The bytes that continue a UTF-8 character; without them a text has one byte per code point.
CONTINUED = bytes(range(0x80, 0xC0))

TREES, TREE_ROWS = 100, 256
#: Labelled rows that the forests may see; a sample by hash of the key.
SAMPLE_ROWS = TREES * TREE_ROWS
#: At least this share of the rows labelled good must stay, and of the rejected labelled rows
#: at least PRECISION must be labelled bad; otherwise a forest rejects nothing. The forests share what may be lost.
KEEP, PRECISION = 0.999, 0.9
BINS = 2000
#: The score of a row that is just rejected.
LIMIT = 0.5
#: What the forests see: shares by the number of words, the mean length of a word, and the number of
#: words as a logarithm.
FEATURES = ("symbols_per_word", "shouted_share", "marks_per_word", "dup_lines_per_word", "repeat_share",
            "word_length", "log_words")
#: The columns of each forest.
FORESTS = (*([k] for k in range(len(FEATURES))), list(range(len(FEATURES))))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SEED = 7


def triples(ids: np.ndarray, distinct: int) -> np.ndarray:
    """A number for every three neighbouring words, equal only for equal words."""
    first, second, third = (ids[k:len(ids) - 2 + k].astype(np.int64) for k in range(3))
    if distinct < 1 << 21:
        return (first * distinct + second) * distinct + third
    pair = np.unique(first * distinct + second, return_inverse=True)[1]
    return pair * distinct + third


def statistics_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    ids, offsets, words = index_words(texts)
    n_words = np.diff(offsets)
    chars = np.array([len(w.translate(None, CONTINUED)) for w in words], np.int64)
    word_chars = sum_by_text(chars[ids], offsets) if words else np.zeros(len(texts), np.int64)
    shouted = np.array([len(w) - len(w.translate(None, UPPER)) > 1 and w == w.upper() for w in words])
    repeated = np.zeros(len(ids), bool)
    if len(ids) >= 3:
        keys = triples(ids, len(words))
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= 4:
            _, inverse, counts = np.unique(keys[a:b - 2], return_inverse=True, return_counts=True)
            again = np.flatnonzero(counts[inverse] > 1)
            for j in range(3):
                repeated[a + again + j] = True

    def count(which: bytes) -> np.ndarray:
        return np.array([len(t) - len(t.translate(None, which)) for t in texts], np.int64)

    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    n_dup = n_lines - [len(set(x)) for x in lines]
    n_symbols, n_repeat = count(SYMBOLS), sum_by_text(repeated, offsets)
    per_word = np.maximum(n_words, 1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols,
        "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "symbols_per_word": n_symbols / per_word,
        "shouted_share": (sum_by_text(shouted[ids], offsets) if words else 0 * n_words) / per_word,
        "marks_per_word": count(b"!?") / per_word,
        "dup_lines_per_word": n_dup / per_word, "repeat_share": n_repeat / per_word,
        "word_length": word_chars / per_word, "log_words": np.log(per_word),
    }


def failed(stats: dict) -> np.ndarray:
    return (stats["n_words"] < MIN_WORDS) | (
        100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


SCHEMA = ", ".join([*(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in FEATURES)])


def rule_statistics(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, counts and features of every row of ``documents(key, text)``.

    Null and empty texts have no words and all statistics zero. Other columns are not read.
    """
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            stats = statistics_of(texts)
            yield pa.record_batch(
                [batch.column(key), *[pa.array(stats[c]) for c in COUNTS + FEATURES]],
                names=[key, *COUNTS, *FEATURES])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(tidy(measured), f"`{key}` {kind}, {SCHEMA}")


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Random trees as flat arrays; node 0 is the root, leaves have feature -1."""

    trees: list
    rows: int

    @classmethod
    def grown(cls, rows: np.ndarray, trees: int = TREES, size: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = min(size, len(rows))
        limit = int(np.ceil(np.log2(max(size, 2))))
        out = []
        for _ in range(trees):
            nodes: list[list] = []

            def grow(x: np.ndarray, depth: int) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, depth + expected_path(len(x))])
                low, high = x.min(axis=0), x.max(axis=0)
                wide = np.flatnonzero(high > low)
                if depth < limit and len(wide):
                    feature = int(rng.choice(wide))
                    split = rng.uniform(low[feature], high[feature])
                    left = x[:, feature] <= split
                    if left.all():
                        left = x[:, feature] < high[feature]
                    nodes[at][:4] = [feature, split, grow(x[left], depth + 1), grow(x[~left], depth + 1)]
                return at

            grow(rows[rng.choice(len(rows), size, replace=False)], 0)
            out.append(tuple(np.array(c) for c in zip(*nodes)))
        return cls(out, size)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; higher is more anomalous."""
        depth = np.zeros(len(rows))
        for feature, split, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            live = np.arange(len(rows))
            while len(live):
                live = live[feature[at[live]] >= 0]
                node = at[live]
                goes = rows[live, feature[node]] <= split[node]
                at[live] = np.where(goes, left[node], right[node])
            depth += path[at]
        return 2.0 ** (-depth / len(self.trees) / max(expected_path(self.rows), 1e-9))


@dataclass
class Rules:
    """Grown forests with their columns, and the score from which on each rejects a row."""

    forests: list

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1, the highest of all forests; LIMIT is where a row is rejected."""
        found = [forest.score(rows[:, columns]) * LIMIT / threshold for columns, forest, threshold in self.forests]
        return np.minimum(np.max(found, axis=0), 1.0) if found else np.zeros(len(rows))


def features_of(columns: dict) -> np.ndarray:
    return np.stack([columns[c] for c in FEATURES], axis=1).astype(float)


def histogram(labelled: DataFrame, forests: list) -> np.ndarray:
    """Counts of ``labelled(*FEATURES, quality)`` by forest, quality (0 or 1) and bin of the score."""
    sent = shared(labelled.sparkSession, forests)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(FORESTS), 2, BINS), np.int64)
        for batch in batches:
            good = (batch.column("quality").to_numpy() > 0).astype(int)
            rows = features_of({c: batch.column(c).to_numpy() for c in FEATURES})
            for k, (columns, forest) in enumerate(sent()):
                at = np.minimum((forest.score(rows[:, columns]) * BINS).astype(int), BINS - 1)
                np.add.at(counts[k], (good, at), 1)
        used = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(used), pa.array(counts.ravel()[used])], names=["slot", "n"])

    out = np.zeros(len(FORESTS) * 2 * BINS)
    for slot, n in (
        labelled.select(*FEATURES, "quality").mapInArrow(binned, "slot bigint, n bigint")
        .groupBy("slot").agg(F.sum("n")).collect()  # at most one row per forest, quality and bin
    ):
        out[slot] = n
    return out.reshape(len(FORESTS), 2, BINS)


def fit_rules(stats: DataFrame, labels: DataFrame, key: str = "doc_id") -> Rules:
    """Grow the forests on at most SAMPLE_ROWS labelled rows and calibrate them on all of them.

    ``labels(key, quality)``: 1 is good, 0 is bad; null labels are no labels, and a key with both
    counts as bad. Without labels of both kinds nothing is rejected beyond the base rules.
    """
    known = labels.filter("quality IS NOT NULL").groupBy(key).agg(F.min("quality").alias("quality"))
    joined = cut(stats.join(known, key).filter(
        (F.col("n_words") >= MIN_WORDS)
        & (100 * F.col("n_repeat_words") <= MAX_REPEAT_PERCENT * F.col("n_words"))))
    sample = (
        joined.orderBy(F.xxhash64(key, F.lit(SEED)), *FEATURES).limit(SAMPLE_ROWS)
        .select(*FEATURES).toPandas().to_numpy(float)
    )
    if len(sample) < 2:
        return Rules([])
    grown = [(columns, Forest.grown(sample[:, columns])) for columns in FORESTS]
    limits = [calibrated(good, bad, 1 / len(FORESTS)) for bad, good in histogram(joined, grown)]
    return Rules([(*x, limit) for x, limit in zip(grown, limits) if limit < 1])


def calibrated(good: np.ndarray, bad: np.ndarray, share: float = 1.0) -> float:
    """The score from which on rejection loses few good rows, ``share`` of those that may be lost; 1 if there is none.

    Of all bins with the same outcome as the lowest one allowed, the middle one is taken.
    """
    lost, caught = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    allowed = (lost <= share * (1 - KEEP) * good.sum()) & (caught >= PRECISION * (lost + caught)) & (caught > 0)
    if not allowed.any():
        return 1.0
    first = int(np.argmax(allowed))
    same = np.flatnonzero((lost == lost[first]) & (caught == caught[first]))
    return float(same.mean()) / len(good)


def verdicts(stats: DataFrame, rules: Rules) -> DataFrame:
    """``stats`` with base_failed, score and kept."""
    names = stats.columns
    sent = shared(stats.sparkSession, rules)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy() for c in COUNTS + FEATURES}
            base, score = failed(columns), sent().score(features_of(columns))
            yield pa.record_batch(
                [*batch.columns, pa.array(base), pa.array(score), pa.array(~base & (score < LIMIT))],
                names=[*names, "base_failed", "score", "kept"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema)
    return stats.mapInArrow(judged, schema + ", base_failed boolean, score double, kept boolean")


def quality(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, ``base_failed``, ``score`` and ``kept`` of every row of ``documents(key, text)``."""
    stats = cut(rule_statistics(documents, key))
    rules = fit_rules(stats, labels, key)
    return verdicts(stats, rules).select(key, *COUNTS, "base_failed", "kept", "score")


def kept_documents(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``documents`` that the rules keep, columns unchanged.

    The statistics are worked out again where the text is, so no text is shuffled.
    """
    rules = fit_rules(cut(rule_statistics(documents, key)), labels, key)
    sent = shared(documents.sparkSession, rules)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            stats = statistics_of(texts)
            keep = ~failed(stats) & (sent().score(features_of(stats)) < LIMIT)
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(tidy(chosen), documents.schema)
