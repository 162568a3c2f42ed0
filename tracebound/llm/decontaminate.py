"""Benchmark decontamination by winnowed fingerprints (operator 5).

Every run of ``K`` words is hashed, and of every ``WINDOW - K + 1`` neighbouring hashes the
smallest are kept. Two texts that share ``WINDOW`` words then share a kept hash, so a join of
the kept hashes finds every shared window. Hits are extended word by word to both sides; an
extended span of ``WINDOW`` words or more is contaminated text.

The benchmark is cut into blocks of a bounded number of words. Each block is a sorted
fingerprint table that is broadcast, and documents pass all blocks in one scan without a
shuffle. More benchmark means more blocks, never a larger one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import (
    covered, grams, index_words, pieces, shared, starts_inside, sum_by_text, tidy)

WINDOW, K = 13, 5
#: Benchmark words in one broadcast block (about 40 MB of tables).
BLOCK_WORDS = 1_000_000

#: A-Z to a-z, and every ASCII byte that is neither a letter nor a digit to a blank.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def fold_split(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    numbers, offsets, words = index_words(texts, fold_split)
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    return (table[numbers] if words else np.empty(0, np.uint64)), offsets


def winnow(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, values) of the smallest k-gram hashes of all windows, ties included."""
    values = grams(hashes, K)
    span = WINDOW - K + 1
    count = len(values) - span + 1
    if count <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    least = values[:count].copy()
    for j in range(1, span):
        np.minimum(least, values[j:j + count], out=least)
    inside = starts_inside(offsets, WINDOW, count)
    chosen = np.zeros(len(values), bool)
    for j in range(span):
        chosen[j:j + count] |= inside & (values[j:j + count] == least)
    at = np.flatnonzero(chosen)
    return at, values[at]


class Block:
    """Fingerprints of some benchmark items."""

    def __init__(self, ids: list[str], words: list[np.ndarray]):
        self.ids = ids
        self.offsets = np.cumsum([0, *map(len, words)])
        self.words = np.concatenate([np.empty(0, np.uint64), *words])
        at, values = winnow(self.words, self.offsets)
        order = np.argsort(values, kind="stable")
        self.values, self.at = values[order], at[order]
        self.item = np.searchsorted(self.offsets, self.at, "right") - 1
        lengths = np.diff(self.offsets)
        self.short = {}
        for n in range(1, WINDOW):
            items = np.flatnonzero(lengths == n)
            if len(items):
                whole = grams(self.words, n)[self.offsets[items]]
                order = np.argsort(whole, kind="stable")
                self.short[n] = whole[order], items[order]

    def hits(self, hashes: np.ndarray, offsets: np.ndarray):
        """(starts, ends, items) of all contaminated spans."""
        found = [(np.empty(0, np.int64),) * 3]
        at, values = winnow(hashes, offsets)
        where, rank = matches(self.values, values)
        found.append(self.extended(hashes, offsets, at[where], self.at[rank], self.item[rank]))
        for n, (whole, items) in self.short.items():
            values = grams(hashes, n)
            where = np.flatnonzero(starts_inside(offsets, n, len(values)))
            near, rank = matches(whole, values[where])
            starts = where[near]
            found.append((starts, starts + n, items[rank]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def extended(self, hashes, offsets, here, there, item):
        """Grow each pair of equal places to both sides and keep spans of ``WINDOW`` words."""
        text = np.searchsorted(offsets, here, "right") - 1
        first, last = offsets[text], offsets[text + 1]
        shift = there - here
        low, high = self.offsets[item], self.offsets[item + 1]
        starts, ends = here.copy(), here.copy()
        live = np.arange(len(here))
        while len(live):
            e = ends[live]
            live = live[(e < last[live]) & (e + shift[live] < high[live])]
            live = live[hashes[ends[live]] == self.words[ends[live] + shift[live]]]
            ends[live] += 1
        live = np.arange(len(here))
        while len(live):
            s = starts[live] - 1
            live = live[(s >= first[live]) & (s + shift[live] >= low[live])]
            live = live[hashes[starts[live] - 1] == self.words[starts[live] - 1 + shift[live]]]
            starts[live] -= 1
        keep = ends - starts >= WINDOW
        spans = np.unique(np.stack([starts[keep], ends[keep], item[keep]]), axis=1)
        return spans[0], spans[1], spans[2]


def matches(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into values, index into the sorted table) of all equal pairs."""
    low = np.searchsorted(table, values, "left")
    hit = np.flatnonzero(low < len(table))
    hit = hit[table[low[hit]] == values[hit]]
    counts = np.searchsorted(table, values[hit], "right") - low[hit]
    where = np.repeat(hit, counts)
    inner = np.arange(len(where)) - np.repeat(np.cumsum(counts) - counts, counts)
    return where, low[where] + inner


def items_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in pieces(batches):
        hashes, offsets = word_hashes(texts)
        words = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.record_batch([batch.column("item_id"), pa.array(words, pa.binary())],
                              names=["item_id", "words"])


def benchmark_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list:
    """Broadcast blocks of the benchmark; the driver holds one block at a time."""
    hashed = (
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                         "text")
        .mapInArrow(items_of, "item_id string, words binary")
        .filter(F.length("words") > 0)
    )
    total = hashed.agg(F.sum(F.length("words"))).first()[0] or 0
    count = -(-total // (8 * block_words))
    out = []
    for k in range(count):
        part = hashed.filter(F.pmod(F.xxhash64("words"), F.lit(count)) == k).toArrow()
        words = [np.frombuffer(x, np.uint64) for x in part.column("words").to_pylist()]
        out.append(shared(benchmark.sparkSession, Block(part.column("item_id").to_pylist(), words)))
    return out


def judged(texts: list[bytes], blocks: list) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """(which words are hit, text offsets, items with hits per text)."""
    hashes, offsets = word_hashes(texts)
    hit, named = np.zeros(len(hashes), bool), [set() for _ in texts]
    for block in blocks:
        starts, ends, item = block().hits(hashes, offsets)
        hit |= covered(starts, ends, len(hashes))
        text = np.searchsorted(offsets, starts, "right") - 1
        for t, i in set(zip(text.tolist(), item.tolist())):
            named[t].add(block().ids[i])
    return hit, offsets, named


def runs_of(hit: np.ndarray, offsets: np.ndarray) -> list[list]:
    """Hit words of each text as [start, end) pairs."""
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    runs: list[list] = [[] for _ in offsets[1:]]
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
        text = int(np.searchsorted(offsets, s, "right")) - 1
        while s < e:  # a run may go on in the next text
            stop = min(e, int(offsets[text + 1]))
            if stop > s:
                runs[text].append([s - int(offsets[text]), stop - int(offsets[text])])
            s, text = stop, text + 1
    return runs


def contamination(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id",
                  share: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Shared ``WINDOW``-word passages of ``documents(key, text)`` and ``benchmark(item_id, text)``.

    One row per document row: the key, n_words, n_hit, n_items, items_sha256, contaminated
    (``n_hit > 0 and share * n_hit >= n_words``), and the hit spans as word positions.
    Null and empty texts have no words and no hits; repeated rows are judged one by one; equal
    items each count; a null item id is the empty string; an empty benchmark hits nothing.
    Only the named columns are read, so other columns may have any name.
    """
    blocks = benchmark_blocks(benchmark, block_words)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            hit, offsets, named = judged(texts, blocks)
            n_words, n_hit = np.diff(offsets), sum_by_text(hit, offsets)
            yield pa.record_batch([
                batch.column(key),
                pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                pa.array([len(x) for x in named], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in named]),
                pa.array((n_hit > 0) & (share * n_hit >= n_words)),
                pa.array(runs_of(hit, offsets), pa.list_(pa.list_(pa.int64()))),
            ], names=[key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(
        tidy(judge), f"`{key}` {kind}, n_words bigint, n_hit bigint, n_items bigint, "
               "items_sha256 string, contaminated boolean, spans array<array<bigint>>")


def clean_documents(documents: DataFrame, benchmark: DataFrame, share: int = 20,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``documents`` that are not contaminated, columns unchanged."""
    blocks = benchmark_blocks(benchmark, block_words)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            hit, offsets, _ = judged(texts, blocks)
            n_hit = sum_by_text(hit, offsets)
            yield batch.filter(pa.array(~((n_hit > 0) & (share * n_hit >= np.diff(offsets)))))

    return documents.mapInArrow(tidy(chosen), documents.schema)
