"""SimHash near-duplicates through Gray-ordered hierarchical indexes (operator 6).

Fingerprints that differ in at most ``DISTANCE`` bits agree on at least one of ``DISTANCE + 1``
parts, so each distinct fingerprint joins one group per part. A group is sorted by Gray rank,
where neighbours differ in few bits, and a tree is laid over it: a node keeps the bits on which
all its members agree, and a child only those that its parent does not fix yet. A query walks
down and adds up differences node by node; when the sum passes ``DISTANCE`` the whole branch
is left out.

Groups that are too large for one task are split by the same rule on the bits that their
members do not share, so that no group outgrows ``GROUP`` and no link is lost. A fingerprint has at
most 2,080 neighbours, whatever the corpus; a group returns one link per member, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import pieces, tidy
from tracebound.llm.components import components
from tracebound.plans.lineage import cut

SHINGLE, SEED, DISTANCE = 3, 42, 2
#: Distinct fingerprints in one index; groups above it are split.
GROUP = 8192
FANOUT = 8
#: Query-node pairs that a task looks at together.
FRONTIER = 1 << 20


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the lower-cased words; a text without words is zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words)))
    n = min(SHINGLE, len(words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[n - 1:])), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at:at + (1 << 15)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def fingerprints(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fp) per row; the fingerprint is a signed 64-bit number."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(key), pa.array(values)], names=[key, "fp"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(tidy(hashed), f"`{key}` {kind}, fp bigint")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def parts_of(mask: int) -> list[int]:
    """The bits outside ``mask`` in ``DISTANCE + 1`` runs of about equal size."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (DISTANCE + 1) for k in range(DISTANCE + 2)]
    return [sum(1 << b for b in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the order of the reflected Gray code."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Trees over fingerprints sorted by (group, Gray rank), one tree per group."""

    def __init__(self, values: np.ndarray, firsts: np.ndarray):
        self.values = values
        self.levels = [(values, ~np.zeros(len(values), np.uint64), np.arange(len(values) + 1))]
        union, shared, last = values, values, np.arange(1, len(values) + 1)
        self.last = [last]
        starts = firsts  # of each group, in nodes of the level below
        while True:
            ends = np.append(starts[1:], len(shared))
            sizes = ends - starts
            offset = np.arange(len(shared)) - np.repeat(starts, sizes)
            heads = np.flatnonzero(offset % FANOUT == 0)
            shared = np.bitwise_and.reduceat(shared, heads)
            union = np.bitwise_or.reduceat(union, heads)
            last = np.maximum.reduceat(last, heads)
            self.levels.append((shared, ~(shared ^ union), np.append(heads, len(offset))))
            self.last.append(last)
            starts = np.searchsorted(heads, starts)
            if (sizes <= FANOUT).all():
                break
        self.group_size = np.diff(np.append(firsts, len(values)))
        self.root = np.repeat(np.arange(len(firsts)), self.group_size)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of one group at most ``DISTANCE`` bits apart."""
        work = np.cumsum(np.repeat(self.group_size, self.group_size))
        at = 0
        while at < len(self.values):
            before = work[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(work, before + FRONTIER, "right")))
            yield self.near(np.arange(at, end))
            at = end

    def near(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        node, query = self.root[queries], queries
        value, mask, _ = self.levels[-1]
        apart = np.bitwise_count((self.values[query] ^ value[node]) & mask[node]).astype(np.int64)
        for level in range(len(self.levels) - 1, 0, -1):
            live = (apart <= DISTANCE) & (self.last[level][node] > query + 1)
            node, query, apart = node[live], query[live], apart[live]
            child = self.levels[level][2]
            counts = child[node + 1] - child[node]
            fixed = np.repeat(self.levels[level][1][node], counts)
            inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            below = np.repeat(child[node], counts) + inner
            query, apart = np.repeat(query, counts), np.repeat(apart, counts)
            value, mask, _ = self.levels[level - 1]
            node = below
            apart += np.bitwise_count((self.values[query] ^ value[node]) & mask[node] & ~fixed)
        live = (apart <= DISTANCE) & (node > query)
        return query[live], node[live]


def linked(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Smallest position that each position is connected to."""
    label = np.arange(len(values))
    for a, b in GrayIndex(values, firsts).links():
        while len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            differ = low < high
            a, b = a[differ], b[differ]
            np.minimum.at(label, high[differ], low[differ])
            while (label[label] != label).any():
                label = label[label]
    return label


def index_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside the groups of a partition that is sorted by (mask, part)."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> pa.RecordBatch:
        values = rows[:, 2].view(np.uint64)
        order = np.lexsort((gray_rank(values), rows[:, 1], rows[:, 0]))
        rows, values = rows[order], np.ascontiguousarray(values[order])
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        label = linked(values, np.flatnonzero(new))
        moved = label != np.arange(len(label))
        return pa.record_batch(
            [pa.array(rows[moved, 2]), pa.array(rows[label[moved], 2])], names=["u", "v"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("mask", "part", "fp")], axis=1)
        held.append(np.ascontiguousarray(rows))
        if sum(map(len, held)) >= 100_000:
            rows = np.concatenate(held)
            open_group = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            end = open_group[-1] + 1 if len(open_group) else 0
            held = [rows[end:]]
            if end:
                yield links(rows[:end])
    if held and len(rows := np.concatenate(held)):
        yield links(rows)


def similar(distinct: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (u, v) that connect exactly the fingerprints linked through ``DISTANCE`` bits."""
    masks = [0]
    parent, ready = distinct.select("fp", F.lit(0).cast("long").alias("mask")), []
    while True:
        below = F.create_map(*[x for m in masks for x in (
            F.lit(signed(m)), F.array(*[F.lit(signed(m | p)) for p in parts_of(m)]))])
        masks = sorted({m | p for m in masks for p in parts_of(m)})
        rows = (
            parent.select("fp", F.explode(below[F.col("mask")]).alias("mask"))
            .withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        )
        sizes = rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = cut(rows.join(sizes, ["mask", "part"]))
        ready.append(rows.filter(F.col("n") <= group))
        if bin(masks[0]).count("1") > 50 or rows.filter(F.col("n") > group).isEmpty():
            ready.append(rows.filter(F.col("n") > group))  # none, or a few thousand at the last level
            break
        parent = rows.filter(F.col("n") > group).select("fp", "mask")
    out = None
    for rows in ready:
        found = (
            rows.select("mask", "part", "fp").repartition("mask", "part")
            .sortWithinPartitions("mask", "part")
            .mapInArrow(tidy(index_groups), "u bigint, v bigint")
        )
        out = found if out is None else out.unionByName(found)
    return out


def near_duplicates(documents: DataFrame, key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """Fingerprint and component of every row of ``documents(key, text)``.

    Returns the key, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest key that can be
    reached over links, the row itself included). Null and empty texts have fingerprint zero and are
    linked like any other; texts below three words are one shingle; repeated rows stay; a null key
    is ignored when the smallest is chosen. Other columns are not read.
    """
    rows = cut(fingerprints(documents, key))
    return rows.join(groups(rows, key, group), "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def groups(rows: DataFrame, key: str, group: int = GROUP) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``rows(key, fp)``."""
    distinct = rows.groupBy("fp").agg(F.min(key).alias("__first"))
    roots = components(similar(distinct.select("fp"), group)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("__first").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def one_of_each(documents: DataFrame, key: str = "doc_id", group: int = GROUP) -> DataFrame:
    """One row of every group of near-duplicates, the one with the smallest key; columns unchanged.

    Winners are chosen on (key, digest of the row) pairs; equal rows are one row.
    """
    whole = [F.col(f"`{c}`") for c in documents.columns]
    digest = F.xxhash64(*whole, *[c.isNull() for c in whole])
    small = documents.select(F.col(key).alias("__key"), digest.alias("__digest"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            values = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column("__key"), batch.column("__digest"), pa.array(values)],
                                  names=["__key", "__digest", "fp"])

    kind = documents.schema[key].dataType.simpleString()
    rows = cut(small.mapInArrow(tidy(hashed), f"__key {kind}, __digest bigint, fp bigint"))
    # per fingerprint first, so that a group of copies is one row before the join
    least = rows.groupBy("fp").agg(F.min(F.struct(F.col("__key").isNull(), "__key", "__digest")).alias("__least"))
    winners = (
        least.join(groups(rows, "__key", group), "fp").groupBy("root").agg(F.min("__least").alias("__least"))
        .select("__least.__digest", F.col("__least.__key").alias("__key"))
    )
    marked = documents.select(F.struct(*whole).alias("__row"), F.col(key).alias("__id"), digest.alias("__d"))
    on = (marked["__d"] == winners["__digest"]) & marked["__id"].eqNullSafe(winners["__key"])
    return marked.join(winners, on, "left_semi").dropDuplicates(["__d", "__id"]).select("__row.*")
