"""Substring dedup with suffix automata (operator 2).

A suffix automaton of reference text recognises every substring of it. A document is streamed
through it word by word; the matching statistic of a word is the longest run that ends there and
occurs in the reference, and runs of ``WINDOW`` words or more are removed.

Two forms share the automaton:

* ``remove_references``: a reference corpus is cut into shards of a bounded number of words, one
  automaton per shard is broadcast, and documents pass all of them in one scan.
* ``repeats``: the corpus against itself. One automaton of everything would not fit anywhere, and
  all documents against all shards is quadratic, so the reference is sharded by content: the
  smallest hash among the ``GRAM``-word runs of a window is its anchor, equal windows have equal
  anchors, and only anchors that occur twice matter. The distinct passages around one anchor are
  a reference; its automaton also counts, so it tells which windows occur twice or more in all.
  Equal passages are one row with a count before they meet, however many copies there are.

An anchor with more than ``PASSAGES`` different passages (a phrase that a large part of the
corpus has in changing surroundings) is not brought into one task: its windows are counted by
128-bit digests, which Spark can pre-aggregate and spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import covered, grams, index_words, mixed, pieces, shared, starts_inside, sum_by_text
from tracebound.plans.lineage import cut

WINDOW, GRAM = 35, 8
#: Different passages of one anchor that share an automaton.
PASSAGES = 2000
#: Numbers that may be broadcast (8 bytes each); up to ``BITMAP`` times as many go as bits of a
#: table of that size in all, and more are joined.
BROADCAST_ANCHORS, BITMAP = 4_000_000, 16
#: Bits of the table are 2 to this power, in blocks of 2 to the second.
BITS, BLOCK_BITS = 28, 18
#: Bytes of text whose windows are laid out together.
PIECE = 4 << 20
#: Words of reference text in one broadcast automaton (about 60 MB).
SHARD_WORDS = 100_000


class SuffixAutomaton:
    """Of one or more sequences; ``weight`` says how often each of them occurs."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words, weight: int = 1) -> None:
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for word in words:
            known = nexts[last].get(word)
            if known is not None and length[known] == length[last] + 1:
                last = known
                count[last] += weight
                continue
            new = len(nexts)
            if known is None:
                nexts.append({})
                link.append(0)
                length.append(length[last] + 1)
                count.append(weight)
                at = last
                while at >= 0 and word not in nexts[at]:
                    nexts[at][word] = new
                    at = link[at]
                if at >= 0:
                    other = nexts[at][word]
                    link[new] = other if length[at] + 1 == length[other] else self._split(at, word, other)
                last = new
            else:
                last = self._split(last, word, known)
                count[last] += weight

    def _split(self, at: int, word, other: int) -> int:
        """A state for the shorter strings of ``other`` that are reached over ``at``."""
        nexts, link, length = self.next, self.link, self.length
        copy = len(nexts)
        nexts.append(dict(nexts[other]))
        link.append(link[other])
        length.append(length[at] + 1)
        self.count.append(0)
        link[other] = copy
        while at >= 0 and nexts[at].get(word) == other:
            nexts[at][word] = copy
            at = link[at]
        return copy

    def total(self) -> None:
        """Turn the counts of added prefixes into the occurrences of every state."""
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for state in order:
            self.count[self.link[state]] += self.count[state]

    def statistics(self, words) -> Iterator[tuple[int, int]]:
        """(matched length, state) after each word."""
        state = matched = 0
        nexts, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            step = nexts[state].get(word)
            if step is not None:
                state, matched = step, matched + 1
            yield matched, state

    def occurrences(self, words, window: int) -> list[int]:
        """How often each run of ``window`` words occurs in what was added."""
        out = []
        for k, (matched, state) in enumerate(self.statistics(words)):
            if k + 1 >= window:
                if matched < window:
                    out.append(0)
                    continue
                while self.length[self.link[state]] >= window:
                    state = self.link[state]
                out.append(self.count[state])
        return out


# --- words and anchors ---------------------------------------------------------------------

def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    numbers, offsets, words = index_words(texts)
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    return (table[numbers] if words else np.empty(0, np.uint64)), offsets


def anchors_of(hashes: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(first word of each window, position of its anchor, hash of the anchor).

    The anchor is the leftmost of the runs with the smallest 40-bit hash.
    """
    values = grams(hashes, gram)
    span = window - gram + 1
    n = len(values) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.empty(n, np.int64)
    low = np.uint64(24)
    for first in range(0, n, 1 << 23):
        part = values[first:first + (1 << 23) + span - 1]
        keyed = (part >> low << low) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            keyed = np.minimum(keyed[:-width], keyed[width:])
            width *= 2
        rest = span - width
        keyed = np.minimum(keyed[:len(keyed) - rest], keyed[rest:]) if rest else keyed
        count = min(1 << 23, n - first)
        at[first:first + count] = first + (keyed[:count] & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.flatnonzero(starts_inside(offsets, window, n))
    at = at[starts]
    return starts, at, values[at]


def row_keys(keys: list, texts: list[bytes]) -> np.ndarray:
    """A number per (key, text); equal rows share it and get equal results."""
    return np.array([xxhash.xxh3_64_intdigest(repr(k).encode() + b"\0" + t) for k, t in zip(keys, texts)],
                    np.uint64).view(np.int64)


def in_sorted(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def places_of(values: np.ndarray) -> np.ndarray:
    """The bit of each number."""
    return (mixed(values.view(np.uint64)) >> np.uint64(64 - BITS)).astype(np.int64)


def member_test(numbers: DataFrame, limit: int) -> Callable[[np.ndarray], np.ndarray] | None:
    """Tells tasks which values may be in ``numbers(bigint)``; ``None`` if there are too many.

    All that are in it pass. Above ``limit`` a few others pass too: at ``BITMAP * limit`` numbers, a
    quarter of them. The driver gets the sorted numbers or the bits, no more than 32 MB of either.
    """
    count, (name,) = numbers.count(), numbers.columns
    if count <= limit:
        known = shared(numbers.sparkSession, np.sort(numbers.toArrow().column(name).to_numpy().view(np.uint64)))
        return lambda values: in_sorted(known(), values.view(np.uint64))
    if count > BITMAP * limit:
        return None

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places_of(batch.column(0).to_numpy())
            yield pa.record_batch([pa.array(at >> BLOCK_BITS), pa.array(at)], names=["block", "at"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bits = None, None

        def row() -> pa.RecordBatch:
            return pa.record_batch([pa.array([block], pa.int64()), pa.array([np.packbits(bits).tobytes()], pa.binary())],
                                   names=["block", "bits"])

        for batch in batches:
            blocks, at = (batch.column(k).to_numpy() for k in (0, 1))
            for b in np.unique(blocks).tolist():  # ascending, as the rows are
                if b != block:
                    if bits is not None:
                        yield row()
                    block, bits = b, np.zeros(1 << BLOCK_BITS, bool)
                bits[at[blocks == b] & (1 << BLOCK_BITS) - 1] = True
        if bits is not None:
            yield row()

    table = np.zeros(1 << BITS - 3, np.uint8)
    rows = (numbers.mapInArrow(placed, "block bigint, at bigint").repartition("block")
            .sortWithinPartitions("block").mapInArrow(packed, "block bigint, bits binary"))
    for found in rows.toLocalIterator():
        begin = found.block << BLOCK_BITS - 3
        table[begin:begin + len(found.bits)] = np.frombuffer(found.bits, np.uint8)
    bitmap = shared(numbers.sparkSession, table)

    def test(values: np.ndarray) -> np.ndarray:
        at = places_of(values)
        return bitmap().take(at >> 3) >> (7 - (at & 7)).astype(np.uint8) & 1 == 1

    return test


def spans(starts: np.ndarray) -> list[int]:
    """The words of windows with these ascending first words: begin, end, begin, end, ..."""
    heads = np.flatnonzero(np.diff(starts, prepend=-WINDOW - 1) > WINDOW)
    ends = starts[np.append(heads[1:], len(starts)) - 1] + WINDOW
    return np.column_stack([starts[heads], ends]).ravel().tolist()


def anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in pieces(batches, limit=PIECE):
        _, at, values = anchors_of(*word_hashes(texts))
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        found, n = np.unique(values[new], return_counts=True)
        yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], names=["anchor", "n"])


PASSAGE = "row bigint, first int, anchor bigint, digest bigint, words binary"


def passages_of(keys: list, texts: list[bytes], is_repeated) -> pa.RecordBatch:
    """The windows of each repeated anchor as one passage; its words once per piece."""
    hashes, offsets = word_hashes(texts)
    starts, at, values = anchors_of(hashes, offsets)
    keep = is_repeated(starts, at, values, offsets)
    starts, at, values = starts[keep], at[keep], values[keep]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    begin = starts[heads]
    end = starts[np.append(heads[1:], len(starts))[:len(heads)] - 1] + WINDOW if len(heads) else begin
    text = np.searchsorted(offsets, begin, "right") - 1
    raw = hashes.tobytes()
    digests, words, seen = [], [], set()
    for a, b in zip(begin.tolist(), end.tolist()):
        passage = raw[8 * a:8 * b]
        digest = xxhash.xxh3_64_intdigest(passage)
        digests.append(digest)
        words.append(None if digest in seen else passage)
        seen.add(digest)
    return pa.record_batch([
        pa.array(row_keys(keys, texts)[text]), pa.array(begin - offsets[text], pa.int32()),
        pa.array(values[heads].view(np.int64)), pa.array(np.array(digests, np.uint64).view(np.int64)),
        pa.array(words, pa.binary())], names=["row", "first", "anchor", "digest", "words"])


def passages(documents: DataFrame, key: str, limit: int) -> DataFrame:
    """Passages around the anchors that occur at least twice in the corpus."""
    repeated = cut(
        documents.select("text").mapInArrow(anchor_counts, "anchor bigint, n bigint")
        .groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"))
    known = member_test(repeated, limit)
    if known is not None:

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in pieces(batches, limit=PIECE):
                yield passages_of(batch.column(key).to_pylist(), texts,
                                  lambda starts, at, values, offsets: known(values))

        return documents.select(key, "text").mapInArrow(looked_up, PASSAGE)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, limit=PIECE):
            hashes, offsets = word_hashes(texts)
            _, at, values = anchors_of(hashes, offsets)
            at, where = np.unique(at, return_index=True)
            text = np.searchsorted(offsets, at, "right") - 1
            keys = row_keys(batch.column(key).to_pylist(), texts)
            yield pa.record_batch([
                pa.array(keys[text]), pa.array(at - offsets[text], pa.int64()),
                pa.array(values[where].view(np.int64))], names=["row", "at", "anchor"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, limit=PIECE):
            lists = batch.column("places").to_pylist()

            def is_repeated(starts, at, values, offsets):
                places = np.array([p + offsets[k] for k, x in enumerate(lists) for p in x], np.int64)
                return in_sorted(np.sort(places), at)

            yield passages_of(batch.column(key).to_pylist(), texts, is_repeated)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, limit=PIECE):
            yield pa.record_batch([pa.array(row_keys(batch.column(key).to_pylist(), texts)), *batch.columns],
                                  names=["row", key, "text"])

    kind = documents.schema[key].dataType.simpleString()
    places = (
        documents.select(key, "text").mapInArrow(located, "row bigint, at bigint, anchor bigint")
        .join(repeated, "anchor").groupBy("row").agg(F.collect_set("at").alias("places"))
    )
    return (
        documents.select(key, "text").mapInArrow(keyed, f"row bigint, `{key}` {kind}, text string")
        .join(places, "row").select(key, "text", "places").mapInArrow(joined, PASSAGE)
    )


# --- which windows occur twice --------------------------------------------------------------

JUDGED = "anchor bigint, digest bigint, found array<int>"


def judge_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One automaton per anchor of a partition that is sorted by anchor."""
    anchor, group = None, []

    def judged() -> pa.RecordBatch:
        out = []
        if len(group) == 1:  # one passage: all its windows occur as often as it does
            digest, n, words = group[0]
            if n > 1:
                out.append((digest, [0, len(words) // 8]))
        else:
            automaton = SuffixAutomaton()
            lists = [np.frombuffer(words, np.uint64).tolist() for _, _, words in group]
            for (_, n, _), words in zip(group, lists):
                automaton.add(words, n)
            automaton.total()
            for (digest, _, _), words in zip(group, lists):
                found = np.flatnonzero(np.array(automaton.occurrences(words, WINDOW)) > 1)
                if len(found):
                    out.append((digest, spans(found)))
        return pa.record_batch([
            pa.array([anchor] * len(out), pa.int64()), pa.array([d for d, _ in out], pa.int64()),
            pa.array([f for _, f in out], pa.list_(pa.int32()))], names=["anchor", "digest", "found"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "words")]
        ready = []
        for a, *passage in zip(*columns):
            if a != anchor and group:
                ready.append(judged())
                group = []
            anchor = a
            group.append(tuple(passage))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
    if group:
        yield judged()


def exploded_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for anchor, digest, n, words in zip(*[batch.column(c).to_pylist() for c in ("anchor", "digest", "n", "words")]):
            for k in range(len(words) // 8 - WINDOW + 1):
                w = xxhash.xxh3_128_digest(words[8 * k:8 * (k + WINDOW)])
                rows.append((anchor, digest, k, n, w))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                              names=["anchor", "digest", "k", "n", "w"])


def joined_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [spans(np.sort(np.array(x))) for x in batch.column("found").to_pylist()]
        yield pa.record_batch([batch.column("anchor"), batch.column("digest"), pa.array(found, pa.list_(pa.int32()))],
                              names=["anchor", "digest", "found"])


def repeats(documents: DataFrame, key: str = "doc_id", most: int = PASSAGES,
            limit: int = BROADCAST_ANCHORS) -> DataFrame:
    """``row`` (see ``row_keys``) and the ``spans`` of its windows that occur twice or more."""
    found = passages(documents, key, limit)
    # words are written once per different passage; the occurrences are found again without them
    distinct = cut(found.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.max("words").alias("words")))
    crowded = cut(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("different")).filter(
        F.col("different") > most).select("anchor"))
    hot_anchors, plain = crowded.count(), distinct
    if hot_anchors:
        # one in PASSAGES of the passages at most: words need not be shuffled for them
        few = F.broadcast(crowded) if hot_anchors <= limit else crowded
        plain = distinct.join(few, "anchor", "left_anti")
    judged = (
        plain.repartition("anchor")
        .sortWithinPartitions("anchor").select("anchor", "digest", "n", "words").mapInArrow(judge_anchors, JUDGED)
    )
    if hot_anchors:
        hot = distinct.join(few, "anchor", "left_semi").select("anchor", "digest", "n", "words")
        windows = hot.mapInArrow(
            exploded_windows, "anchor bigint, digest bigint, k int, n bigint, w binary")
        twice = windows.groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1").select("w")
        judged = judged.unionByName(
            windows.join(twice, "w").groupBy("anchor", "digest").agg(F.collect_set("k").alias("found"))
            .mapInArrow(joined_windows, JUDGED))
    return (
        # a set, since repeated rows share their number
        found.select("row", "first", "anchor", "digest").join(judged, ["anchor", "digest"])
        .select("row", F.transform("found", lambda k: k + F.col("first")).alias("found"))
        .groupBy("row").agg(F.flatten(F.collect_set("found")).alias("found"))
    )


def kept_text(text: bytes, removed: np.ndarray | None) -> bytes:
    words = text.split()
    if removed is not None:
        words = [w for w, gone in zip(words, removed.tolist()) if not gone]
    return b" ".join(words)


def without_repeats(documents: DataFrame, key: str = "doc_id", texts: bool = True,
                    most: int = PASSAGES, limit: int = BROADCAST_ANCHORS) -> DataFrame:
    """``documents(key, text)`` without the words of any window that occurs twice or more.

    One row per document row: key, n_words, n_removed, kept_sha256 and, with ``texts``, the kept
    words joined by blanks. All occurrences go, the first included; windows are judged on the
    input. Null and empty texts have no words; texts below ``WINDOW`` words stay whole; repeated
    rows are copies of each other; other columns are not read; an empty table stays empty.
    """
    found = cut(repeats(documents, key, most, limit))
    kind = documents.schema[key].dataType.simpleString()
    known = member_test(found.select("row"), limit)  # None: all texts are joined

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in pieces(batches):
            rows = row_keys(batch.column(key).to_pylist(), parts)
            own = np.ones(len(rows), bool) if known is None else known(rows)
            yield pa.record_batch([pa.array(rows), *batch.columns], names=["__row", key, "text"]).filter(pa.array(own))

    def described(column: pa.Array, parts: list[bytes], lists: list) -> pa.RecordBatch:
        n, gone, kept = [], [], []
        for text, ranges in zip(parts, lists):
            count = len(text.split())
            mask = None
            if ranges:
                mask = covered(*np.array(ranges, np.int64).reshape(-1, 2).T, count)
            n.append(count)
            gone.append(0 if mask is None else int(mask.sum()))
            kept.append(kept_text(text, mask))
        columns = [column, pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                   pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        if texts:
            columns.append(pa.array([x.decode() for x in kept], pa.string()))
        return pa.record_batch(columns, names=[key, "n_words", "n_removed", "kept_sha256", "kept"][:len(columns)])

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in pieces(batches):
            yield described(batch.column(key), parts, batch.column("found").to_pylist())

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in pieces(batches):
            own = ~known(row_keys(batch.column(key).to_pylist(), parts))
            kept = [t for t, mine in zip(parts, own.tolist()) if mine]
            yield described(batch.column(key).filter(pa.array(own)), kept, [None] * len(kept))

    schema = f"`{key}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if texts else "")
    rows = documents.select(key, "text")
    joined = (
        rows.mapInArrow(keyed, f"__row bigint, `{key}` {kind}, text string")
        .join(found.withColumnRenamed("row", "__row"), "__row", "left").select(key, "text", "found")
        .mapInArrow(removed, schema)
    )
    # rows without repeats end where they are read
    return joined if known is None else joined.unionByName(rows.mapInArrow(untouched, schema))


def remove_references(documents: DataFrame, references: DataFrame, key: str = "doc_id",
                      window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``documents(key, text)`` without the spans of ``window`` words or more found in ``references(text)``.

    Returns key, n_words, n_removed, kept. Reference texts longer than a shard are cut with an
    overlap of ``window - 1`` words, so no match is lost. Null and empty texts match nothing.
    """
    spark = documents.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            hashes, offsets = word_hashes(texts)
            out = [hashes[a:min(a + shard_words, end)].tobytes()
                   for begin, end in zip(offsets[:-1], offsets[1:])
                   for a in range(begin, max(end - window + 1, begin), max(shard_words - window + 1, 1))]
            yield pa.record_batch([pa.array(out, pa.binary())], names=["words"])

    rows = cut(references.select("text").mapInArrow(hashed, "words binary").filter(
        F.length("words") >= 8 * window).distinct())
    total = rows.agg(F.sum(F.length("words"))).first()[0] or 0
    count = -(-total // (8 * shard_words))
    shards = []
    for k in range(count):
        automaton = SuffixAutomaton()
        for r in rows.filter(F.pmod(F.xxhash64("words"), F.lit(count)) == k).toLocalIterator():
            automaton.add(np.frombuffer(bytes(r.words), np.uint64).tolist())
        shards.append(shared(spark, automaton))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            hashes, offsets = word_hashes(texts)
            gone = np.zeros(len(hashes), bool)
            for shard in shards:
                for a, b in zip(offsets[:-1], offsets[1:]):
                    words = hashes[a:b].tolist()
                    found = [(k + 1 - m, k + 1) for k, (m, _) in enumerate(shard().statistics(words)) if m >= window]
                    if found:
                        starts, ends = np.array(found).T
                        gone[a:b] |= covered(starts, ends, b - a)
            kept = [kept_text(t, gone[a:b]).decode() for t, a, b in zip(texts, offsets[:-1], offsets[1:])]
            yield pa.record_batch([
                batch.column(key), pa.array(np.diff(offsets), pa.int64()),
                pa.array(sum_by_text(gone, offsets), pa.int64()), pa.array(kept)],
                names=[key, "n_words", "n_removed", "kept"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(
        streamed, f"`{key}` {kind}, n_words bigint, n_removed bigint, kept string")
