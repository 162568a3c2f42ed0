"""Context-mixing range coder for token ids.

A chunk is read twice: the first pass fits the model, which stands at the head of the chunk, the
second codes. Ids are cut into blocks of ``BLOCK``, each with a coder and a checksum of its own, so
with the model any block can be decoded alone and damage stays in its block. numpy advances all
blocks of a chunk together, one id of each per step.

Model of one chunk. The last two ids select, by hash, the id that follows them most often (order
2), the last id the one that follows it most often (order 1); each prediction has a confidence,
its share of hits in eight steps. The pair of confidences, and whether both predict the same,
selects the weights of "order 2 is right", "order 1 is right" and "neither"; this choice is the
first coded symbol. An id that neither predicted is coded by the order-0 frequencies of such ids.
A block starts as if two ids 0 stood before it.

Coder: 48-bit window, digits of 24 bits, carries added into the digits already written. Weights
and frequencies add up to powers of two. A predicted id passes the order-0 coder as a symbol of
the whole range, so that no step has to pick blocks.

Chunk: ``CMR2``, block length, number of blocks, number of ids, bytes of the model, the model,
then for all blocks the number of digits and the CRC-32 of the ids (little-endian unsigned
32-bit), then all digits. Model (zlib): four numbers of entries; hash slots, ids and confidences
of order 2; last ids, ids and confidences of order 1; ids and frequencies of order 0; weights.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
MAGIC = b"CMR2"
#: Ids and hash slots of the order-2 predictions.
IDS = SLOTS = 1 << 16
#: Hits from which a prediction pays for its entry in the model.
HITS = 8
#: Bits of the sums of weights and of order-0 frequencies.
MIX, FLAT = 12, 18
ROWS = 128
U = np.uint64
DIGIT, LOW24, SMALL = U(24), U((1 << 24) - 1), U(1 << 24)


def slots(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Hash slot of two ids, given as unsigned 32-bit numbers."""
    return (last * np.uint32(0x9E3779B1) ^ before * np.uint32(0x85EBCA6B)) >> np.uint32(16)


def predictions(contexts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, its most frequent id, confidence 1 to 7) where that id was hit often enough."""
    pairs = np.sort(contexts << np.uint32(16) | ids)
    heads = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
    hits = np.diff(np.append(heads, len(pairs)))
    context = pairs[heads] >> np.uint32(16)
    first = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(heads) else heads
    if not len(first):
        return context, context, context
    best, seen = np.maximum.reduceat(hits, first), np.add.reduceat(hits, first)
    place = np.where(hits == np.repeat(best, np.diff(np.append(first, len(heads)))), np.arange(len(heads)), len(heads))
    chosen = np.minimum.reduceat(place, first)
    trust = np.minimum(1 + best * 8 // seen, 7)
    kept = (best >= HITS) & (best * 16 >= seen)
    chosen = chosen[kept]
    return context[chosen], pairs[heads[chosen]] & np.uint32(IDS - 1), trust[kept]


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Rows of counts as frequencies that add up to ``1 << bits``; what occurs keeps one at least."""
    counts = counts.astype(np.int64)
    some = counts > 0
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    room = (1 << bits) - some.sum(1, keepdims=True)
    out = np.where(some, 1 + counts * room // total, 0)
    out[np.arange(len(out)), counts.argmax(1)] += (1 << bits) - out.sum(1)
    return out


class Model:
    """Tables of one chunk."""

    def __init__(self, two, one, flat, weights):
        """``two`` and ``one``: see ``predictions``; ``flat``: ids and frequencies; ``weights``: per row three."""
        self.parts = (two, one, flat, weights)
        # id * 8 + confidence; an id that none has where there is no prediction
        self.two, self.one = np.full(SLOTS, IDS << 3, np.int64), np.full(IDS, IDS << 3, np.int64)
        for table, (context, guess, trust) in ((self.two, two), (self.one, one)):
            table[context] = guess.astype(np.int64) << 3 | trust
        self.freq = np.zeros(IDS, np.int64)
        self.freq[flat[0]] = flat[1]
        self.start = np.cumsum(self.freq) - self.freq
        self.weight = weights.reshape(-1)
        self.below = (np.cumsum(weights, 1) - weights).reshape(-1)

    @classmethod
    def of(cls, ids, last, before) -> tuple[Model, np.ndarray, np.ndarray]:
        """The model of a chunk, and for each id its cell of weights and whether order 0 codes it."""
        two, one = predictions(slots(last, before), ids), predictions(last, ids)
        model = cls(two, one, (ids[:0], ids[:0]), np.zeros((ROWS, 3), np.int64))
        row, second, first = model.rows(last, before)
        kind = np.where(ids == second, 0, np.where(ids == first, 1, 2))
        cell = row * 3 + kind
        weights = scaled(np.bincount(cell, minlength=3 * ROWS).reshape(ROWS, 3), MIX)
        freq = scaled(np.bincount(ids[kind == 2], minlength=IDS)[None], FLAT)[0]
        used = np.flatnonzero(freq)
        return cls(two, one, (used, freq[used]), weights), cell, kind == 2

    def rows(self, last, before):
        """(row of weights, order-2 id, order-1 id)"""
        two, one = self.two.take(slots(last, before)), self.one.take(last)
        second, first = two >> 3, one >> 3
        return ((two & 7) << 3) + (one & 7) + ((second == first) << 6), second, first

    def packed(self) -> bytes:
        two, one, flat, weights = self.parts
        sizes = np.array([len(two[0]), len(one[0]), len(flat[0]), 0], "<u4")
        kinds = ("<u2", "<u2", "u1") * 2 + ("<u2", "<u4", "<u2")
        return zlib.compress(sizes.tobytes() + b"".join(
            np.asarray(x).astype(kind).tobytes() for x, kind in zip((*two, *one, *flat, weights), kinds)), 1)

    @classmethod
    def unpacked(cls, data: bytes) -> Model:
        try:
            raw = zlib.decompress(data)
        except zlib.error as error:
            raise ValueError("the model of a chunk is damaged") from error
        a, b, c, _ = np.frombuffer(raw, "<u4", 4).tolist()
        at, out = 16, []
        for n, kind in ((a, "<u2"), (a, "<u2"), (a, "u1"), (b, "<u2"), (b, "<u2"), (b, "u1"),
                        (c, "<u2"), (c, "<u4"), (3 * ROWS, "<u2")):
            values = np.frombuffer(raw, kind, n, at)
            at += values.nbytes
            out.append(values.astype(np.int64))
        return cls(out[:3], out[3:6], out[6:8], out[8].reshape(ROWS, 3))


def checksums(ids: np.ndarray, block: int) -> list[int]:
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return [zlib.crc32(raw[4 * k:4 * (k + block)]) for k in range(0, len(ids), block)]


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A chunk that holds ``ids``."""
    ids = np.ascontiguousarray(ids, np.int32)
    if not len(ids):
        return MAGIC + np.array([block, 0, 0, 0], "<u4").tobytes()
    if ids.min() < 0 or ids.max() >= IDS:
        raise ValueError("ids have 16 bits")
    n, count = -(-len(ids) // block), min(block, len(ids))
    filled_up = np.zeros(n * count, np.int32)  # the last block with ids 0
    filled_up[:len(ids)] = ids
    steps = np.zeros((count + 2, n), np.uint32)
    steps[2:] = filled_up.reshape(n, count).T
    now, last, before = (steps[k:k + count].reshape(-1) for k in (2, 1, 0))
    model, cell, flat = Model.of(now, last, before)
    shape = (count, n)
    symbols = (
        (U(MIX), model.below.astype(np.uint32).take(cell).reshape(shape),
         model.weight.astype(np.uint32).take(cell).reshape(shape)),
        (U(FLAT), np.where(flat, model.start.astype(np.uint32).take(now), np.uint32(0)).reshape(shape),
         np.where(flat, model.freq.astype(np.uint32).take(now), np.uint32(1 << FLAT)).reshape(shape)),
    )
    low, span = np.zeros(n, U), np.full(n, 1 << 48, U)
    out, filled = np.zeros((n, 2 * count + 4), np.uint32), np.zeros(n, np.int64)
    for t in range(count):
        for bits, starts, freqs in symbols:
            span >>= bits
            low += span * starts[t]
            span *= freqs[t]
            short = np.flatnonzero(span < SMALL)
            if len(short):
                value, at = low.take(short), filled.take(short)
                out[short, at] = value >> DIGIT
                filled[short] = at + 1
                low[short] = (value & LOW24) << DIGIT
                span[short] <<= DIGIT
    every = np.arange(n)
    for _ in range(2):
        out[every, filled] = low >> DIGIT
        filled += 1
        low = (low & LOW24) << DIGIT
    out = out[:, :filled.max()]
    while True:
        lane, at = np.nonzero(out > LOW24)
        if not len(lane):
            break
        out[lane, at] &= np.uint32(LOW24)
        out[lane, at - 1] += np.uint32(1)
    kept = out[np.arange(out.shape[1]) < filled[:, None]].astype("<u4")
    body = np.ascontiguousarray(kept.view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    fitted = model.packed()
    return (MAGIC + np.array([block, n, len(ids), len(fitted)], "<u4").tobytes() + fitted
            + np.array([filled, checksums(ids, block)], "<u4").tobytes() + body)


def decode(chunk: bytes) -> np.ndarray:
    """The ids of a chunk; raises ``ValueError`` when a checksum does not hold."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of ids")
    block, n, size, fitted = np.frombuffer(chunk, "<u4", 4, 4).tolist()
    if not n:
        return np.empty(0, np.int32)
    model = Model.unpacked(chunk[20:20 + fitted])
    lengths, sums_read = np.frombuffer(chunk, "<u4", 2 * n, 20 + fitted).reshape(2, n)
    if 3 * int(lengths.sum()) != len(chunk) - 20 - fitted - 8 * n:
        raise ValueError("a chunk is not whole")
    body = np.frombuffer(chunk, np.uint8, offset=20 + fitted + 8 * n).reshape(-1, 3)
    digits = body[:, 0].astype(np.uint32) | body[:, 1].astype(np.uint32) << 8 | body[:, 2].astype(np.uint32) << 16
    digits = np.concatenate([digits, np.zeros(4, np.uint32)]).astype(U)
    at = np.concatenate([[0], np.cumsum(lengths[:-1], dtype=np.int64)])
    code, span = digits[at] << DIGIT | digits[at + 1], np.full(n, 1 << 48, U)
    at += 2
    end = len(digits) - 1
    count = min(block, size)
    steps = np.empty((count, n), np.uint32)
    weight, below = model.weight.astype(U), model.below.astype(U)
    second_from, third_from = below.reshape(ROWS, 3).T[1:].copy()
    freq, start = np.append(model.freq, 1 << FLAT).astype(U), np.append(model.start, 0).astype(U)
    meant = np.repeat(np.arange(IDS, dtype=np.int64), model.freq)  # of a value of the order-0 coder
    mix, flat, most, last_value = U(MIX), U(FLAT), U((1 << MIX) - 1), U((1 << FLAT) - 1)

    def renewed():
        short = np.flatnonzero(span < SMALL)
        if len(short):
            place = at.take(short)
            code[short] = code.take(short) << DIGIT | digits.take(np.minimum(place, end))
            at[short] = place + 1
            span[short] <<= DIGIT

    last, before = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for t in range(count):
        row, second, first = model.rows(last, before)
        np.right_shift(span, mix, out=span)
        value = np.minimum(code // np.maximum(span, U(1)), most)
        kind = (value >= second_from.take(row)).astype(np.int64) + (value >= third_from.take(row))
        cell = row * 3 + kind
        np.subtract(code, span * below.take(cell), out=code)
        np.multiply(span, weight.take(cell), out=span)
        renewed()
        np.right_shift(span, flat, out=span)
        value = np.minimum(code // np.maximum(span, U(1)), last_value)
        known = kind < 2
        x = meant.take(value.view(np.int64))
        symbol = np.where(known, IDS, x)
        np.subtract(code, span * start.take(symbol), out=code)
        np.multiply(span, freq.take(symbol), out=span)
        renewed()
        x = np.where(known, np.where(kind == 0, second, first), x).astype(np.uint32)
        steps[t] = x
        before, last = last, x & np.uint32(IDS - 1)
    ids = steps.T.reshape(-1)[:size].astype(np.int32)
    for k, found in enumerate(checksums(ids, block)):
        if found != sums_read[k]:
            raise ValueError(f"checksum of block {k} does not hold")
    return ids
