"""Token counts by dynamic programming over a trie of pre-tokens (operator 7).

A pre-token is a word with a leading word mark. Its best segmentation under a unigram model only
depends on its characters from the left, so pre-tokens with a common beginning share the scores of
that beginning: a task inserts its distinct pre-tokens into a trie, works out the best score and
token count once per node, and reads the count of a pre-token at its last node.

Sorted pre-tokens enter the trie one character of all of them at a time, so that numpy scores the new
nodes of a level together. The pieces that end at a node are found by an Aho-Corasick automaton of the
vocabulary, whose state is kept with the node: only pieces that do end there are looked at.

Nothing is shuffled; each task has a trie of the words that it meets, of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracebound.llm.batches import index_words, pieces, shared, sum_by_text

MARK = "▁"
#: Trie nodes after which a task starts a new trie, also the code points inserted at once; and code points
#: above which a pre-token has no nodes.
NODES, LONG = 500_000, 2048
#: Bits of a code point in a key of (number, code point).
CHAR = 21


@dataclass
class Vocabulary:
    """Log-probabilities of pieces; a character in no piece costs ``unknown`` per UTF-8 byte."""

    scores: dict[str, float]
    longest: int
    unknown: float

    @classmethod
    def of(cls, pieces_by_rank: list[str]) -> Vocabulary:
        """Zipf's law over the ranks of the pieces: the probability falls with the rank."""
        total = sum(1 / (k + 1) for k in range(len(pieces_by_rank)))
        scores = {p: -log((k + 1) * total) for k, p in enumerate(pieces_by_rank)}
        return cls(scores, max(map(len, scores), default=1), -log(max(len(scores), 1)) - 20)

    @classmethod
    def sentencepiece(cls, path: str) -> Vocabulary:
        """The ordinary pieces of a sentencepiece file, in its order."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return cls.of([model.id_to_piece(k) for k in range(model.get_piece_size()) if not (
            model.is_byte(k) or model.is_control(k) or model.is_unknown(k) or model.is_unused(k))])

    @cached_property
    def automaton(self) -> Automaton:
        return Automaton({p: score for p, score in self.scores.items() if len(p) <= self.longest})


class Automaton:
    """Aho-Corasick automaton of the pieces; state 0 is the start.

    ``piece`` has for a state the state of the longest piece that ends there (0: none), ``shorter`` that of
    the next shorter one; ``length`` and ``score`` are those of the piece that a state spells.
    """

    def __init__(self, scores: dict[str, float]):
        edges: dict[int, int] = {}
        spelt, parent, depth, ends = [0.0], [0], [0], set()
        for text, score in scores.items():
            state = 0
            for char in text:
                key = state << CHAR | ord(char)
                below = edges.get(key)
                if below is None:
                    below = edges[key] = len(depth)
                    parent.append(state)
                    depth.append(depth[state] + 1)
                    spelt.append(0.0)
                state = below
            spelt[state] = score
            ends.add(state)
        fail, piece, shorter = ([0] * len(depth) for _ in range(3))
        for key, state in sorted(edges.items(), key=lambda edge: depth[edge[1]]):
            char, at = key & (1 << CHAR) - 1, parent[state]
            while at:
                at = fail[at]
                below = edges.get(at << CHAR | char)
                if below is not None:
                    fail[state] = below
                    break
            shorter[state] = piece[fail[state]]
            piece[state] = state if state in ends else shorter[state]
        keys = sorted(edges)
        self.keys = np.array([*keys, np.iinfo(np.int64).max], np.int64)
        self.to = np.array([*map(edges.__getitem__, keys), 0], np.int32)
        self.fail, self.piece, self.shorter = (np.array(x, np.int32) for x in (fail, piece, shorter))
        self.length, self.score = np.array(depth, np.int64), np.array(spelt)

    def follow(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states after one more character each."""
        found, states, rest = np.zeros(len(states), np.int32), states.astype(np.int64), np.arange(len(states))
        while len(rest):
            key = states[rest] << CHAR | chars[rest]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            found[rest[hit]] = self.to[at[hit]]
            rest = rest[~hit]
            rest = rest[states[rest] > 0]
            states[rest] = self.fail[states[rest]]
        return found


class Trie:
    """Forward scores per node: the best log-probability of the path and its number of tokens.

    Arrays by node also have the key of (parent, character) and the state of the automaton.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.best, self.count = np.zeros(1), np.zeros(1, np.int64)
        self.key, self.state = np.full(1, np.iinfo(np.int64).max), np.zeros(1, np.int32)

    def tokens(self, word: str) -> int:
        return int(self.counts([word])[0])

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of the best segmentations; of equally good ones the one with fewer tokens.

        A very long pre-token shares too little with others to be worth a node per character: its scores
        are worked out in the same way, but only those that a piece can still reach are kept.
        """
        found = np.empty(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for k in np.flatnonzero(lengths > LONG).tolist():
            found[k] = self.tokens_of_long(words[k])
        order = np.array(sorted(np.flatnonzero(lengths <= LONG).tolist(), key=words.__getitem__), np.int64)
        sizes = np.cumsum(lengths[order])
        at = 0
        while at < len(order):
            before = sizes[at - 1] if at else 0
            end = int(np.searchsorted(sizes, before + NODES, "right"))
            end = max(at + 1, min(end, at + 20 * NODES // (self.vocabulary.longest + 1)))
            if len(self.best) > NODES:
                self.clear()
            block = order[at:end]
            found[block] = self.insert([words[k] for k in block.tolist()], lengths[block])
            at = end
        return found

    def insert(self, words: list[str], lengths: np.ndarray) -> np.ndarray:
        """Token counts of sorted words, which get the nodes that they lack, level by level."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        starts, size = np.cumsum(lengths) - lengths, len(self.best)
        by_key = np.argsort(self.key, kind="stable")
        known = self.key[by_key]
        self.resize(size + len(chars))
        width = self.vocabulary.longest + 1  # the levels that a piece can reach back to, and this one
        path = np.zeros((width, len(words)), np.int32)
        node, alive = np.zeros(len(words), np.int64), np.arange(len(words))
        for end in range(1, int(lengths.max()) + 1):
            alive = alive[lengths[alive] >= end]
            key = node[alive] << CHAR | chars[starts[alive] + end - 1]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            keys = key[first]
            at = np.searchsorted(known, keys)
            below, new = by_key[at], np.flatnonzero(known[at] != keys)
            if len(new):
                below[new] = nodes = np.arange(size, size + len(new))
                size += len(new)
                self.extend(nodes, keys[new], end, path, alive[first][new])
            node[alive] = path[end % width, alive] = below[np.cumsum(first) - 1]
        self.resize(size)
        return self.count[node]

    def resize(self, size: int) -> None:
        self.best, self.count, self.key, self.state = (
            np.concatenate([x[:size], np.empty(max(size - len(x), 0), x.dtype)])
            for x in (self.best, self.count, self.key, self.state))

    def extend(self, nodes: np.ndarray, keys: np.ndarray, end: int, path: np.ndarray, words: np.ndarray) -> None:
        """Score new nodes at depth ``end``; column ``words`` of ``path`` has the last nodes above each."""
        automaton, best, count = self.vocabulary.automaton, self.best, self.count
        parents, chars = keys >> CHAR, keys & (1 << CHAR) - 1
        n_bytes = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)
        score, n = best[parents] + n_bytes * self.vocabulary.unknown, count[parents] + n_bytes
        state = self.state[nodes] = automaton.follow(self.state[parents], chars)
        piece = automaton.piece[state]
        rest = np.flatnonzero(piece)
        while len(rest):
            at = piece[rest]
            above = path[(end - automaton.length[at]) % len(path), words[rest]]
            other, tokens = best[above] + automaton.score[at], count[above] + 1
            better = (other > score[rest]) | (other == score[rest]) & (tokens < n[rest])
            score[rest[better]], n[rest[better]] = other[better], tokens[better]
            piece[rest] = automaton.shorter[at]
            rest = rest[piece[rest] > 0]
        best[nodes], count[nodes], self.key[nodes] = score, n, keys

    def tokens_of_long(self, word: str) -> int:
        reach = self.vocabulary.longest
        best, count = [0.0] * (reach + 1), [0] * (reach + 1)
        for end in range(1, len(word) + 1):
            place = end % (reach + 1)
            best[place], count[place] = self.step(
                word, end, lambda start: (best[start % (reach + 1)], count[start % (reach + 1)]))
        return count[len(word) % (reach + 1)]

    def step(self, word: str, end: int, at) -> tuple[float, int]:
        """Best score and its tokens for ``word[:end]``, from those of shorter beginnings ``at(start)``."""
        scores = self.vocabulary.scores
        n_bytes = len(word[end - 1].encode("utf-8", "replace"))
        before, tokens = at(end - 1)
        score, n = before + n_bytes * self.vocabulary.unknown, tokens + n_bytes
        for start in range(max(0, end - self.vocabulary.longest), end):
            piece = scores.get(word[start:end])
            if piece is not None:
                before, tokens = at(start)
                if before + piece > score or before + piece == score and tokens + 1 < n:
                    score, n = before + piece, tokens + 1
        return score, n


def token_counts(documents: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """Key, n_pretokens, n_distinct and n_tokens of every row of ``documents(key, text)``.

    Null and empty texts have none; repeated rows have equal counts; other columns are not read. Texts
    and words of any length are counted whole: a word of more than LONG code points takes no nodes.
    """
    vocabulary.automaton  # built once here and sent along
    sent = shared(documents.sparkSession, vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(sent())
        for batch, texts in pieces(batches):
            ids, offsets, words = index_words(texts)
            tokens = trie.counts([MARK + w.decode(errors="replace") for w in words])
            n_tokens = sum_by_text(tokens[ids], offsets) if words else np.zeros(len(texts), np.int64)
            distinct = [len(np.unique(ids[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch(
                [batch.column(key), pa.array(np.diff(offsets), pa.int64()), pa.array(distinct, pa.int64()),
                 pa.array(n_tokens, pa.int64())], names=[key, "n_pretokens", "n_distinct", "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(
        counted, f"`{key}` {kind}, n_pretokens bigint, n_distinct bigint, n_tokens bigint")
