"""Log-probabilities of texts under a log-bilinear model (operator 11).

Counts of all training tokens come first, over all documents. The ``WORDS`` most frequent tokens are
classes of their own; every other word belongs to a class by its last letters, and within that class
has its share of the counts. The neural part predicts the class of a token from the classes of the
two before it: a linear map of their vectors meets the vector of the class. It is trained with
noise-contrastive estimation in numpy, once over every training document: each task starts from the
same weights, and the weights of all tasks are averaged by tokens, after a first slice of the
documents and after the rest. Scoring normalises: a product of all contexts of a batch with all
classes gives the sum that a probability is divided by.

Counts of the most frequent words, bounded by ``FREQUENT``, are broadcast; occurrences of all others
are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import pieces, shared, sum_by_text
from tracebound.plans.lineage import cut

#: Tokens with a class of their own, classes by last letters, and how many letters those are.
WORDS, ENDINGS, LETTERS = 1024, 256, 3
#: Words whose counts are broadcast, at most (16 bytes each).
FREQUENT = 1 << 18
DIMENSIONS, NOISE, BATCH, RATE = 16, 64, 2048, 0.1
#: The part of the training documents, in hundredths, after which the tasks' weights meet first.
FIRST_SLICE = 10
#: Tokens and contexts that are scored together.
TOKENS, CONTEXTS = 1 << 22, 256
END_KEY = xxhash.xxh3_64_intdigest(b" ")  # no word is a blank
SEED = 3


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word numbers, offsets of texts, distinct words), lower-cased; split at the six ASCII blanks."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    offsets = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False), dtype=np.int64))
    coded = parts.flatten().dictionary_encode()
    numbers, words = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    if b"" in words:  # before and after blanks at the ends of a text
        empty = words.index(b"")
        kept = numbers != empty
        offsets = np.append(0, np.cumsum(kept))[offsets]
        numbers = numbers[kept]
        numbers = numbers - (numbers > empty)
        del words[empty]
    return numbers, offsets, words


class Endings(dict):
    """Classes of last letters, worked out once each."""

    def __missing__(self, letters: bytes) -> int:
        found = self[letters] = xxhash.xxh3_64_intdigest(letters) % ENDINGS
        return found


def keys_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys and ending classes of words."""
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
    known = Endings()
    return keys, np.fromiter((known[w[-LETTERS:]] for w in words), np.int32, len(words))


def end_key() -> int:
    return int(np.uint64(END_KEY).astype(np.int64))


@dataclass
class Lexicon:
    """What all tasks know of the words: sorted keys with counts and classes, and totals per ending."""

    keys: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    class_counts: np.ndarray
    ending_logs: np.ndarray
    end_class: int

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys; -1 where a key is not among the frequent ones."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def classes_of(self, keys: np.ndarray, endings: np.ndarray) -> np.ndarray:
        at = self.look_up(keys)
        own = self.classes[at] if len(self.classes) else at
        return np.where((at >= 0) & (own >= 0), own, WORDS + endings)


@dataclass
class Weights:
    """Vectors of classes as context and as target, one map per position, and a bias per class."""

    context: np.ndarray
    target: np.ndarray
    maps: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, class_counts: np.ndarray, seed: int = SEED) -> Weights:
        n, rng = len(class_counts), np.random.default_rng(seed)
        share = np.log((class_counts + 1) / (class_counts + 1).sum()).astype(np.float32)
        return cls(rng.normal(0, 0.3, (n + 1, DIMENSIONS)).astype(np.float32),
                   rng.normal(0, 0.1, (n, DIMENSIONS)).astype(np.float32),
                   np.stack([np.eye(DIMENSIONS, dtype=np.float32) * s for s in (1.0, 0.5)]), share)

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.context[one] @ self.maps[0] + self.context[two] @ self.maps[1]

    def rows(self) -> np.ndarray:
        """All weights as one matrix with DIMENSIONS columns."""
        bias = np.pad(self.bias, (0, -len(self.bias) % DIMENSIONS)).reshape(-1, DIMENSIONS)
        return np.concatenate([self.context, self.target, self.maps.reshape(-1, DIMENSIONS), bias])

    @classmethod
    def of_rows(cls, rows: np.ndarray, n: int) -> Weights:
        context, target, maps, bias = np.split(rows.astype(np.float32), np.cumsum([n + 1, n, 2 * DIMENSIONS]))
        return cls(context, target, maps.reshape(2, DIMENSIONS, DIMENSIONS), bias.reshape(-1)[:n])


def token_classes(numbers: np.ndarray, offsets: np.ndarray, of_word: np.ndarray, end: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, an end after every text, and where texts start (one more at the end)."""
    n = len(offsets) - 1
    starts = offsets + np.arange(n + 1)
    classes = np.full(int(starts[-1]), end, np.int32)
    inside = np.ones(len(classes), bool)
    inside[starts[1:] - 1] = False
    classes[inside] = of_word[numbers]
    return classes, starts


def contexts_of(classes: np.ndarray, starts: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The class before and the one before that; ``begin`` stands before a text."""
    one, two = np.full(len(classes), begin, np.int32), np.full(len(classes), begin, np.int32)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[starts[:-1]] = begin
    two[starts[:-1]] = begin
    second = starts[:-1] + 1
    two[second[second < starts[1:]]] = begin
    return one, two


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits are sorted by counting
    sorted_rows = rows[order]
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    return sorted_rows[first], np.add.reduceat(values[order], first, axis=0)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive estimation with Adagrad; a batch shares its noise."""

    def __init__(self, weights: Weights, class_counts: np.ndarray, seed: int):
        self.w = Weights(*(x.copy() for x in (weights.context, weights.target, weights.maps, weights.bias)))
        self.rng, self.tokens = np.random.default_rng(seed), 0
        share = (class_counts + 1) / (class_counts + 1).sum()
        self.upto = np.cumsum(share)
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.seen = [np.full_like(x, 1e-6) for x in (self.w.context, self.w.target, self.w.maps, self.w.bias)]

    def step(self, value: np.ndarray, seen: np.ndarray, at, gradient: np.ndarray):
        seen[at] += gradient * gradient
        value[at] -= RATE * gradient / np.sqrt(seen[at])

    def learn(self, classes: np.ndarray, one: np.ndarray, two: np.ndarray):
        order = self.rng.permutation(len(classes))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            self.batch(classes[rows], one[rows], two[rows])
        self.tokens += len(classes)

    def batch(self, right: np.ndarray, one: np.ndarray, two: np.ndarray):
        w = self.w
        noise = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.upto) - 1)
        first, second = w.context[one], w.context[two]
        guess = first @ w.maps[0] + second @ w.maps[1]
        target, wrong = w.target[right], w.target[noise]
        lift = logistic((guess * target).sum(axis=1) + w.bias[right] - self.log_noise[right]) - 1
        push = logistic(guess @ wrong.T + w.bias[noise] - self.log_noise[noise])
        scale = np.float32(1 / len(right))
        lift, push = lift * scale, push * scale
        back = lift[:, None] * target + push @ wrong
        at, change = row_sums(np.concatenate([right, noise]), np.concatenate([
            np.column_stack([lift[:, None] * guess, lift]),
            np.column_stack([push.T @ guess, push.sum(axis=0)])]))
        maps = np.stack([first.T @ back, second.T @ back])
        seen_at, seen_change = row_sums(
            np.concatenate([one, two]), np.concatenate([back @ w.maps[0].T, back @ w.maps[1].T]))
        self.step(w.target, self.seen[1], at, change[:, :-1])
        self.step(w.bias, self.seen[3], at, change[:, -1])
        self.step(w.maps, self.seen[2], slice(None), maps)
        self.step(w.context, self.seen[0], seen_at, seen_change)


def log_probabilities(w: Weights, classes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Natural log of the normalised probability of every class after its two classes."""
    out = np.empty(len(classes))
    begin, share = len(w.context), np.exp(w.bias)
    for at in range(0, len(classes), TOKENS):
        right = classes[at:at + TOKENS]
        code = one[at:at + TOKENS].astype(np.int64) * begin + two[at:at + TOKENS]
        distinct, which = np.unique(code, return_inverse=True)
        guess = w.predicted(distinct // begin, distinct % begin)
        total = np.empty(len(distinct), np.float32)
        for k in range(0, len(distinct), CONTEXTS):
            scores = guess[k:k + CONTEXTS] @ w.target.T
            most = np.float32(0)
            if max(scores.max(), -scores.min()) > 50:  # beyond what exp can take as it is
                most = scores.max(axis=1)
                scores -= most[:, None]
            np.exp(scores, out=scores)
            total[k:k + CONTEXTS] = np.log(scores @ share) + most
        own = np.einsum("nd,nd->n", guess[which], w.target[right])
        out[at:at + TOKENS] = own + w.bias[right] - total[which]
    return out


def is_held_out(key: str):
    """Rows that are never learnt from: crc32 of the key as text, modulo 7, is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, c) of all tokens of ``texts(text)``."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            numbers, _, words = numbered(batch.column("text"))
            keys, endings = keys_of(words)
            yield pa.record_batch([
                pa.array(np.append(keys, end_key())), pa.array(np.append(endings, 0), pa.int32()),
                pa.array(np.append(np.bincount(numbers, minlength=len(words)), len(found)), pa.int64()),
            ], names=["word", "ending", "c"])

    rows = texts.select("text").mapInArrow(counted, "word bigint, ending int, c bigint")
    return rows.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("c").alias("c"))


def lexicon(counts: DataFrame) -> Lexicon:
    """The frequent words of ``counts``; at most FREQUENT + WORDS rows come to the driver."""
    end = end_key()
    top = counts.filter(F.col("word") != end).orderBy(F.desc("c"), "word").limit(WORDS - 1).collect()
    size = F.floor(8 * F.log2("c"))
    least, seen = 0, 0
    for bin_, n in counts.groupBy(size.alias("bin")).count().orderBy(F.desc("bin")).collect():
        seen += n
        if seen > FREQUENT:
            least = bin_ + 1
            break
    often = counts.filter((size >= least) | F.col("word").isin([r.word for r in top] + [end])).toArrow()
    keys, found = (often.column(c).to_numpy() for c in ("word", "c"))
    order = np.argsort(keys)
    keys, found = keys[order], found[order]
    own = {end: 0, **{r.word: k + 1 for k, r in enumerate(top)}}
    classes = np.array([own.get(k, -1) for k in keys.tolist()], np.int32)
    class_counts, sizes = np.zeros(WORDS + ENDINGS), np.zeros(ENDINGS)
    class_counts[classes[classes >= 0]] = found[classes >= 0]
    rest = counts.filter(~F.col("word").isin(list(own))).groupBy("ending").agg(F.sum("c"), F.count("c"))
    for ending, total, n in rest.collect():
        class_counts[WORDS + ending], sizes[ending] = total, n
    return Lexicon(keys, found, classes, class_counts, np.log10(class_counts[WORDS:] + sizes + 1), 0)


def averaged(texts: DataFrame, words: Lexicon, weights: Weights) -> Weights:
    """Weights after every task has learnt its texts from ``weights``, averaged by tokens."""
    sent = shared(texts.sparkSession, (words, weights))
    names = [f"v{k}" for k in range(DIMENSIONS)]

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = sent()
        trainer = Trainer(weights, words.class_counts, SEED + TaskContext.get().partitionId())
        for batch, _ in pieces(batches):
            numbers, offsets, distinct = numbered(batch.column("text"))
            classes, starts = token_classes(numbers, offsets, words.classes_of(*keys_of(distinct)), words.end_class)
            trainer.learn(classes, *contexts_of(classes, starts, len(words.class_counts)))
        if trainer.tokens:
            rows = trainer.w.rows()
            yield pa.record_batch(
                [pa.array(range(len(rows)), pa.int32()), pa.array([trainer.tokens] * len(rows), pa.int64()),
                 *(pa.array(c, pa.float32()) for c in rows.T)], names=["at", "n", *names])

    total = (
        texts.select("text").mapInArrow(learnt, "at int, n bigint, " + ", ".join(f"{v} float" for v in names))
        .groupBy("at").agg(F.sum("n"), *(F.sum(F.col(v) * F.col("n")) for v in names))
        .orderBy("at").collect()
    )
    if not total:
        return weights
    table = np.array([r[1:] for r in total], float)
    return Weights.of_rows(table[:, 1:] / table[:, :1], len(words.class_counts))


def train(learnt: DataFrame, words: Lexicon, key: str) -> Weights:
    """One pass over all training texts, the weights meeting twice."""
    slice_of = F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(100))
    weights = averaged(learnt.filter(slice_of < FIRST_SLICE), words, Weights.fresh(words.class_counts))
    return averaged(learnt.filter(slice_of >= FIRST_SLICE), words, weights)


def scored(documents: DataFrame, words: Lexicon, weights: Weights, key: str) -> DataFrame:
    """What the broadcast counts and the weights say of every row, and its words beyond them."""
    sent = shared(documents.sparkSession, (words, weights))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = sent()
        for batch, _ in pieces(batches):
            numbers, offsets, distinct = numbered(batch.column("text"))
            keys, endings = keys_of(distinct)
            at = words.look_up(keys)
            counts = np.where(at >= 0, words.counts[at] if len(words.counts) else 0, 0)
            of_word = words.classes_of(keys, endings)
            classes, starts = token_classes(numbers, offsets, of_word, words.end_class)
            logs = log_probabilities(
                weights, classes, *contexts_of(classes, starts, len(words.class_counts))) / np.log(10)
            end = words.look_up(np.array([end_key()]))[0]
            ends = int(words.counts[end]) if end >= 0 else 0
            word_logs = np.log10(counts + 1.0)
            inner = np.where(of_word >= WORDS, word_logs - words.ending_logs[endings], 0)
            rare_list, rare_counts = [], []
            is_rare = at < 0
            for a, b in zip(offsets[:-1], offsets[1:]):
                own, n = np.unique(numbers[a:b][is_rare[numbers[a:b]]], return_counts=True)
                rare_list.append(keys[own])
                rare_counts.append(n)
            bounds = np.cumsum([0, *map(len, rare_list)]).astype(np.int32)
            rare = pa.array(np.concatenate([*rare_list, np.empty(0, np.int64)]), pa.int64())
            times = pa.array(np.concatenate([*rare_counts, np.empty(0, np.int64)]), pa.int32())
            yield pa.record_batch([
                batch.column("key"), batch.column("held_out"), pa.array(np.diff(starts), pa.int64()),
                pa.array(sum_by_text((counts > 0)[numbers], offsets) + (ends > 0), pa.int64()),
                pa.array(sum_by_float(word_logs[numbers], offsets) + np.log10(ends + 1.0)),
                pa.array(sum_by_float(logs, starts) + sum_by_float(inner[numbers], offsets)),
                pa.ListArray.from_arrays(bounds, rare), pa.ListArray.from_arrays(bounds, times),
            ], names=["key", "held_out", "n_tokens", "known", "logs", "score", "rare", "times"])

    rows = documents.select(F.col(key).alias("key"), is_held_out(key).alias("held_out"), "text")
    return rows.mapInArrow(
        judged, f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens bigint, known bigint, "
        "logs double, score double, rare array<bigint>, times array<int>")


def sum_by_float(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums per text, each text added on its own."""
    return np.array([values[a:b].sum() for a, b in zip(offsets[:-1], offsets[1:])], float)


def language_scores(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    The scores are log10 probabilities of the whole text with its end: by add-one counts, and by the
    model. Null and empty texts are an end alone; a null key is never learnt from and not held out;
    repeated rows are learnt as often as they stand there and get rows of their own, with scores equal
    up to the rounding of 32-bit products; a text of any
    length is scored whole, a block of tokens at a time; words are compared by 64-bit hashes, the most frequent ones in a tie by
    the smaller hash; other columns are not read; without training rows all words are unknown and all
    classes alike.
    """
    learnt = documents.select(key, "text").filter(F.col(key).isNotNull() & ~is_held_out(key))
    counts = cut(token_counts(learnt))
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("c")).first()
    words = lexicon(counts)
    weights = train(learnt, words, key)
    rows = cut(scored(documents, words, weights, key)).withColumn("row", F.monotonically_increasing_id())
    # checkpointed rows keep their order, so a repeated task numbers them alike
    rare = rows.filter(F.size("rare") > 0).select(
        "row", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "word")
    found = rare.join(counts, "word").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"), F.sum("times").alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return rows.select("row", "key", "held_out", "n_tokens", "known", "logs", "score").join(found, "row", "left").select(
        F.col("key").alias(key), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * float(np.log10(n + distinct + 1))).alias("base_score"),
        (F.col("score") + more).alias("score"))
