"""Documents as token ids in compressed binary files, and back (operator 4).

Documents are ordered by range partitions. Each worker numbers its distinct words, tokenizes every
distinct word once with the ``tokenizers`` library, and lays out the ids of its documents;
``idcoder`` turns about ``CHUNK`` ids at a time into one chunk. A chunk with the documents that it
holds is one row of a Parquet folder, so Spark's writer commits whole files, a lost executor's
task is simply run again, and any store that Spark can reach will do. Readers decode chunks
independently.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracebound.llm.batches import Index, pieces, tidy
from tracebound.llm.idcoder import decode, encode

END_ID = 2
#: Ids in one chunk, unless a single document has more.
CHUNK = 1_500_000
#: Distinct words whose ids a worker remembers, and their bytes; then it starts anew.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64 << 20
#: Bytes of text that are tokenized together, and of a row group of the written files.
PIECE, ROW_GROUP = 4 << 20, 8 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` (a folder in /tmp only where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = "/tmp/spark-tokens"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Classes of bytes: blanks, letters and digits, punctuation other than apostrophes, all others.
#: The tokenizer cuts between the second and the third, so "word," needs no ids besides "word" and ",".
BLANK, WORD, MARK, OTHER = 0, 2, 4, 1
KINDS = np.full(256, OTHER, np.uint8)
KINDS[list(b" \t\n\v\f\r")] = BLANK
KINDS[[k for k in range(128) if chr(k).isalnum()]] = WORD
KINDS[[k for k in range(33, 127) if not chr(k).isalnum() and chr(k) != "'"]] = MARK


def parts_of(texts: list[bytes], lower: bool) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(numbers of the parts that are tokenized one by one, distinct parts, parts per text).

    Texts are cut at ASCII blanks and where ``KINDS`` says, and lower-cased if ``lower``. Texts with
    ``<|`` are only cut at blanks, since special tokens are matched before anything else.
    """
    joined = b" ".join(texts) + b" "
    raw = np.frombuffer(bytearray(joined.lower() if lower else joined), np.uint8)
    kinds = KINDS[raw]
    ends = np.cumsum([len(t) + 1 for t in texts])
    before = np.append(np.uint8(BLANK), kinds[:-1])
    cuts = (kinds ^ before) == WORD ^ MARK
    if b"<|" in joined:
        for end, text in zip(ends.tolist(), texts):
            if b"<|" in text:
                raw[end - 1 - len(text):end - 1] = np.frombuffer(text, np.uint8)
                cuts[end - 1 - len(text):end - 1] = False
    own = kinds != BLANK
    first = own & (cuts | (before == BLANK))
    body = raw[own]
    begins = np.append(np.flatnonzero(first[own]), len(body))
    parts = pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(body)])
    counts = np.diff(np.searchsorted(np.flatnonzero(first), ends), prepend=0)
    found = parts.dictionary_encode()
    _, at, data = found.dictionary.buffers()
    data, at = (data.to_pybytes() if data else b""), np.frombuffer(at, np.int64, len(found.dictionary) + 1).tolist()
    return found.indices.to_numpy(), [data[a:b] for a, b in pairwise(at)], counts


class WordTokens:
    """Ids of texts whose tokens never cross ASCII blanks, through one lookup per distinct part.

    Parts are compared after ASCII lower-casing, which a lower-casing tokenizer does itself. Parts
    of Latin letters alone go straight to the tokenizer's model, each letter in the form that the
    steps before the model give it. A letter for which that is not the same stays out.
    """

    def __init__(self, definition: str, lower: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.lower = Tokenizer.from_str(definition), lower
        self.forms = {}
        for letter in filter(str.isalpha, map(chr, range(0x250))):
            form = self.form_of(letter)
            if form and self.form_of(f"{letter}a{letter}{letter}b") == f"{form}a{form}{form}b":
                self.forms[ord(letter)] = form
        letters = [chr(k) for k in self.forms]
        probes = [*letters, *("n" + a for a in letters), *(a + "e" for a in letters), "".join(letters)]
        if self.by_model(probes) != self.by_all_steps(probes):
            self.forms = {}
        self.letters = re.compile(f"[{''.join(map(chr, self.forms))}]+" if self.forms else r"(?!)").fullmatch
        self.forget()

    def form_of(self, word: str) -> str | None:
        """What the model gets for ``word``, if that is one string."""
        steps = self.tokenizer
        if steps.normalizer:
            word = steps.normalizer.normalize_str(word)
        found = steps.pre_tokenizer.pre_tokenize_str(word) if steps.pre_tokenizer else [(word, None)]
        return found[0][0] if len(found) == 1 else None

    def forget(self):
        # number 0 is the end of a text
        self.index, self.known, self.bytes = Index({None: 0}), 1, 0
        self.starts, self.flat = np.array([0, 1]), np.array([END_ID], np.int32)

    def by_model(self, words: list[str]) -> list[list[int]]:
        tokenize, forms = self.tokenizer.model.tokenize, self.forms
        return [[x.id for x in tokenize(w.translate(forms))] for w in words]

    def by_all_steps(self, words: list[str]) -> list[list[int]]:
        return [x.ids for at in range(0, len(words), 4096)
                for x in self.tokenizer.encode_batch_fast(words[at:at + 4096], add_special_tokens=False)]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with its end, number of ids per text)"""
        if len(self.index) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        numbers, distinct, counts = parts_of(texts, self.lower)
        own = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))
        self.learn()
        ends = np.cumsum(counts)
        lists = pa.LargeListArray.from_arrays(self.starts, self.flat)
        found = lists.take(pa.array(np.insert(own[numbers], ends, 0)))
        after = found.offsets.to_numpy()
        return found.flatten().to_numpy(), np.diff(after[ends + np.arange(1, len(ends) + 1)], prepend=0)

    def learn(self):
        words = [w.decode() for w in islice(self.index, self.known, None)]
        whole = [self.letters(w) is not None for w in words]
        plain = iter(self.by_model([w for w, p in zip(words, whole) if p]))
        others = iter(self.by_all_steps([w for w, p in zip(words, whole) if not p]))
        found = [next(plain if p else others) for p in whole]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.flat = np.append(self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())))
        self.starts = np.append(self.starts, self.starts[-1] + np.cumsum(lengths))
        self.known, self.bytes = len(self.index), self.bytes + sum(map(len, words))

    @classmethod
    def of_worker(cls, definition: str, lower: bool) -> WordTokens:
        """The one of this Python worker: what a tokenizer takes of memory is never given back.

        Kept at the module of the library, which outlives the task.
        """
        import tokenizers

        name, held = (hash(definition), lower), vars(tokenizers).setdefault("_of_worker", {})
        if name not in held:
            held.clear()
            held[name] = cls(definition, lower)
        return held[name]


def write_tokens(documents: DataFrame, path: str, tokenizer_file: str, key: str = "doc_id",
                 lower: bool = True, chunk: int = CHUNK) -> None:
    """Write the ids of ``documents(key, text)`` in ascending key order to the folder ``path``.

    ``tokenizer_file`` is read once on the driver. Every document ends with ``END_ID``; null
    and empty texts hold only that. Null keys come first; rows with equal keys are ordered by
    text. Other columns are not read. ``lower`` says that the tokenizer lower-cases by itself.
    """
    spark = documents.sparkSession
    with open(tokenizer_file, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())  # one vocabulary: a few MB

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.of_worker(definition.value, lower)
        part, before = TaskContext.get().partitionId(), 0
        keys, held, sizes, n = [], [], [], 0

        def hold(batch: pa.RecordBatch, ids: np.ndarray, lengths: np.ndarray) -> None:
            nonlocal n
            keys.append(batch.column(key))
            held.append(ids)
            sizes.append(lengths)
            n += len(ids)

        def flush() -> pa.RecordBatch:
            row = pa.record_batch([
                pa.array([part], pa.int64()), pa.array([before], pa.int64()),
                pa.array([n], pa.int64()),
                pa.array([pa.concat_arrays(keys).to_pylist()], pa.list_(keys[0].type)),
                pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                pa.array([encode(np.concatenate(held))], pa.binary()),
            ], names=["part", "before", "n", "keys", "lengths", "ids"])
            return row

        for batch, texts in pieces(batches, limit=PIECE):
            ids, lengths = words(texts)
            ends = np.cumsum(lengths)
            at = done = 0
            while ends[-1] - done + n >= chunk:
                k = int(np.searchsorted(ends, done + chunk - n)) + 1
                hold(batch.slice(at, k - at), ids[done:ends[k - 1]], lengths[at:k])
                yield flush()
                before, keys, held, sizes, n, at, done = before + n, [], [], [], 0, k, int(ends[k - 1])
                if k == len(ends):
                    break
            if at < len(ends):
                hold(batch.slice(at), ids[done:], lengths[at:])
        if held:
            yield flush()

    kind = documents.schema[key].dataType.simpleString()
    (
        documents.select(F.col(key).alias("key"), "text").withColumnRenamed("key", key)
        .repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col(key).asc_nulls_first(), "text")
        .mapInArrow(tidy(encoded), "part bigint, before bigint, n bigint, "
                             f"keys array<{kind}>, lengths array<bigint>, ids binary")
        # chunks are large cells: small row groups keep few of them in memory
        .write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id", ids: bool = False) -> DataFrame:
    """One row per document in the folder: key, start, n_tokens, ids_crc32 and, if asked, the ids.

    ``start`` counts the ids of all documents before it. It needs one number per written file,
    which is small enough for one window.
    """
    chunks = spark.read.parquet(path)
    kind = chunks.schema["keys"].dataType.elementType
    offsets = (
        chunks.groupBy("part").agg(F.sum("n").alias("n"))
        .select("part", F.coalesce(F.sum("n").over(
            Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            .alias("offset"))
    )

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                values = decode(batch.column("ids")[k].as_py()).astype("<u4")
                lengths = batch.column("lengths")[k].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                view = memoryview(values).cast("B")
                columns = [
                    batch.column("keys")[k].values,
                    pa.array(starts + batch.column("base")[k].as_py(), pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([zlib.crc32(view[4 * a:4 * b]) for a, b in zip(starts, ends)], pa.int64()),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(
                        np.append(0, ends).astype(np.int32), values.astype(np.int32)))
                yield pa.record_batch(columns, names=[key, "start", "n_tokens", "ids_crc32", "ids"][:len(columns)])

    schema = f"`{key}` {kind.simpleString()}, start bigint, n_tokens bigint, ids_crc32 bigint"
    return (
        chunks.join(offsets, "part")
        .select(F.expr("before + offset").alias("base"), "keys", "lengths", "ids")
        .mapInArrow(tidy(decoded), schema + (", ids array<int>" if ids else ""))
    )


def round_trip(documents: DataFrame, tokenizer_file: str, key: str = "doc_id") -> DataFrame:
    """Write ``documents`` below the shared folder and describe what the files hold."""
    spark = documents.sparkSession
    path = shared_folder(spark, "tokens")
    write_tokens(documents, path, tokenizer_file, key)
    return read_tokens(spark, path, key)
