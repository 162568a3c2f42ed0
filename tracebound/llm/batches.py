"""Rows of a document table as pieces of bounded size, and words as small integers."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

#: Bytes of text that one piece holds, unless a single row is larger.
PIECE_BYTES = 8 << 20


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Arrow batches cut into slices of about ``limit`` bytes of text; null is empty."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(text).fill_null(""))
        sizes = np.cumsum(lengths.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            part = batch.slice(at, end - at)
            yield part, part.column(text).fill_null("").cast(pa.binary()).to_pylist()
            at = end


def give_back() -> None:
    """Hand memory that is free in this process back to the system, as far as its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
         ) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, after which the worker keeps no free memory.

    Workers outlive their tasks and stages, and Arrow's pool and the C library would hold the most
    that any task took, beside the executor's heap.
    """
    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return worked


class Index(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def index_words(texts: list[bytes], split: Callable[[bytes], list[bytes]] = bytes.split
                ) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(word numbers of all texts, offsets of the texts, distinct words by number).

    ``bytes.split`` cuts at exactly the six ASCII blanks 0x20 and 0x09-0x0D.
    """
    index = Index()
    number = index.__getitem__
    parts = [np.empty(0, np.int32)]
    for text in texts:
        words = split(text)
        parts.append(np.fromiter(map(number, words), np.int32, len(words)))
    offsets = np.cumsum([len(p) for p in parts])
    return np.concatenate(parts), offsets, list(index)


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = values.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, n: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of every run of ``n`` values; its length is ``len(hashes) - n + 1``."""
    count = max(len(hashes) - n + 1, 0)
    total = np.zeros(count, np.uint64)
    for j in range(n if count else 0):
        total = total * np.uint64(factor) + hashes[j:j + count]
    return mixed(total)


def starts_inside(offsets: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of the first ``count`` positions begin a run of ``n`` inside one text."""
    inside = np.ones(count, bool)
    for back in range(1, n):
        ends = offsets[1:] - back
        ends = ends[(ends >= 0) & (ends < count)]
        inside[ends] = False
    return inside


def sum_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per word) per text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie inside one of the half-open spans."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def shared(spark, value) -> Callable[[], object]:
    """Broadcast any object; tasks call the result to get it.

    The object travels as bytes pickled by value, so executors need not have its class.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    loaded: list = []

    def get():
        if not loaded:
            loaded.append(pickle.loads(sent.value))
        return loaded[0]

    return get


def _store(spark, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark, path: str) -> bool:
    target, store = _store(spark, path)
    return store.exists(target)


def removed_folder(spark, path: str) -> None:
    """Delete a folder of the shared store that this library has written and read to the end."""
    target, store = _store(spark, path)
    store.delete(target, True)
