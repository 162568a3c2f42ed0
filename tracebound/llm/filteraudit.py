"""How filters interact: a stream that takes back what a smaller id proves wrong (operator 12).

All files of a table are read as a few available-now micro-batches. Four filters judge a text alone
(too short, too repetitive, too many capitals, special characters); the fifth rejects a text that
also stands under a smaller id anywhere in the table, which a batch cannot know. Keyed state holds,
for every distinct text, the smallest id so far and the rows that have it; the texts of a bucket of
digests share a row of state, since a call of Python per text would cost more than all else. A row with a larger id
counts as a copy at once; a smaller id takes over, and the rows that it displaces are retracted from
the counter of their mask and counted again as copies.

A counter belongs to a part, the mask of filters that a row fails, and two label bits. Rows of equal
text are combined before every shuffle, so a text that fills a third of the table reaches its state
as a few rows per task. The orders of the filters are applied to the counters alone.

State lives in the provider that the session names; ``session.cluster_settings`` names RocksDB, which
keeps it on disk. Counters of a batch are a folder under its number, so a repeated batch replaces its own.
"""

from __future__ import annotations

import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracebound.llm.batches import folder_exists, pieces, removed_folder
from tracebound.llm.tokens import shared_folder
from tracebound.plans.lineage import cut

FILTERS = "ABCDE"
#: Micro-batches over the files of a table.
BATCHES = 4
#: Texts that share a row of state, about: their number of buckets follows the rows of the table.
BUCKET_TEXTS = 128
#: Stands for a null id: no id is larger.
NO_ID = 2 ** 63 - 1
CAPITALS = bytes(range(65, 91))
SPECIAL = re.compile(rb"[#$%&*|]")
COPY = 16


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    words = text.split()
    n, points = len(words), len(text.decode(errors="replace"))
    return ((n < 100) | (100 * len(set(words)) < 80 * n) << 1
            | (100 * (len(text) - len(text.translate(None, CAPITALS))) > 10 * points) << 2
            | (SPECIAL.search(text) is not None) << 3)


def judged(documents: DataFrame, key: str, part: str) -> DataFrame:
    """(id, h1, h2, mask, part, n): equal rows of a piece are one row; h1 and h2 are a digest of the text."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            rows: Counter = Counter()
            masks: dict[int, int] = {}
            for i, p, text in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist(), found):
                h = xxhash.xxh3_128_intdigest(text)
                if h not in masks:
                    masks[h] = own_mask(text)
                rows[i, h, p] += 1
            columns = list(zip(*((i, (h >> 64) - 2 ** 63, (h & 2 ** 64 - 1) - 2 ** 63, masks[h], p, n)
                                 for (i, h, p), n in rows.items()))) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)],
                                  names=["id", "h1", "h2", "mask", "part", "n"])

    return documents.select(
        F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), "text",
    ).mapInArrow(texts, "id bigint, h1 bigint, h2 bigint, mask int, part string, n bigint")


ROWS = "h1 bigint, h2 bigint, mask int, id bigint, later boolean, part string, flags int, n bigint"


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every text the rows with the smallest id, and counts of the ``later`` ones."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("h1", "h2", "mask", "id", "part", "flags", "n")]
        least: dict[tuple, int] = {}
        for h1, h2, mask, i, *_ in zip(*columns):
            text = (h1, h2, mask)
            if i < least.get(text, NO_ID + 1):
                least[text] = i
        rows: Counter = Counter()
        for h1, h2, mask, i, p, flags, n in zip(*columns):
            first = least[h1, h2, mask]
            rows[h1, h2, mask, first, i != first, p, flags] += n
        out = list(zip(*((*k, n) for k, n in rows.items()))) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.int32(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)],
                              names=["h1", "h2", "mask", "id", "later", "part", "flags", "n"])


COUNTS = "part string, mask int, flags int, n bigint"
STATE = ("h1 array<bigint>, h2 array<bigint>, masks array<int>, least array<bigint>, "
         "owner array<int>, parts array<string>, flags array<int>, counts array<bigint>")


def least_ids(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Counter changes of the texts of one bucket: copies, owners of the smallest ids, and retractions.

    State has a text's digest, mask, smallest id and the rows with it, by part and flags.
    """
    texts: dict[tuple, list] = {}
    if state.exists:
        h1, h2, masks, least, *owned = state.get
        ordered = [(mask, i, Counter()) for mask, i in zip(masks, least)]
        for k, p, f, n in zip(*owned):
            ordered[k][2][p, f] = n
        texts = {text: list(row) for text, row in zip(zip(h1, h2), ordered)}
    changes: Counter = Counter()
    for frame in frames:
        columns = ("h1", "h2", "mask", "id", "later", "part", "flags", "n")
        for h1, h2, mask, i, later, p, f, n in zip(*(frame[c].tolist() for c in columns)):
            held = texts.setdefault((h1, h2), [mask, NO_ID + 1, Counter()])
            if later or i > held[1]:
                changes[p, mask | COPY, f] += n
                continue
            if i < held[1]:
                for (old_part, old_flags), m in held[2].items():
                    changes[old_part, mask, old_flags] -= m
                    changes[old_part, mask | COPY, old_flags] += m
                held[1:] = [i, Counter()]
            held[2][p, f] += n
            changes[p, mask, f] += n
    names = list(texts)
    owned = [(k, p, f, n) for k, name in enumerate(names) for (p, f), n in sorted(texts[name][2].items())]
    state.update((
        [h1 for h1, _ in names], [h2 for _, h2 in names], [texts[x][0] for x in names], [texts[x][1] for x in names],
        *([row[c] for row in owned] for c in range(4))))
    out = [(p, mask, f, n) for (p, mask, f), n in changes.items() if n]
    yield pd.DataFrame(out, columns=["part", "mask", "flags", "n"])


def counted(stream: DataFrame, labels: DataFrame, key: str, part: str, buckets: int) -> DataFrame:
    """Changes of the counters (part, mask, flags), flags 1: quality, 2: toxic."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = cut(
        labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias("label_id"))
        .agg((one("quality") + 2 * one("toxic")).alias("flags")).withColumn("known", F.lit(True))
    )
    rows = judged(stream, key, part).select(
        "*", (F.col("id") != NO_ID).alias("has_id"),
        # rows without an id match nothing; their digests spread them over the tasks
        F.when(F.col("id") == NO_ID, F.col("h1")).otherwise(F.col("id")).alias("look"))
    met = rows.join(known, (rows.look == known.label_id) & (rows.has_id == known.known), "left").select(
        "h1", "h2", "mask", "id", "part", F.coalesce("flags", F.lit(0)).alias("flags"), "n")
    return met.mapInArrow(combined, ROWS).withColumn("bucket", F.pmod("h1", F.lit(buckets))).groupBy(
        "bucket").applyInPandasWithState(least_ids, COUNTS, STATE, "append", "NoTimeout")


def buckets_of(spark: SparkSession, folder: str, rows: int) -> int:
    """Buckets of the state: set by the rows at the first start, then by what the folder says."""
    path = f"{folder}/buckets"
    if not folder_exists(spark, path):
        spark.range(max(1, rows // BUCKET_TEXTS), max(1, rows // BUCKET_TEXTS) + 1).write.parquet(path)
    return spark.read.parquet(path).first().id


def counters(spark: SparkSession, path: str, labels: DataFrame, folder: str, key: str = "doc_id",
             part: str = "lang", batches: int = BATCHES) -> DataFrame:
    """Stream the Parquet table at ``path`` and return its counters (part, mask, flags, n).

    ``folder`` holds the stream's checkpoint and the counts by batch; the same folder goes on after a
    failure where the stream stopped, and takes in files that have come since.
    """
    path = path.rstrip("/")
    table = spark.read.parquet(path)
    files = max(1, -(-len(table.inputFiles()) // batches))

    def add(frame: DataFrame, number: int) -> None:
        frame.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(
            f"{folder}/counts/batch={number}")

    # as a pattern, the path may also be a single file
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(pattern)
    query = (
        counted(stream, labels, key, part, buckets_of(spark, folder, table.count())).writeStream.foreachBatch(add).outputMode("append")
        .option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    found = spark.read.schema(COUNTS).parquet(f"{folder}/counts") if query.lastProgress else (
        spark.createDataFrame([], COUNTS))
    return found.groupBy("part", "mask", "flags").agg(F.sum("n").alias("n")).filter("n != 0")


def steps(filters: str = FILTERS) -> list[dict]:
    """All orders of the filters, step by step, with the bits of this and the earlier filters."""
    return [
        {"filter_order": "".join(order), "step": k + 1, "bit": 1 << filters.index(name),
         "earlier": sum(1 << filters.index(x) for x in order[:k])}
        for order in itertools.permutations(filters) for k, name in enumerate(order)
    ]


def interaction(counts: DataFrame) -> DataFrame:
    """What every filter does at every place of every order, per part."""
    kind = "array<struct<filter_order:string,step:int,bit:int,earlier:int>>"
    each = counts.select("*", F.inline(F.from_json(F.lit(json.dumps(steps())), kind)))
    fails, before = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    gone = fails & ~before
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("bigint")
    orders = len(steps()) // len(FILTERS)
    return each.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~before).alias("kept"), total(gone).alias("removed"),
        total(fails & before).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(gone & (F.col("flags").bitwiseAND(1) != 0)).alias("good_lost"),
        total(gone & (F.col("flags").bitwiseAND(2) != 0)).alias("toxic_lost"),
        # in an equal share of all orders each of the filters that a row fails comes first
        F.sum(F.when(fails, F.col("n") * F.lit(orders) / F.bit_count("mask")).otherwise(0))
        .cast("bigint").alias("shapley"),
    )


def filter_audit(spark: SparkSession, path: str, labels: DataFrame, key: str = "doc_id", part: str = "lang",
                 batches: int = BATCHES) -> DataFrame:
    """``interaction`` of the filters over the Parquet table at ``path``, streamed below the shared folder.

    Null texts are empty; a null part is the empty string; null ids come after all others, and rows
    with equal ids (repeated rows among them) are not copies of each other; texts are compared whole,
    by a 128-bit digest; a label counts if any row of ``labels`` has it; null labels do not; other
    columns are not used; an empty table has no rows. Ids must fit in 64 bits.
    """
    folder = shared_folder(spark, "filter-audit")
    found = cut(interaction(counters(spark, path, labels, folder, key, part, batches)))
    removed_folder(spark, folder)
    return found
