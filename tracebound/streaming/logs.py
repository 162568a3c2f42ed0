"""T-01..T-05 as streams.

Rows of a log may arrive in any order and in any micro-batch. A keyed processor replays a row when
its predecessor has been replayed; until then it waits, a few in memory and the others in keyed map
state, so neither a backlog in one trigger nor a long gap holds a key in memory. With ``patience`` a
gap is given up after that many milliseconds, and the log goes on behind it.

The processors need ``spark.sql.streaming.stateStore.providerClass`` to name RocksDB, as
``session.SETTINGS`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracebound.operators.edits import last_by

#: Rows of a key that wait in memory before they go to map state.
HELD = 1024


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)


class InOrder(StatefulProcessor):
    """Applies ``step(state, value) -> (state, outcome)`` to the rows of a key by ``seq``, from 1 on.

    A row whose place has been replayed before is a repetition and has no output.
    """

    def __init__(self, keys: list[str], value: str, value_type: str, state_type: str, initial: tuple,
                 step: Callable, patience: int | None):
        self.keys, self.value, self.value_type = keys, value, value_type
        self.state_type, self.initial, self.step, self.patience = state_type, initial, step, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"next bigint, {self.state_type}")
        self.waiting = handle.getMapState("waiting", "seq bigint", f"value {self.value_type}")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        place, state = self._load()
        held: dict[int, object] = {}
        for row in rows:
            seq, value = row["seq"], row[self.value]
            if seq == place:
                place, state, out = self._apply(key, seq, value, state)
                yield out
                while place in held:
                    place, state, out = self._apply(key, place, held.pop(place), state)
                    yield out
            elif seq > place and seq not in held:
                held[seq] = value
                if len(held) > HELD:
                    for waiting in held:
                        self.waiting.updateValue((waiting,), (held[waiting],))
                    held = {}
        for seq in held:
            self.waiting.updateValue((seq,), (held[seq],))
        for place, state, out in self._drained(key, place, state):
            yield out
        self.state.update((place, *state))
        if self.patience is not None and self.waiting.exists():
            self._wait(timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Give up the gap: go on with the first row that waits."""
        place, state = self._load()
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None and first > place:
            place = first
        for place, state, out in self._drained(key, place, state):
            yield out
        self.state.update((place, *state))
        if self.waiting.exists():
            self._wait(timerValues)

    def close(self) -> None:
        pass

    def _load(self):
        if not self.state.exists():
            return 1, self.initial
        place, *state = self.state.get()
        return place, tuple(state)

    def _wait(self, timers):
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.patience)

    def _drained(self, key, place, state):
        """Rows of the map state that follow without a gap."""
        while self.waiting.exists() and self.waiting.containsKey((place,)):
            value = self.waiting.getValue((place,))[0]
            self.waiting.removeKey((place,))
            place, state, out = self._apply(key, place, value, state)
            yield place, state, out

    def _apply(self, key, seq, value, state):
        state, outcome = self.step(state, value)
        return seq + 1, state, Row(*self.keys, "seq", self.value, *OUTCOMES[self.step])(*key, seq, value, *outcome)


def patched(state, base):
    """T-01: a patch on the current revision raises it."""
    (revision,) = state
    accepted = base == revision
    return (revision + accepted,), (accepted, revision + accepted)


def moved(state, op):
    """T-02: cursor, length and revision after an operation."""
    cursor, length, revision = state
    if op == "undo":
        effective = cursor > 0
        cursor -= effective
    elif op == "redo":
        effective = cursor < length
        cursor += effective
    else:
        effective, cursor = True, cursor + 1
        length = cursor
    state = cursor, length, revision + effective
    return state, (effective, *state)


def written(state, digest):
    """T-04: the first record of a key is kept."""
    first, kept = state
    if first:
        return (False, digest), ("written",)
    return state, ("unchanged" if digest == kept else "conflict",)


#: Output columns of the steps.
OUTCOMES = {
    patched: ["accepted", "revision"],
    moved: ["effective", "cursor", "length", "revision"],
    written: ["outcome"],
}


def _in_order(log: DataFrame, key: list[str], value: str, state_type: str, initial: tuple, step: Callable,
              outcome: str, patience: int | None) -> DataFrame:
    rows = log.select(*key, F.col("seq").cast("bigint").alias("seq"), value)
    kind = rows.schema[value].dataType.simpleString()
    processor = InOrder(key, value, kind, state_type, initial, step, patience)
    fields = ", ".join(_fields(rows, [k]) for k in key)
    return rows.groupBy(*key).transformWithState(
        processor, f"{fields}, seq bigint, `{value}` {kind}, {outcome}", "append",
        "none" if patience is None else "processingTime")


def stream_patches(log: DataFrame, key: list[str], initial: int = 0, patience: int | None = None) -> DataFrame:
    """T-01 on a stream: the rows of ``apply_patches``, each once its predecessors have come."""
    log = log.withColumn("base_revision", F.col("base_revision").cast("bigint"))
    return _in_order(log, key, "base_revision", "revision bigint", (initial,), patched,
                     "accepted boolean, revision bigint", patience)


def stream_replay(log: DataFrame, key: list[str], patience: int | None = None) -> DataFrame:
    """T-02 on a stream: the rows of ``replay``, each once its predecessors have come."""
    return _in_order(log, key, "op", "cursor bigint, length bigint, revision bigint", (0, 0, 0), moved,
                     "effective boolean, cursor bigint, length bigint, revision bigint", patience)


def stream_write_once(receipts: DataFrame, key: list[str], patience: int | None = None) -> DataFrame:
    """T-04 on a stream: the rows of ``write_once``, each once its predecessors have come."""
    kind = receipts.schema["digest"].dataType.simpleString()
    return _in_order(receipts, key, "digest", f"first boolean, kept {kind}", (True, None), written,
                     "outcome string", patience)


class NodesLeft(StatefulProcessor):
    """T-03: counts the nodes left of one source while deletions come in.

    Map state has the first deletion of every node that went; value state has how many went and the
    latest of these deletions. An earlier deletion that arrives late takes a node's place.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gone = handle.getMapState("gone", "node string", "seq bigint, root string")
        self.state = handle.getValueState("state", "gone bigint, seq bigint, root string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        count, *last = self.state.get() if self.state.exists() else (0, None, None)
        last = tuple(last) if count else None
        before, again, source = (count, last), False, None
        for row in rows:
            source, hit = row, (row["seq"], row["root_id"])
            known = tuple(self.gone.getValue((row["node_id"],))) if count and self.gone.containsKey(
                (row["node_id"],)) else None
            if known is not None and known <= hit:
                continue
            self.gone.updateValue((row["node_id"],), hit)
            if known is None:
                count += 1
            elif known == last:  # the latest deletion may now be another node's
                again = True
            last = hit if last is None else max(last, hit)
        if again:
            last = max(tuple(v) for v in self.gone.values())
        if (count, last) == before:
            return
        self.state.update((count, *last))
        left = source["total"] - count
        reason = None if left else f'user deleted report node "{last[1]}"'
        yield Row(*self.keys, "source_id", "status", "nodes", "reason")(
            *key, "omitted" if left == 0 else source["status"], left, reason)

    def close(self) -> None:
        pass


def stream_coverage(deleted: DataFrame, coverage: DataFrame, node_refs: DataFrame, below: DataFrame,
                    keys: list[str] | None = None) -> DataFrame:
    """T-03 on a stream of ``deleted(keys, node_id, seq)``: a row for every source that changes.

    ``below(keys, root_id, node_id)`` are the subtrees of ``subtree_intervals`` (a node without a row
    there takes nothing with it). Rows have the columns of ``coverage_on_delete``; the last one of a
    source counts, and sources that never change keep their row of it (see ``coverage_now``).
    Deletions may come in any order, and more than once.
    """
    keys = keys or []
    refs = node_refs.select(*keys, "node_id", "source_id").distinct()
    total = refs.groupBy(*keys, "source_id").agg(F.count(F.lit(1)).alias("total"))
    told = (
        refs.join(total, [*keys, "source_id"])
        .join(coverage.select(*keys, "source_id", "status"), [*keys, "source_id"])
        .join(below.select(*keys, "root_id", "node_id"), [*keys, "node_id"])
        .select(*keys, "root_id", F.col("node_id").cast("string").alias("node_id"), "source_id", "status", "total")
    )
    hits = deleted.select(
        *keys, F.col("node_id").alias("root_id"), F.col("seq").cast("bigint").alias("seq")
    ).join(told, [*keys, "root_id"]).withColumn("root_id", F.col("root_id").cast("string"))
    fields = ", ".join(_fields(hits, [k]) for k in [*keys, "source_id", "status"])
    return hits.groupBy(*keys, "source_id").transformWithState(
        NodesLeft(keys), f"{fields}, nodes bigint, reason string", "update", "none")


def coverage_sink(folder: str):
    """Write the changed sources of every batch under its number, for ``foreachBatch``."""
    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return run


def coverage_now(coverage: DataFrame, changes: DataFrame, node_refs: DataFrame,
                 keys: list[str] | None = None) -> DataFrame:
    """The rows of ``coverage_on_delete`` from the last change of each source."""
    on = [*(keys or []), "source_id"]
    last = last_by(changes, on, ["batch"]).select(*on, F.struct("status", "nodes", "reason").alias("__last"))
    total = node_refs.select(*on, "node_id").distinct().groupBy(*on).agg(F.count(F.lit(1)).alias("__total"))
    at_first = F.struct(
        F.col("status"), F.coalesce("__total", F.lit(0)).cast("bigint").alias("nodes"),
        F.lit(None).cast("string").alias("reason"))
    return (
        coverage.join(last, on, "left").join(total, on, "left")
        .select(*on, F.coalesce("__last", at_first).alias("__now")).select(*on, "__now.*")
    )


def stream_publications(log: DataFrame) -> DataFrame:
    """T-05 on a stream: the last status per publication, in update or complete mode."""
    others = [c for c in log.columns if c != "publication_id"]
    return (
        log.groupBy("publication_id")
        .agg(F.max_by(F.struct(*others), "seq").alias("__row"))
        .select("publication_id", *[F.col(f"__row.{c}").alias(c) for c in others])
    )
