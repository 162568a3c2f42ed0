"""A log read as a stream in several micro-batches gives the rows of the batch operators."""

import random

import pytest

from tracebound.operators import edits, tree
from tracebound.streaming import logs as streams

SCHEMA = "project string, seq bigint, base_revision bigint, op string, digest string"


@pytest.fixture(scope="module")
def data():
    rng = random.Random(2)
    rows = []
    for seq in range(1, 31):
        for p in ("a", "b", "c"):
            rows.append((p, seq, rng.randrange(max(1, seq // 2) + 1), rng.choice(["patch", "undo", "redo"]), f"d{rng.randrange(2)}"))
    return rows


@pytest.fixture
def replayed(spark, data, tmp_path):
    """Run a streaming operator over the log, one file and one micro-batch per ten edits."""
    def run(build, name, mode="append"):
        source = tmp_path / name
        for part in range(3):
            batch = [r for r in data if (r[1] - 1) // 10 == part]
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = (build(stream).writeStream.format("memory").queryName(name).outputMode(mode)
                 .option("checkpointLocation", str(tmp_path / f"{name}-state")).start())
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return spark.table(name)

    return run


def compare(batch, stream):
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.select(*batch.columns).collect()))


def test_patches(spark, data, replayed):
    log = spark.createDataFrame(data, SCHEMA)
    compare(edits.apply_patches(log, ["project"]),
            replayed(lambda s: streams.stream_patches(s, ["project"]), "t01_stream"))


def test_replay(spark, data, replayed):
    log = spark.createDataFrame(data, SCHEMA)
    compare(edits.replay(log, ["project"]),
            replayed(lambda s: streams.stream_replay(s, ["project"]), "t02_stream"))


def test_write_once(spark, data, replayed):
    log = spark.createDataFrame(data, SCHEMA).select("project", "seq", "digest")
    compare(edits.write_once(log, ["project"]),
            replayed(lambda s: streams.stream_write_once(s, ["project"]), "t04_stream"))


def test_publications(spark, data, replayed):
    log = spark.createDataFrame(data, SCHEMA).selectExpr("project AS publication_id", "seq", "digest AS status")
    compare(edits.upsert_publications(log), replayed(
        lambda s: streams.stream_publications(s.selectExpr("project AS publication_id", "seq", "digest AS status")),
        "t05_stream", "complete"))


def shuffled(data, seed):
    rows = list(data)
    random.Random(seed).shuffle(rows)
    return rows


@pytest.mark.parametrize("parts", [1, 4])
def test_any_order_and_a_backlog(spark, data, tmp_path, parts):
    """Rows in any order over several micro-batches, or all in one, give the batch result."""
    log = spark.createDataFrame(data, SCHEMA)
    rows = shuffled(data, parts) + data[:5]  # some come twice
    source = tmp_path / "log"
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    for name, build, want in (
            ("t01", streams.stream_patches, edits.apply_patches), ("t02", streams.stream_replay, edits.replay)):
        query = (build(stream, ["project"]).writeStream.format("memory").queryName(f"{name}_any_{parts}")
                 .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
        query.awaitTermination()
        compare(want(log, ["project"]), spark.table(f"{name}_any_{parts}"))


def test_rows_beyond_memory_wait_in_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "HELD", 3)
    data = [("a", seq, 0, "patch", "d") for seq in range(40, 0, -1)]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "log"))
    query = (streams.stream_replay(stream, ["project"]).writeStream.format("memory").queryName("t02_held")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert [r.cursor for r in spark.table("t02_held").orderBy("seq").collect()] == list(range(1, 41))


def test_deletes(spark, tmp_path):
    """Deleted parents take their nodes along, whatever the order and the batch they come in."""
    rng = random.Random(3)
    docs = [(d, f"n{i}", None if i == 0 else f"n{rng.randrange(i)}", i) for d in "de" for i in range(25)]
    nodes = spark.createDataFrame(docs, "doc string, node_id string, parent_id string, ord bigint")
    refs = spark.createDataFrame(
        [(d, n, f"s{rng.randrange(9)}") for d, n, *_ in docs for _ in range(2)] + [("d", "n9", "only")],
        "doc string, node_id string, source_id string")
    coverage = refs.select("doc", "source_id").distinct().selectExpr("*", "'preserved' AS status").unionByName(
        spark.createDataFrame([("d", "unused", "covered")], "doc string, source_id string, status string"))
    gone = [(d, n, k + 1) for d in "de" for k, (_, n, *_) in enumerate(rng.sample([x for x in docs[1:25]], 9))]
    gone += gone[:2]
    source, out = tmp_path / "deletes", tmp_path / "coverage"
    rng.shuffle(gone)
    kind = "doc string, node_id string, seq bigint"
    for k in range(3):
        spark.createDataFrame(gone[k::3], kind).coalesce(1).write.mode("append").parquet(str(source))
    below = tree.subtree_intervals(tree.tree_intervals(nodes, ["doc"]), nodes, ["doc"])
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = streams.stream_coverage(stream, coverage, refs, below, ["doc"]).writeStream.outputMode(
        "update").foreachBatch(streams.coverage_sink(str(out))).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    changes = spark.read.parquet(str(out))
    flat = tree.flatten_tree(nodes, ["doc"])
    batch = edits.coverage_on_delete(coverage, refs, spark.createDataFrame(gone, kind), flat, ["doc"])
    compare(batch, streams.coverage_now(coverage, changes, refs, ["doc"]))
    assert changes.filter("source_id = 'unused'").isEmpty()
    assert {r.status for r in batch.collect()} == {"preserved", "omitted", "covered"}
