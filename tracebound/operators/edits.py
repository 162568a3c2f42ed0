"""T-01..T-05, W-06..W-08, W-10, W-13, N-07, O-02, O-03, S-12: edit logs and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebound.functions.text import stable_id
from tracebound.operators.rules import valid_override
from tracebound.operators.tree import subtree
from tracebound.plans.lineage import cut
from tracebound.plans.ordered import carry_last, running_sum
from tracebound.plans.prefix import chunk_starts

# Edits of one project folded inside one row; longer logs are cut into such chunks.
CHUNK = 256


# --- T-01 ------------------------------------------------------------------------


def _fold(entries: Column, start: Column) -> Column:
    """Replay one chunk from a known revision: per edit, whether it was accepted."""
    state = F.struct(
        start.alias("revision"),
        F.array().cast("array<struct<seq:bigint,accepted:boolean,revision:bigint>>").alias("out"),
    )

    def step(acc, e):
        accepted = e["base"] == acc["revision"]
        revision = acc["revision"] + F.when(accepted, 1).otherwise(0)
        return F.struct(
            revision.alias("revision"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        e["seq"].alias("seq"), F.coalesce(accepted, F.lit(False)).alias("accepted"),
                        revision.alias("revision"),
                    )
                ),
            ).alias("out"),
        )

    return F.aggregate(entries, state, step)


def _transfer(entries: Column) -> Column:
    """Map of a chunk: revision before it to revision after it, where the two differ.

    Built backwards. An edit on base ``b`` turns ``b`` into ``b + 1``, and from there the
    later edits decide; every other revision passes it unchanged.
    """
    def step(acc, e):
        target = F.coalesce(F.try_element_at(acc, e["base"] + 1), e["base"] + 1)
        return F.map_concat(
            F.map_filter(acc, lambda k, _: k != e["base"]),
            F.create_map(e["base"], target),
        )

    known = F.filter(entries, lambda e: e["base"].isNotNull())
    return F.aggregate(
        F.reverse(known), F.create_map().cast("map<bigint,bigint>"), step
    )


def apply_patches(log: DataFrame, key: list[str], initial: int = 0,
                  chunk: int = CHUNK) -> DataFrame:
    """T-01: per project, an edit is accepted when its base is the current revision.

    ``log(key, seq, base_revision)``, ``seq`` unique per project and counted from 1.
    Returns ``key, seq, base_revision, accepted, revision``; a conflict carries the current
    revision. Logs are folded in chunks of ``chunk`` edits, so no project is ever collected
    whole; the starting revisions of the chunks of long logs come from a prefix scan.
    """
    chunk_no = F.floor((F.col("seq") - 1) / chunk).cast("bigint")
    entry = F.struct(F.col("seq").cast("bigint").alias("seq"),
                     F.col("base_revision").cast("bigint").alias("base"))
    chunks = log.groupBy(*key, chunk_no.alias("chunk")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    if not log.agg(F.max(chunk_no)).first()[0]:
        placed = chunks.withColumn("start", F.lit(initial).cast("bigint"))
    else:
        long_logs = chunks.filter(F.col("chunk") > 0).select(*key).distinct()
        maps = cut(
            chunks.join(long_logs, key, "left_semi")
            .select(*key, "chunk", _transfer(F.col("entries")).alias("map"))
        )
        starts = chunk_starts(
            maps.select(*key, "chunk", F.explode("map").alias("start", "end")),
            maps.select(*key, "chunk", F.lit(0).cast("bigint").alias("shift")), key, initial)
        placed = chunks.join(starts, [*key, "chunk"], "left").withColumn(
            "start", F.coalesce("start", F.lit(initial).cast("bigint"))
        )
    folded = placed.select(
        *key,
        F.explode(
            F.zip_with(
                _fold(F.col("entries"), F.col("start"))["out"], "entries",
                lambda o, e: F.struct(
                    o["seq"].alias("seq"), e["base"].alias("base_revision"),
                    o["accepted"].alias("accepted"), o["revision"].alias("revision"),
                ),
            )
        ).alias("o"),
    )
    return folded.select(*key, "o.*")


# --- T-02 ------------------------------------------------------------------------


def _moved(cursor: Column, length: Column, op: Column) -> tuple[Column, Column]:
    """Cursor and length after an operation."""
    undo, redo = op.eqNullSafe("undo"), op.eqNullSafe("redo")
    after = (
        F.when(undo, F.greatest(cursor - 1, F.lit(0)))
        .when(redo, F.least(cursor + 1, length)).otherwise(cursor + 1)
    )
    return after, F.when(undo | redo, length).otherwise(cursor + 1)


def _bigints(**fields) -> Column:
    return F.struct(*[F.lit(v).cast("bigint").alias(k) if isinstance(v, int) else v.alias(k)
                      for k, v in fields.items()])


def _replayed(ops: Column, cursor: Column) -> Column:
    """Every operation of a piece with the state after it; the revision counts from the piece's start."""
    state = F.struct(
        cursor.alias("cursor"), cursor.alias("length"), F.lit(0).cast("bigint").alias("revision"),
        F.array().cast("array<struct<seq:bigint,op:string,effective:boolean,cursor:bigint,"
                       "length:bigint,revision:bigint>>").alias("out"))

    def step(acc, e):
        cursor, length = _moved(acc["cursor"], acc["length"], e["op"])
        effective = cursor != acc["cursor"]
        revision = acc["revision"] + effective.cast("bigint")
        row = F.struct(
            e["seq"].alias("seq"), e["op"].alias("op"), effective.alias("effective"),
            cursor.alias("cursor"), length.alias("length"), revision.alias("revision"))
        return F.struct(cursor.alias("cursor"), length.alias("length"), revision.alias("revision"),
                        F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(ops, state, step)["out"]


def _outline(ops: Column) -> Column:
    """What a piece does to a cursor that never meets zero: ``shift``, and the cursor it ``need``s."""
    def step(acc, e):
        undo, redo = e["op"].eqNullSafe("undo"), e["op"].eqNullSafe("redo")
        back = redo & (acc["ahead"] > 0)
        return _bigints(
            shift=acc["shift"] + F.when(undo, -1).when(redo, back.cast("int")).otherwise(1),
            ahead=F.when(undo, acc["ahead"] + 1).when(redo, acc["ahead"] - back.cast("int")).otherwise(0)
            .cast("bigint"),
            need=F.when(undo, F.greatest(acc["need"], 1 - acc["shift"])).otherwise(acc["need"]),
        )

    return F.aggregate(ops, _bigints(shift=0, ahead=0, need=0), step)


def _ends(ops: Column, need: Column) -> Column:
    """The cursor after a piece for every cursor before it that is less than the piece needs."""
    def end(start):
        def step(acc, e):
            cursor, length = _moved(acc["cursor"], acc["length"], e["op"])
            return _bigints(cursor=cursor, length=length)

        return F.struct(start.alias("start"),
                        F.aggregate(ops, _bigints(cursor=start, length=start), step)["cursor"].alias("end"))

    low = F.sequence(F.lit(0).cast("bigint"), need - 1)
    return F.when(need > 0, F.transform(low, end)).otherwise(
        F.array().cast("array<struct<start:bigint,end:bigint>>"))


def _pieces(log: DataFrame, key: list[str], size: int) -> DataFrame:
    """``key, piece, ops``: logs cut at the first patch of each chunk of ``size`` operations.

    Behind a patch there is nothing to redo, so the cursor is all that a piece hands on. Piece 0 also
    has what comes before the first patch.
    """
    chunk = F.floor((F.col("seq") - 1) / size).cast("bigint")
    entry = F.struct(F.col("seq").cast("bigint").alias("seq"), "op")
    chunks = log.groupBy(*key, chunk.alias("chunk")).agg(F.array_sort(F.collect_list(entry)).alias("ops"))
    if not log.agg(F.max(chunk)).first()[0]:
        return chunks.withColumnRenamed("chunk", "piece")
    chunks = cut(chunks)
    kinds = F.transform("ops", lambda e: ~F.coalesce(e["op"], F.lit("")).isin("undo", "redo"))
    patch = F.array_position(kinds, True)
    cuts = chunks.select(*key, "chunk", (patch > 0).alias("__cut"))
    # the first chunk begins the first piece, with or without a patch
    owner = carry_last(
        cuts, key, [F.col("chunk")], F.floor(F.col("chunk") / 4096),
        F.when(F.col("__cut") | (F.col("chunk") == 0), F.col("chunk")), "__owner", include_current=False,
    ).select(*key, "chunk", "__owner")
    begin = F.when(F.col("chunk") == 0, 1).when(patch > 0, patch).otherwise(F.size("ops") + 1).cast("int")
    parts = chunks.join(owner, [*key, "chunk"]).select(*key, F.inline(F.array(
        F.struct(F.coalesce("__owner", "chunk").alias("piece"), F.col("chunk"), F.slice("ops", 1, begin - 1).alias("ops")),
        F.struct(F.col("chunk").alias("piece"), F.col("chunk"),
                 F.slice("ops", begin, F.size("ops") + 1).alias("ops")),
    ))).filter(F.size("ops") > 0)
    return parts.groupBy(*key, "piece").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "ops"))).alias("parts")
    ).select(*key, "piece", F.flatten("parts.ops").alias("ops"))


def replay(log: DataFrame, key: list[str], round_size: int = CHUNK) -> DataFrame:
    """T-02: undo/redo replay: ``key, seq, op, effective, cursor, length, revision``.

    ``log(key, seq, op)`` with ``op`` one of ``patch``, ``undo``, ``redo`` (anything else is a patch),
    ``seq`` unique per project and counted from 1. A patch cuts the redo history; undo and redo at an
    end do nothing; every effective operation raises the revision.

    A log is cut into pieces of about ``round_size`` operations that begin with a patch. A cursor that is
    at least what a piece needs is shifted by it; for the smaller ones the end is worked out. Pieces
    compose, so a prefix scan finds the cursor before each, and all pieces are then replayed side by side.
    Operations in a row without any patch stay in one piece.
    """
    pieces = _pieces(log, key, round_size)
    longest = pieces.agg(F.max("piece")).first()[0]
    zero = F.lit(0).cast("bigint")
    if not longest:
        return pieces.select(*key, F.inline(_replayed(F.col("ops"), zero)))
    pieces = cut(pieces)
    long_logs = pieces.filter("piece > 0").select(*key).distinct()
    outlines = cut(
        pieces.join(long_logs, key, "left_semi").withColumn("__outline", _outline(F.col("ops")))
        .select(*key, F.col("piece").alias("chunk"), "__outline.shift",
                _ends(F.col("ops"), F.col("__outline.need")).alias("ends"))
    )
    starts = chunk_starts(
        outlines.select(*key, "chunk", F.inline("ends")), outlines.select(*key, "chunk", "shift"),
        key, 0, least=0)
    placed = pieces.join(
        starts.withColumnRenamed("chunk", "piece"), [*key, "piece"], "left"
    ).select(*key, "piece", _replayed(F.col("ops"), F.coalesce("start", zero)).alias("out"))
    placed = cut(placed)
    counts = placed.select(*key, "piece", F.element_at("out", -1)["revision"].alias("n"))
    before = running_sum(
        counts, key, [F.col("piece")], F.floor(F.col("piece") / 4096), F.col("n"), "__upto"
    ).select(*key, "piece", (F.col("__upto") - F.col("n")).alias("__before"))
    return placed.join(before, [*key, "piece"]).select(*key, "__before", F.inline("out")).withColumn(
        "revision", F.col("revision") + F.col("__before")).drop("__before")


def applied_patches(replayed: DataFrame, key: list[str]) -> DataFrame:
    """The patches in force after a replay, one per history slot below the cursor.

    A slot holds the last patch that was written to it, so it is a ``max_by`` per slot.
    """
    visits = replayed.groupBy(*key, F.col("cursor").alias("slot")).agg(
        F.max("seq").alias("__last"),
        F.max(F.when(F.col("op") == "patch", F.col("seq"))).alias("seq"),
    )
    # The slot visited last is where the cursor stands.
    ends = visits.groupBy(*key).agg(F.max_by("slot", "__last").alias("__end"))
    return (
        visits.filter(F.col("seq").isNotNull()).join(ends, key)
        .filter(F.col("slot") <= F.col("__end"))
        .select(*key, "slot", "seq")
    )


# --- T-03 ------------------------------------------------------------------------


def coverage_on_delete(coverage: DataFrame, node_refs: DataFrame, deleted: DataFrame,
                       flat: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """T-03: coverage after nodes were deleted, one after the other.

    ``coverage(keys, source_id, status)``, ``node_refs(keys, node_id, source_id)``,
    ``deleted(keys, node_id, seq)``; ``flat`` is the tree from ``flatten_tree``: with a node go all
    nodes below it (without ``flat`` only the node itself). A source whose last node went becomes
    ``omitted``, and the reason names the deletion that took the last one; others keep their
    status and get a new node count.
    """
    keys = keys or []
    if flat is None:
        gone = deleted.select(*keys, F.col("node_id").alias("root_id"), "node_id", "seq")
    else:
        gone = subtree(flat, deleted, keys).join(
            deleted.select(*keys, F.col("node_id").alias("root_id"), "seq"), [*keys, "root_id"])
    # a node goes with the first deletion that covers it
    first = gone.groupBy(*keys, "node_id").agg(
        F.min(F.struct("seq", "root_id")).alias("__gone"))
    nodes = (
        node_refs.select(*keys, "node_id", "source_id").distinct()
        .join(first, [*keys, "node_id"], "left")
        .groupBy(*keys, "source_id")
        .agg(
            F.count_if(F.col("__gone").isNull()).alias("nodes"),
            F.max("__gone").alias("__last"),
        )
    )
    dropped = (F.coalesce("nodes", F.lit(0)) == 0) & F.col("__last").isNotNull()
    return (
        coverage.join(nodes, [*keys, "source_id"], "left")
        .select(
            *keys, "source_id",
            F.when(dropped, "omitted").otherwise(F.col("status")).alias("status"),
            F.coalesce("nodes", F.lit(0)).cast("bigint").alias("nodes"),
            F.when(dropped, F.concat(F.lit('user deleted report node "'),
                                     F.col("__last.root_id").cast("string"),
                                     F.lit('"'))).alias("reason"),
        )
    )


# --- T-04, T-05 --------------------------------------------------------------------


def write_once(receipts: DataFrame, key: list[str]) -> DataFrame:
    """T-04: ``key, seq, outcome``: the first record of a key is kept.

    ``receipts(key, seq, digest)``. A later identical record is a no-op, a different one a
    conflict. The first record comes from a pre-aggregated ``min_by``.
    """
    first = receipts.groupBy(*key).agg(
        F.min_by(F.struct("seq", "digest"), "seq").alias("__first")
    )
    outcome = (
        F.when(F.col("seq") == F.col("__first.seq"), "written")
        .when(F.col("digest").eqNullSafe(F.col("__first.digest")), "unchanged")
        .otherwise("conflict")
    )
    return receipts.join(first, key).withColumn("outcome", outcome).drop("__first")


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key, by pre-aggregation instead of a window."""
    others = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
        .select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])
    )


def upsert_publications(log: DataFrame) -> DataFrame:
    """T-05: by publication id, the last status wins. ``log(publication_id, seq, ...)``."""
    return last_by(log, ["publication_id"], ["seq"])


def last_write_wins(overrides: DataFrame) -> DataFrame:
    """W-10: current value per (node, field); rows without valid provenance are ignored."""
    return last_by(overrides.filter(valid_override()), ["node_id", "field"], ["seq"])


# --- versions -----------------------------------------------------------------------


def version_parents(versions: DataFrame, variant: str = "variant_id",
                    order: tuple[str, ...] = ("created_at", "version_id"),
                    bucket: Column | None = None) -> DataFrame:
    """W-06: previous version of the same variant.

    ``bucket`` cuts a long history along its order; the month of ``created_at`` by default.
    """
    return carry_last(
        versions, [variant], [F.col(c) for c in order],
        F.date_trunc("month", "created_at") if bucket is None else bucket,
        F.col("version_id"), "parent_version_id", include_current=False,
    )


def circular_versions(versions: DataFrame) -> DataFrame:
    """W-07: issues for versions whose chain of parents never ends: ``version_id, code``."""
    hops = versions.select(F.col("version_id").alias("id"), F.col("parent_version_id").alias("to"))
    for _ in range(hops.count().bit_length() + 1):
        ahead = hops.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        hops = cut(hops.join(ahead, "to").select("id", F.col("beyond").alias("to")))
    return hops.filter(F.col("to").isNotNull()).select(
        F.col("id").alias("version_id"), F.lit("circular-version").alias("code"))


def delete_versions(versions: DataFrame, deleted: DataFrame) -> DataFrame:
    """W-07: remove versions; children move to the removed version's parent.

    ``versions(version_id, parent_version_id, ...)``, ``deleted(version_id)``. Chains of
    removed versions are collapsed by pointer doubling: the longest chain halves per round.
    Removed versions that name each other in a cycle have no parent to offer; a version that
    depends on them gets NULL, and ``circular_versions`` lists them.
    """
    gone = deleted.select("version_id").distinct()
    kept = versions.join(gone, "version_id", "left_anti")
    hops = cut(
        versions.join(gone, "version_id", "left_semi")
        .select(F.col("version_id").alias("id"), F.col("parent_version_id").alias("to"))
    )
    rounds = hops.count().bit_length() + 1  # a chain of n needs log2(n) rounds, a cycle any number
    for _ in range(rounds):
        ahead = hops.select(F.col("id").alias("to"), F.col("to").alias("beyond"),
                            F.lit(True).alias("__hop"))
        if hops.join(ahead, "to", "left_semi").isEmpty():
            break
        hops = cut(
            hops.join(ahead, "to", "left")
            .select("id", F.when(F.col("__hop"), F.col("beyond")).otherwise(F.col("to")).alias("to"))
        )
    # what still leads to a removed version goes round in a cycle: there is no parent left
    circular = hops.select(F.col("id").alias("to")).withColumn("__cycle", F.lit(True))
    hops = hops.join(circular, "to", "left").select(
        "id", F.when(F.col("__cycle").isNull(), F.col("to")).alias("to"), "__cycle")
    moved = hops.select(F.col("id").alias("parent_version_id"), F.col("to").alias("__to"),
                        F.lit(True).alias("__moved"))
    return (
        kept.join(moved, "parent_version_id", "left")
        .withColumn(
            "parent_version_id",
            F.when(F.col("__moved"), F.col("__to")).otherwise(F.col("parent_version_id")),
        )
        .select(*versions.columns)
    )


def latest_publication(publications: DataFrame) -> DataFrame:
    """W-08: newest local, published row per version."""
    usable = publications.filter(
        (F.col("target") == "local") & (F.col("status") == "published")
    )
    return last_by(usable, ["version_id"], ["created_at", "publication_id"])


def dirty_flag(variants: DataFrame, versions: DataFrame) -> DataFrame:
    """W-13: no version yet, or the current digest is not that of the latest version.

    ``variants(variant_id, sha256)``, ``versions(variant_id, version_id, created_at, sha256)``.
    """
    latest = last_by(
        versions.select("variant_id", "version_id", "created_at", F.col("sha256").alias("saved")),
        ["variant_id"], ["created_at", "version_id"],
    )
    return variants.join(latest, "variant_id", "left").select(
        "variant_id", F.col("version_id").alias("latest_version_id"),
        (F.col("version_id").isNull() | ~F.col("sha256").eqNullSafe(F.col("saved"))).alias("dirty"),
    )


def preferred_order(df: DataFrame, column: str, preferred: list[str], then: str) -> DataFrame:
    """O-03: the explicit list first, in its order, then by id."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col(column))
    return df.orderBy(F.when(rank > 0, rank).otherwise(len(preferred) + 1), then)


def list_publications(publications: DataFrame) -> DataFrame:
    """O-02: by time of creation."""
    return publications.orderBy("created_at", "publication_id")


# --- cells ----------------------------------------------------------------------------


def edit_cells(cells: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """N-07: cells after the last edit of each, and the edits that hit no cell.

    ``cells(dataset_id, row_idx, col_idx, cell)``,
    ``edits(dataset_id, row_idx, col_idx, seq, value)``.
    """
    place = ["dataset_id", "row_idx", "col_idx"]
    last = last_by(edits, place, ["seq"]).select(
        *place, F.col("value").alias("__new"), F.lit(True).alias("__edited")
    )
    edited = cells.join(last, place, "left").withColumn(
        "cell", F.when(F.col("__edited"), F.col("__new")).otherwise(F.col("cell"))
    ).withColumn("edited", F.coalesce("__edited", F.lit(False))).drop("__new", "__edited")
    # Only edited places travel: cells made in an array of each row look small to the optimizer, which
    # would send them all to every task.
    hit = cells.select(*place).join(edits.select(*place).distinct(), place, "left_semi").distinct()
    return edited, edits.join(hit, place, "left_anti")


# --- publishing -------------------------------------------------------------------------


def publication_records(versions: DataFrame, target: str = "local") -> DataFrame:
    """S-12: the publication record of saved versions."""
    return versions.select(
        stable_id("pub", F.col("version_id"), F.lit(target)).alias("publication_id"),
        "version_id", "variant_id", "created_at", F.col("sha256"),
        F.lit(target).alias("target"), F.lit("published").alias("status"),
    )


def publish(version: DataFrame, publication_id: str, record: DataFrame, folder: str) -> None:
    """S-12: copy a saved version to an immutable folder and append its record."""
    version.write.mode("errorifexists").parquet(f"{folder}/artifacts/publication_id={publication_id}")
    record.write.mode("append").parquet(f"{folder}/records")
