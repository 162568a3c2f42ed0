"""W-11, J-17, F-05, N-01, N-02: tag streams and node trees.

One page is one cell of the input, so windows over the tags of a page stay small; only
positions and short tags are shuffled, never the page text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebound.functions import fixed
from tracebound.functions.html import attribute_pattern
from tracebound.functions.lets import extract, found, matches, non_blank, substitute
from tracebound.plans.lineage import cut
from tracebound.plans.ordered import running_sum

_TAG = r"</?[A-Za-z][^<>]*>"


def tag_tree(pages: DataFrame, key: str = "page_id", html: str = "html",
             drop: str = fixed.HTML_SCRIPT_STYLE) -> DataFrame:
    """W-11: opening tags in document order: ``key, pos, tag, raw, depth, end_pos``.

    The contents of script and style are removed first. A tag is inside another when it
    lies before the other's ``end_pos``. Void tags and tags whose end tag is optional are
    leaves: they change no depth. Depth never falls below zero; an element that is never
    closed ends with the page (``end_pos`` NULL).
    """
    leaves = [*fixed.VOID_TAGS, *fixed.OPTIONAL_CLOSE_TAGS]
    tags = (
        pages.select(
            key, F.posexplode(matches(substitute(F.col(html), drop, ""), _TAG))
            .alias("pos", "raw")
        )
        .withColumn("pos", F.col("pos").cast("bigint"))
        .withColumn("tag", F.lower(F.regexp_extract("raw", r"^</?([A-Za-z][A-Za-z0-9-]*)", 1)))
        .withColumn("closing", F.col("raw").startswith("</"))
        .withColumn(
            "step",
            F.when(F.col("tag").isin(*leaves) | F.col("raw").endswith("/>"), 0)
            .when(F.col("closing"), -1).otherwise(1),
        )
    )
    in_order = Window.partitionBy(key).orderBy("pos")
    after = F.sum("step").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    levelled = tags.withColumn("after", after).withColumn(
        "level", F.when(F.col("step") > 0, F.col("after") - 1).otherwise(F.col("after"))
    )
    # An element opened at a level ends at the next event on that level.
    same_level = Window.partitionBy(key, "level", F.col("step") != 0).orderBy("pos")
    return (
        levelled.withColumn("next", F.lead("pos").over(same_level))
        .filter(~F.col("closing"))
        .select(
            key, "pos", "tag", "raw",
            F.greatest(F.lit(0), F.col("level")).cast("bigint").alias("depth"),
            F.when(F.col("step") == 0, F.col("pos")).otherwise(F.col("next")).alias("end_pos"),
        )
    )


def tag_signature(tags: DataFrame) -> DataFrame:
    """``depth:tag:role`` of each tag, the alphabet of the structural trigrams."""
    def quoted(name):
        return non_blank(extract("raw", attribute_pattern(name), 1))

    role = F.coalesce(quoted("data-role"), quoted("data-content-id"), F.lit(""))
    return tags.withColumn(
        "signature", F.concat_ws(":", F.col("depth").cast("string"), "tag", role)
    )


def _open_close(tags: DataFrame, marked: Column, key: str) -> DataFrame:
    """Tags plus one closing row per marked element; ``step`` counts the open marked ones."""
    opens = tags.withColumn("step", F.when(marked, 1).otherwise(0))
    closes = tags.filter(marked & F.col("end_pos").isNotNull()).select(
        key, F.col("end_pos").alias("pos"), F.lit(-1).alias("step")
    )
    return opens.unionByName(closes, allowMissingColumns=True)


def nearest_ancestor_value(tags: DataFrame, attribute: str, key: str = "page_id") -> DataFrame:
    """J-17: value of the nearest ancestor with the attribute, else of the first descendant.

    No tag is compared with another. The elements with the attribute that are open at a tag
    are counted by a running sum; the innermost one is the last that was opened at that
    count. The first descendant is the next tag with the attribute, if it lies inside.
    """
    value = non_blank(extract("raw", attribute_pattern(attribute), 1))
    owners = tags.withColumn("value", value)
    # Leaves hold no other tag.
    holds = F.col("value").isNotNull() & (
        F.col("end_pos").isNull() | (F.col("end_pos") > F.col("pos"))
    )
    in_order = Window.partitionBy(key).orderBy("pos")
    events = _open_close(owners, holds, key).withColumn(
        "opened", F.sum("step").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("outside", F.col("opened") - F.when(F.col("step") > 0, 1).otherwise(0))
    # Each tag asks at the count outside itself; an owner also answers at its own count.
    asks = events.filter(F.col("tag").isNotNull()).select(
        key, "pos", "tag", "end_pos", F.col("value").alias("own"),
        F.col("outside").alias("count"), F.lit(None).cast("string").alias("answer"),
    )
    answers = events.filter(F.col("step") > 0).select(
        key, "pos", F.col("opened").alias("count"), F.col("value").alias("answer")
    )
    same_count = (
        Window.partitionBy(key, "count").orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    answered = (
        asks.unionByName(answers, allowMissingColumns=True)
        .withColumn(
            "above",
            F.when(F.col("count") > 0, F.last("answer", ignorenulls=True).over(same_count)),
        )
        .filter(F.col("tag").isNotNull())
    )
    backwards = (
        Window.partitionBy(key).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    )
    owner = F.when(F.col("own").isNotNull(), F.struct("pos", "own"))
    following = F.last(owner, ignorenulls=True).over(backwards)
    below = F.when(
        F.col("end_pos").isNull() | (F.col("__next.pos") < F.col("end_pos")), F.col("__next.own")
    )
    return answered.withColumn("__next", following).select(
        key, "pos", "tag", F.coalesce("above", below).alias("value")
    )


def statically_visible(tags: DataFrame, hidden: Column | None = None,
                       key: str = "page_id") -> DataFrame:
    """F-05: tags that are not hidden and have no hidden ancestor.

    A tag is visible while the running count of open hidden elements is zero.
    """
    rule = found(F.col("raw"), fixed.HIDDEN_TAG) if hidden is None else hidden
    marked = tags.withColumn("__hidden", rule)
    # A hidden leaf hides itself only.
    holds = F.col("__hidden") & (F.col("end_pos").isNull() | (F.col("end_pos") > F.col("pos")))
    in_order = (
        Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        _open_close(marked, holds, key)
        .withColumn("__open", F.sum("step").over(in_order))
        .filter(F.col("tag").isNotNull() & (F.col("__open") == 0) & ~F.col("__hidden"))
        .select(*tags.columns)
    )


# --- node trees ---------------------------------------------------------------


def flatten_tree(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """N-01: every node of a forest with its depth, preorder path and ancestors.

    ``nodes(keys, node_id, parent_id, ord)``, roots with a NULL parent; ``keys`` name the document
    that a node belongs to, and node ids are unique in it. A step of ``path`` is ``ord`` as sortable
    hex, then the node id, so equal and negative ``ord`` keep their subtrees apart; sorting by
    (keys, path) gives the preorder. ``ancestors`` are the ids from the root to the node. One join
    per level of the tree; the loop ends with the first empty level. A node that comes back
    among its own ancestors is an error; nodes that no root reaches are in ``unreached``.
    """
    keys = keys or []
    edges = nodes.select(*keys, "node_id", "parent_id", "ord")
    step = F.concat_ws(
        ":", F.lpad(F.hex(F.col("ord").cast("bigint").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"),
        F.hex(F.col("node_id").cast("string")))
    level = edges.filter(F.col("parent_id").isNull()).select(
        *keys, "node_id", "parent_id", F.lit(0).cast("bigint").alias("depth"), step.alias("path"),
        F.array("node_id").alias("ancestors"),
    )
    result, depth = level, 0
    while True:
        depth += 1
        parents = level.select(
            *keys, F.col("node_id").alias("parent_id"), F.col("path").alias("above"),
            F.col("ancestors").alias("__above"))
        level = cut(
            edges.join(parents, [*keys, "parent_id"]).select(
                *keys, "node_id", "parent_id", F.lit(depth).cast("bigint").alias("depth"),
                F.concat_ws(".", "above", step).alias("path"),
                F.concat("__above", F.array("node_id")).alias("ancestors"),
                F.array_contains("__above", F.col("node_id")).alias("__again"),
            )
        )
        state = level.agg(F.count(F.lit(1)), F.coalesce(F.bool_or("__again"), F.lit(False))).first()
        if state[1]:
            raise ValueError("a node is its own ancestor")
        if not state[0]:
            return result
        level = level.drop("__again")
        result = result.unionByName(level)


def unreached(nodes: DataFrame, flat: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """N-01: nodes that no root leads to: cycles, and children of unknown parents."""
    on = [*(keys or []), "node_id"]
    return nodes.join(flat.select(*on).distinct(), on, "left_anti")


def subtree(flat: DataFrame, roots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """N-02: descendants of each root, itself included: ``keys, root_id, node_id``.

    ``flat`` comes from ``flatten_tree``. Each node is exploded into its few ancestors, which are
    joined by document and id.
    """
    keys = keys or []
    anchors = roots.select(*keys, F.col("node_id").alias("root_id")).distinct()
    return (
        flat.select(*keys, "node_id", F.explode("ancestors").alias("root_id"))
        .join(anchors, [*keys, "root_id"]).select(*keys, "root_id", "node_id")
    )


def subtree_refs(tree: DataFrame, node_refs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """N-02: distinct sources cited anywhere below each root."""
    keys = keys or []
    return (
        tree.join(node_refs, [*keys, "node_id"]).select(*keys, "root_id", "source_id").distinct())


# --- intervals ------------------------------------------------------------------


def tree_intervals(nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """N-01: preorder intervals of a forest: ``keys, node_id, parent_id, depth, enter, leave``.

    ``nodes(keys, node_id, parent_id, ord)`` as for ``flatten_tree``, in the same order. ``enter`` counts
    the nodes of the document before a node, from 0; a node's descendants are those that enter after it
    and not after its ``leave``. Pointers to ancestors double in reach each round, first to sum up the
    sizes of subtrees, then the places: a tree of depth d takes 2 log2(d) rounds, and no row grows with
    the depth. Nodes that no root reaches (cycles, unknown parents) have no row.
    """
    keys = keys or []
    on, size = [*keys, "node_id"], F.col("size")
    base = nodes.select(*keys, "node_id", "parent_id", F.col("ord").cast("bigint").alias("ord"))
    one = F.lit(1).cast("bigint")
    jump = cut(base.select(
        *on, F.col("parent_id").alias("up"), one.alias("size"),
        F.when(F.col("parent_id").isNotNull(), one).otherwise(0).alias("depth"),
        F.col("parent_id").isNull().alias("rooted")))
    rounds = 0
    most = jump.count().bit_length() + 1  # only a cycle goes on for longer
    while rounds < most and not jump.filter(F.col("up").isNotNull()).isEmpty():
        rounds += 1
        gain = jump.filter(F.col("up").isNotNull()).groupBy(*keys, F.col("up").alias("node_id")).agg(
            F.sum("size").alias("__gain"))
        above = jump.select(
            *keys, F.col("node_id").alias("up"), F.col("up").alias("__up"),
            F.col("depth").alias("__depth"), F.col("rooted").alias("__rooted"))
        jump = cut(
            jump.join(gain, on, "left").join(above, [*keys, "up"], "left").select(
                *on, F.col("__up").alias("up"),
                (size + F.coalesce("__gain", F.lit(0))).alias("size"),
                (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"),
                (F.col("rooted") | (F.col("up").isNotNull() & F.coalesce("__rooted", F.lit(False)))).alias("rooted")))
    known = cut(base.join(jump.filter(F.col("rooted") & F.col("up").isNull()).drop("up", "rooted"), on))
    order = [F.col("ord"), F.hex(F.col("node_id").cast("string"))]
    placed = running_sum(known, [*keys, "parent_id"], order, F.floor(F.col("ord") / 4096), size, "__upto",
                         spread_hot=True)  # few nodes have many children
    inside = F.when(F.col("parent_id").isNotNull(), 1).otherwise(0)
    placed = cut(placed.withColumn("enter", (F.col("__upto") - size + inside).cast("bigint")).select(
        *on, "parent_id", F.col("parent_id").alias("up"), "depth", "size", "enter"))
    for _ in range(rounds):
        above = placed.select(
            *keys, F.col("node_id").alias("up"), F.col("up").alias("__up"), F.col("enter").alias("__enter"))
        placed = cut(placed.join(above, [*keys, "up"], "left").select(
            *on, "parent_id", F.col("__up").alias("up"), "depth", "size",
            (F.col("enter") + F.coalesce("__enter", F.lit(0))).alias("enter")))
    return placed.select(*on, "parent_id", "depth", "enter", (F.col("enter") + size - 1).alias("leave"))


#: Bits by which the blocks of a level are larger than those of the level below.
BLOCK_BITS = 4


def _blocks(enter: Column, leave: Column) -> Column:
    """The aligned blocks of 1, 16, 256, ... places that make up an interval: level and number.

    Less than 30 of each level, and no more levels than the interval has hexadecimal digits.
    """
    kind = "array<struct<level:int,block:bigint>>"
    state = F.struct(enter.alias("a"), (leave + 1).alias("b"), F.array().cast(kind).alias("out"))

    def step(acc, level):
        a, b = acc["a"], acc["b"]
        # the next larger blocks that lie inside; without any, the rest is taken at this level
        up, down = F.shiftright(a + ((1 << BLOCK_BITS) - 1), BLOCK_BITS), F.shiftright(b, BLOCK_BITS)
        more = up < down

        def taken(start, end):
            return F.when(start < end, F.transform(F.sequence(start, end - 1), lambda n: F.struct(
                level.alias("level"), n.alias("block")))).otherwise(F.array().cast(kind))

        return F.struct(
            F.when(more, up).otherwise(F.lit(0)).alias("a"), F.when(more, down).otherwise(F.lit(0)).alias("b"),
            F.concat(
                acc["out"], taken(a, F.when(more, F.shiftleft(up, BLOCK_BITS)).otherwise(b)),
                F.when(more, taken(F.shiftleft(down, BLOCK_BITS), b)).otherwise(F.array().cast(kind)),
            ).alias("out"))

    digits = F.ceil(F.length(F.bin(leave - enter + 1)) / BLOCK_BITS).cast("int")
    return F.aggregate(F.sequence(F.lit(0), digits - 1), state, step)["out"]


def subtree_intervals(intervals: DataFrame, roots: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """N-02: descendants of each root, itself included, from ``tree_intervals``: ``keys, root_id, node_id``.

    The interval below a root is a few aligned blocks, a node lies in one block of each size; both meet
    by equality, so a document of any size is spread over the tasks, and work follows the result. Roots
    without children have no blocks.
    """
    keys = keys or []
    anchors = intervals.join(roots.select(*keys, "node_id").distinct(), [*keys, "node_id"], "left_semi")
    itself = anchors.select(*keys, F.col("node_id").alias("root_id"), "node_id")
    blocks = cut(anchors.filter(F.col("leave") > F.col("enter")).select(
        *keys, F.col("node_id").alias("root_id"), F.inline(_blocks(F.col("enter") + 1, F.col("leave")))))
    levels = [r.level for r in blocks.select("level").distinct().collect()]  # 16 at most
    if not levels:
        return itself
    places = intervals.select(*keys, "node_id", F.inline(F.array(*[
        F.struct(F.lit(n).alias("level"), F.shiftright("enter", n * BLOCK_BITS).alias("block"))
        for n in sorted(levels)])))
    below = places.join(blocks, [*keys, "level", "block"]).select(*keys, "root_id", "node_id")
    return itself.unionByName(below)
