"""Mixing sources to target weights by pivotal dependent rounding (operator 3).

Every document of a source should be copied ``target / source_size`` times. The whole part is
given; the fraction is a copy probability. Two documents meet, and words move from one
probability to the other, in a random direction that keeps both expectations, until one
probability is 0 or 1. The other carries the rest on to the next document. The word total of a
pair never changes, so a source misses its target by less than one document.

The rounding is a reduction tree: blocks of about ``BLOCK`` documents are folded inside one row,
each leaves at most one open document, and open documents meet in blocks again until one is left
per source. Decisions then go down the same tree. A source with a third of all rows has as many
blocks as it needs. Everything is DataFrame expressions; random numbers are hashes of the
rows, so reruns and repeated tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracebound.plans.lineage import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
#: Rows that are folded together; at most 62, the bits of a decision mask.
BLOCK = 32
SEED = 20_011


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)``, with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT
                   ) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: water-filling up to ``limit`` times the size.

    Sources are numbered by code point, null last, over range partitions, so their number is
    not bounded by one task. Each round needs two sums on the driver.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(
        sizes.repartitionByRange(*order)
        .withColumn("__part", F.spark_partition_id()))
    before = (
        ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("__before", F.coalesce(F.sum("n").over(
            Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("n")
    )
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1 + F.col("__before")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (rank % len(weights) + 1).cast("int"))
    ranked = cut(
        ranged.join(before, "__part").withColumn("w", weight)
        .select("source", "source_size", "w"))
    most = F.col("source_size") * float(limit)
    total, left = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    total, left = float(total or 0) * share, float(left or 1)
    free, count = total, -1
    while True:
        full = most * left < F.col("w") * free
        n, given, weighed = ranked.filter(full).agg(
            F.count(F.lit(1)), F.sum(most), F.sum("w")).first()
        if n == count:
            break
        whole = ranked.agg(F.sum("w")).first()[0] or 1.0
        count, free, left = n, total - (given or 0.0), whole - (weighed or 0.0)
    target = F.when(most * left < F.col("w") * free, most).otherwise(F.col("w") * free / left)
    return ranked.select("source", "source_size", target.alias("target"))


def pivot(rows: str, *salt: Column) -> Column:
    """Fold an array of (size, p, ...) of at most 62 elements.

    The result has the index, size and probability of the open element and a mask of the
    elements that were rounded up.
    """
    zero = F.struct(F.lit(-1).alias("at"), F.lit(1.0).alias("size"), F.lit(0.0).alias("p"),
                    F.lit(0).cast("long").alias("mask"), F.lit(0).alias("n"))

    def bit(is_one: Column, at: Column) -> Column:
        # an index is given only where is_one can hold, so the shift is in range
        return F.when(is_one, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(
            F.lit(0).cast("long"))

    def step(acc: Column, x: Column) -> Column:
        uniform = F.pmod(F.xxhash64(F.lit(SEED), *salt, acc["n"]), F.lit(1 << 53)) / float(1 << 53)
        room = F.struct(
            F.least(acc["size"] * (1 - acc["p"]), x["size"] * x["p"]).alias("up"),
            F.least(acc["size"] * acc["p"], x["size"] * (1 - x["p"])).alias("down"))

        def moved(r: Column) -> Column:
            up = uniform * (r["up"] + r["down"]) < r["down"]
            mine = F.when(
                up, F.when(r["up"] == acc["size"] * (1 - acc["p"]), 1.0)
                .otherwise(acc["p"] + r["up"] / acc["size"])
            ).otherwise(
                F.when(r["down"] == acc["size"] * acc["p"], 0.0)
                .otherwise(acc["p"] - r["down"] / acc["size"]))
            other = F.when(
                up, F.when(r["up"] == x["size"] * x["p"], 0.0)
                .otherwise(x["p"] - r["up"] / x["size"])
            ).otherwise(
                F.when(r["down"] == x["size"] * (1 - x["p"]), 1.0)
                .otherwise(x["p"] + r["down"] / x["size"]))
            settled = (acc["p"] <= 0) | (acc["p"] >= 1)
            return F.struct(F.when(settled, acc["p"]).otherwise(mine).alias("mine"),
                            F.when(settled, x["p"]).otherwise(other).alias("other"))

        def after(v: Column) -> Column:
            done = (v["mine"] <= 0) | (v["mine"] >= 1)
            return F.struct(
                F.when(done, acc["n"]).otherwise(acc["at"]).alias("at"),
                F.when(done, x["size"]).otherwise(acc["size"]).alias("size"),
                F.when(done, v["other"]).otherwise(v["mine"]).alias("p"),
                acc["mask"].bitwiseOR(F.when(
                    done, bit((v["mine"] >= 1) & (acc["at"] >= 0), acc["at"]))
                    .otherwise(bit(v["other"] >= 1, acc["n"]))).alias("mask"),
                (acc["n"] + 1).alias("n"))

        return let(let(room, moved), after)

    return F.aggregate(rows, zero, step)


def folded(rows: DataFrame, carry: list[str], block: int) -> DataFrame:
    """One level of the tree: ``rows(source, n, h, size, p, carry)`` in folded slices.

    ``n`` is the number of rows of the source on this level and ``h`` a hash of the row. A block
    is a hash bucket; one that came out larger is cut into slices.
    """
    bucket = F.pmod(F.xxhash64(F.lit(SEED), "h"), F.ceil(F.col("n") / block))
    entry = F.struct("size", "h", "p", *carry)
    return (
        rows.groupBy("source", bucket.alias("b")).agg(F.sort_array(F.collect_list(entry)).alias("all"))
        .withColumn("k", F.explode(F.sequence(
            F.lit(0), F.floor((F.size("all") - 1) / block).cast("int"))))
        .withColumn("rows", F.slice("all", F.col("k") * block + 1, F.lit(block)))
        .withColumn("open", pivot("rows", F.col("source"), F.col("b"), F.col("k")))
        .select("source", F.xxhash64("b", "k", F.size("rows")).alias("node"), "b", "k", "rows", "open")
    )


def rounded(units: DataFrame, carry: list[str], block: int = BLOCK) -> DataFrame:
    """``units(source, size, p, carry)`` with ``x``, 0 or 1: the dependent rounding of ``p``."""
    def counted(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        on = rows["source"].eqNullSafe(counts["source"])
        return rows.join(F.broadcast(counts) if small(counts) else counts, on).drop(counts["source"])

    rows = units.withColumn("h", F.xxhash64(*carry, "size"))
    levels, columns = [], carry
    while True:
        level = cut(folded(counted(rows), columns, block))
        levels.append(level)
        rows = level.select("source", F.col("open.size").alias("size"), F.col("open.p").alias("p"),
                            "b", "k", F.xxhash64("b", "k").alias("h"))
        columns = ["b", "k"]
        if (rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
                or 0) <= 1:
            break
    chance = F.pmod(F.xxhash64(F.lit(SEED + 1), "source"), F.lit(1 << 53)) / float(1 << 53)
    known = rows.select("source", "b", "k", F.when(chance < F.col("p"), 1).otherwise(0).alias("x"))
    for level in reversed(levels):
        up = known.select(F.col("source").alias("__s"), F.col("b").alias("__b"),
                          F.col("k").alias("__k"), F.col("x").alias("__x"))
        on = (level["source"].eqNullSafe(up["__s"])
              & (level["b"] == up["__b"]) & (level["k"] == up["__k"]))
        mask = F.expr("int(shiftright(open.mask, i) & 1)")
        known = (
            level.join(up, on)
            .select("source", "open", "__x", F.posexplode("rows").alias("i", "row"))
            .select("source", "row.*",
                    F.when(F.col("i") == F.col("open.at"), F.col("__x")).otherwise(mask).alias("x"))
        )
    return known.select("source", "size", "p", *carry, "x")


def small(counts: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of one row per source may be broadcast."""
    return counts.limit(most + 1).count() <= most


def copies(rows: DataFrame, ids: list[str], block: int = BLOCK) -> DataFrame:
    """Copies of equal rows: ``rows(ids, source, size)`` to one row per distinct (ids, source, size).

    Adds ``m`` (how many rows are equal), ``base`` (copies that each of them has), ``extra`` (how many
    of them have one more), ``source_size`` and ``target``.
    """
    units = cut(rows.groupBy(*ids, "source", "size").agg(F.count(F.lit(1)).alias("m")))
    sizes = units.groupBy("source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = source_targets(sizes)
    # a join by value: null is a source like any other
    named = targets.withColumnRenamed("source", "__source")
    on = units["source"].eqNullSafe(named["__source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    share = F.col("m") * (F.col("ratio") - F.col("base"))
    split = (
        units.join(F.broadcast(named) if small(named) else named, on).drop("__source")
        .withColumn("ratio", ratio).withColumn("base", F.floor("ratio"))
        .withColumn("whole", F.floor(share)).withColumn("p", share - F.col("whole"))
    )
    columns = [*ids, "m", "base", "whole", "source_size", "target"]
    open_rows = split.filter("p > 0 AND size > 0")
    settled = split.filter("p <= 0 OR size = 0").withColumn("x", F.lit(0))
    done = rounded(
        open_rows.select("source", F.col("size").cast("double").alias("size"), "p", *columns),
        columns, block).withColumn("size", F.col("size").cast("long"))
    keep = [*ids, "source", "size", "m", "base", "source_size", "target", "whole", "x"]
    return (
        done.select(*keep).unionByName(settled.select(*keep))
        .withColumn("extra", F.col("whole") + F.col("x")).drop("whole", "x")
    )


def mix(documents: DataFrame, key: str = "doc_id", source: str = "source", block: int = BLOCK
        ) -> DataFrame:
    """One row per row of ``documents(key, source, text)``: how many words the mix takes of it.

    Returns the key, ``size``, ``source_size``, ``target`` (of its source), ``taken`` and ``copies``.
    Null and empty texts have size 0 and are taken 0 times over; a null source is a source of its
    own, the last; equal rows are rounded together and told apart only by their number of copies;
    an empty table gives an empty result. Other columns are not read.
    """
    rows = documents.select(F.col(key).alias("__key"), F.col(source).alias("source"),
                            word_count().alias("size"))
    numbered = (
        copies(rows, ["__key"], block)
        # two steps: a sequence stays short however often a row is repeated
        .withColumn("__hi", F.explode(F.expr("sequence(0L, (m - 1) div 10000L)")))
        .withColumn("__lo", F.explode(F.expr(
            "sequence(__hi * 10000L, least(m, (__hi + 1L) * 10000L) - 1L)")))
        .withColumn("copies", F.col("base") + F.when(F.col("__lo") < F.col("extra"), 1).otherwise(0))
    )
    return numbered.select(
        F.col("__key").alias(key), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).cast("long").alias("taken"),
        F.col("copies").cast("long").alias("copies"))


def mixed_documents(documents: DataFrame, source: str = "source", block: int = BLOCK) -> DataFrame:
    """The mix itself: rows of ``documents``, each as often as it is taken, columns unchanged.

    Equal rows are found by a 128-bit digest of the whole row, and one of them stands for all.
    """
    columns = documents.columns
    whole = [F.col(f"`{c}`") for c in columns]
    marked = documents.select(F.struct(*whole).alias("__row"), F.col(source).alias("source"),
                              word_count().alias("size"),
                              F.xxhash64(*whole, *[c.isNull() for c in whole]).alias("__d1"),
                              F.xxhash64(F.lit(SEED), *reversed(whole)).alias("__d2"))
    plan = copies(marked.select("__d1", "__d2", "source", "size"), ["__d1", "__d2"], block)
    times = plan.select("__d1", "__d2", (F.col("m") * F.col("base") + F.col("extra")).alias("__n"))
    rows = marked.select("__row", "__d1", "__d2").dropDuplicates(["__d1", "__d2"])
    return (
        rows.join(times.filter("__n > 0"), ["__d1", "__d2"])
        .withColumn("__hi", F.explode(F.expr("sequence(0L, (__n - 1) div 10000L)")))
        .withColumn("__lo", F.explode(F.expr(
            "sequence(__hi * 10000L, least(__n, (__hi + 1L) * 10000L) - 1L)")))
        .select("__row.*")
    )
