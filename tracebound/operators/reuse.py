"""J-10..J-12, A-12, A-13, A-15: verbatim reuse, near-duplicates, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tracebound.functions import fixed
from tracebound.functions.lets import computed, matches
from tracebound.functions.text import js_trim, normalize_rationale, normalize_ws
from tracebound.operators.issues import issue_rows
from tracebound.plans.lineage import cut
from tracebound.plans.hot import fits, salted_join

# Passages whose grams are broadcast: at most this many, and at most this much text.
BROADCAST_PASSAGES = 20_000
BROADCAST_CHARS = 8_000_000


def _blocks(text: Column, size: int) -> Column:
    """Hashes of the consecutive, aligned blocks of ``size`` characters."""
    return F.array_distinct(
        F.transform(
            matches(text, "(?s).{%d}" % size), lambda b: F.xxhash64(F.lit(size), b)
        )
    )


def _gram(text: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), F.substr(text, start, F.lit(size)))


def _grams(text: Column, start: Column, size: int) -> Column:
    """Hashes of the ``size`` grams of ``size`` characters that begin at ``start`` or after."""
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(0), F.lit(size - 1)), lambda i: _gram(text, start + i, size)
        )
    )


def _by_size(sizes: list[int], build) -> Column:
    """``build(size)`` for the largest block size that a passage is long enough for."""
    result = None
    for size in reversed(sizes):
        test = F.length("passage") >= 2 * size - 1
        result = F.when(test, build(size)) if result is None else result.when(test, build(size))
    return result


WINDOWS = 4


def _rarest_window(passages: DataFrame, sizes: list[int]) -> DataFrame:
    """``start`` of the window of each passage that the fewest passages share.

    Any window of ``2 * size - 1`` characters will do for the search. Passages with a common
    opening would all meet in its grams, so four windows spread over the passage are
    compared by how many passages have their first gram there, and the rarest is used.
    """
    def windows(size):
        room = F.length("passage") - (2 * size - 1)
        starts = F.array_distinct(
            F.array(*[(F.floor(room * i / (WINDOWS - 1)) + 1).cast("int") for i in range(WINDOWS)])
        )
        return F.transform(
            starts,
            lambda s: F.struct(s.alias("start"), _gram(F.col("passage"), s, size).alias("mark")),
        )

    marked = passages.select("passage_id", F.explode(_by_size(sizes, windows)).alias("w")).select(
        "passage_id", "w.start", "w.mark"
    )
    shared = marked.groupBy("mark").agg(F.count(F.lit(1)).alias("n"))
    best = marked.join(shared, "mark").groupBy("passage_id").agg(
        F.min(F.struct("n", "start")).alias("best")
    )
    return passages.join(best.select("passage_id", F.col("best.start").alias("start")), "passage_id")


def find_passages(docs: DataFrame, passages: DataFrame, min_chars: int, levels: int = 1,
                  strategy: str = "auto") -> DataFrame:
    """Which passages occur verbatim in which documents.

    ``docs(doc_id, text)``, ``passages(passage_id, passage)`` with every passage at least
    ``min_chars`` long. Returns distinct ``doc_id, passage_id`` with their lengths
    ``doc_chars`` and ``passage_chars``.

    A document contributes one hash per aligned block of ``size`` characters. Any
    occurrence of ``2 * size - 1`` characters covers one whole aligned block, so wherever a
    window of that length is taken from a passage, one of its ``size`` grams is a block of
    every document that holds the passage. The hash join misses nothing; ``contains`` then removes hash collisions and partial
    matches. Longer passages use the larger, rarer blocks when ``levels`` > 1.
    """
    sizes = [((min_chars + 1) // 2) * (2 ** level) for level in range(levels)]
    block_array = F.concat(*[_blocks(F.col("text"), size) for size in sizes])
    blocks = docs.withColumn("gram", F.explode(block_array))

    lengths = (F.length("text").cast("bigint").alias("doc_chars"),
               F.length("passage").cast("bigint").alias("passage_chars"))
    if strategy == "auto":
        small = fits(passages, BROADCAST_PASSAGES, F.length("passage"), BROADCAST_CHARS)
        strategy = "broadcast" if small else "shuffle"

    placed = (
        passages.withColumn("start", F.lit(1)) if strategy == "broadcast"
        else _rarest_window(passages, sizes)
    )
    grams = placed.withColumn(
        "gram",
        F.explode(_by_size(sizes, lambda s: _grams(F.col("passage"), F.col("start"), s))),
    ).drop("start")
    if strategy == "broadcast":
        # Proven small above: documents are scanned once and never shuffled.
        # Grams travel with their number, texts once each.
        return (
            blocks.join(F.broadcast(grams.select("gram", "passage_id")), "gram")
            .join(F.broadcast(passages.select("passage_id", "passage")), "passage_id")
            .filter(F.contains("text", "passage"))
            .select("doc_id", "passage_id", *lengths).distinct()
        )
    # Only (gram, id) pairs are shuffled; texts follow for the candidates alone.
    candidates = (
        blocks.select("gram", "doc_id")
        .join(grams.select("gram", "passage_id"), "gram")
        .select("doc_id", "passage_id").distinct()
    )
    return (
        candidates.join(docs.select("doc_id", "text"), "doc_id")
        .join(passages.select("passage_id", "passage"), "passage_id")
        .filter(F.contains("text", "passage"))
        .select("doc_id", "passage_id", *lengths)
    )


def distinct_passages(facts: DataFrame, min_chars: int, text: Column) -> DataFrame:
    """Distinct normalized passages of at least ``min_chars``, named by their digest."""
    return (
        facts.select(text.alias("passage"))
        .filter(F.length("passage") >= min_chars)
        .withColumn("passage_id", F.sha2("passage", 256))
        .distinct()
    )


def verbatim_exposure(pages: DataFrame, facts: DataFrame,
                      min_chars: int = fixed.PASSAGE_MIN_CHARS,
                      strategy: str = "auto") -> DataFrame:
    """J-10: share of each page that repeats source passages, whitespace ignored.

    ``pages(doc_id, text)``, ``facts(raw_text)``. Returns the pages with any match:
    ``doc_id, passages, matched_chars, page_chars, share, severity``.
    """
    docs = computed(
        pages.select("doc_id", F.col("text").alias("__raw")), text=normalize_ws(F.col("__raw"))
    ).select("doc_id", "text")
    passages = distinct_passages(facts, min_chars, normalize_ws(F.col("raw_text")))
    hits = find_passages(docs, passages, min_chars, strategy=strategy)
    return (
        hits.groupBy("doc_id")
        .agg(
            F.count(F.lit(1)).alias("passages"), F.sum("passage_chars").alias("matched_chars"),
            F.max("doc_chars").alias("page_chars"),
        )
        .withColumn("share", F.col("matched_chars") / F.col("page_chars"))
        .withColumn(
            "severity",
            F.when(F.col("share") > fixed.EXPOSURE_ERROR_SHARE, "error")
            .when(F.col("share") > fixed.EXPOSURE_WARNING_SHARE, "warning"),
        )
    )


def protected_fragment_leaks(docs: DataFrame, fragments: DataFrame,
                             min_chars: int = fixed.FRAGMENT_MIN_CHARS,
                             strategy: str = "auto") -> DataFrame:
    """J-11: trimmed fragments of at least ``min_chars`` found verbatim in a document.

    ``docs(doc_id, text)``, ``fragments(fragment)``. Returns ``doc_id, fragment_id``.
    """
    passages = distinct_passages(fragments, min_chars, js_trim(F.col("fragment")))
    return find_passages(
        docs.select("doc_id", "text"), passages, min_chars, levels=3, strategy=strategy
    ).select("doc_id", F.col("passage_id").alias("fragment_id"))


# --- structure ---------------------------------------------------------------


def trigrams(seq: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """W-12: distinct ``a>b>c`` over each ordered sequence: ``key, shingle``."""
    w = Window.partitionBy(key).orderBy(order)
    second, third = F.lead(value, 1).over(w), F.lead(value, 2).over(w)
    return (
        seq.select(key, F.concat(F.col(value), F.lit(">"), second, F.lit(">"), third)
                   .alias("shingle"))
        .filter(F.col("shingle").isNotNull())
        .distinct()
    )


def shingle_sets(shingles: DataFrame, key: str) -> DataFrame:
    """The shingle set of every item, as sorted hashes: ``key, hashes``."""
    return (
        shingles.select(key, F.xxhash64("shingle").alias("h"))
        .groupBy(key).agg(F.array_sort(F.collect_set("h")).alias("hashes"))
    )


def set_id() -> Column:
    return F.sha2(F.array_join(F.transform("hashes", lambda h: h.cast("string")), ","), 256)


def structure_sets(shingles: DataFrame, key: str) -> DataFrame:
    """Items with the same shingle set become one row: ``set_id, members, first_item, hashes``.

    A corpus made from one template collapses here, before anything is compared.
    """
    return (
        shingle_sets(shingles, key).withColumn("set_id", set_id())
        .groupBy("set_id", "hashes")
        .agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first_item"))
    )


def set_members(shingles: DataFrame, key: str, items: DataFrame | None = None) -> DataFrame:
    """J-12: every item with its set: ``key, set_id, first_item, members``.

    ``items(key)`` adds the items that have no shingle; they share the empty set. A set that
    holds much of the corpus is spread over salts.
    """
    rows = shingle_sets(shingles, key)
    if items is not None:
        rows = items.select(key).distinct().join(rows, key, "left").withColumn(
            "hashes", F.coalesce("hashes", F.array().cast("array<bigint>")))
    rows = cut(rows.select(key, set_id().alias("set_id")))
    sets = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("members"), F.min(key).alias("first_item"))
    counts = sets.select("set_id", F.col("members").alias("n"))
    return salted_join(rows, sets, ["set_id"], [key], counts=counts).select(
        key, "set_id", "first_item", "members")


def near_duplicates(sets: DataFrame,
                    threshold: float = fixed.NEAR_DUPLICATE_THRESHOLD) -> DataFrame:
    """J-12: pairs of distinct sets with Jaccard similarity above ``threshold``. Exact.

    Prefix filter: each set is ordered by token frequency, rarest first; a similar pair
    shares a token in the first ``n - ceil(t n) + 1``. Size filter: sizes within a factor
    of ``t``; sizes are bucketed by that factor, so the join key also carries the bucket
    and a frequent token is split by size.
    """
    # Used five times below; far smaller than the pages it was computed from.
    sized = cut(sets).withColumn("n", F.size("hashes"))
    tokens = sized.select("set_id", "n", F.explode("hashes").alias("h"))
    frequency = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # A set is bounded by the page it came from, so it is ordered inside one row.
    prefix = (
        tokens.join(frequency, "h")
        .groupBy("set_id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("ordered"))
        .select(
            "set_id", "n",
            F.explode(
                F.slice(
                    "ordered", F.lit(1),
                    (F.col("n") - F.ceil(F.col("n") * F.lit(threshold)) + 1).cast("int"),
                )
            ).alias("token"),
        )
        .select("set_id", "n", F.col("token.h").alias("h"))
        .withColumn(
            "size_class", F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)))
        )
    )
    left = prefix.select(
        F.col("set_id").alias("set_a"), F.col("n").alias("na"), "h", "size_class"
    )
    # The larger set of a pair lies in the same size class, or in one of the next two
    # (two, because the class edges are computed in floating point).
    right = prefix.select(
        F.col("set_id").alias("set_b"), F.col("n").alias("nb"), "h",
        F.explode(
            F.array(F.col("size_class"), F.col("size_class") - 1, F.col("size_class") - 2)
        ).alias("size_class"),
    )
    candidates = (
        left.join(right, ["h", "size_class"])
        .filter(
            (F.col("nb") > F.col("na"))
            | ((F.col("nb") == F.col("na")) & (F.col("set_a") < F.col("set_b")))
        )
        .filter(F.col("na") > F.col("nb") * F.lit(threshold))
        .select("set_a", "set_b").distinct()
    )
    a = sized.select(F.col("set_id").alias("set_a"), F.col("hashes").alias("ha"),
                     F.col("first_item").alias("item_a"), F.col("members").alias("members_a"))
    b = sized.select(F.col("set_id").alias("set_b"), F.col("hashes").alias("hb"),
                     F.col("first_item").alias("item_b"), F.col("members").alias("members_b"))
    shared = F.size(F.array_intersect("ha", "hb"))
    first, second = F.least("item_a", "item_b"), F.greatest("item_a", "item_b")
    swap = F.col("item_a") > F.col("item_b")
    return (
        candidates.join(a, "set_a").join(b, "set_b")
        .withColumn("shared", shared.cast("bigint"))
        .withColumn(
            "similarity", F.col("shared") / (F.size("ha") + F.size("hb") - F.col("shared"))
        )
        .filter(F.col("similarity") > threshold)
        .select(
            first.alias("item_a"), second.alias("item_b"),
            F.when(swap, F.col("members_b")).otherwise(F.col("members_a")).alias("members_a"),
            F.when(swap, F.col("members_a")).otherwise(F.col("members_b")).alias("members_b"),
            "shared", "similarity",
        )
    )


# --- repeats -------------------------------------------------------------------


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """A-12: keys used more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def repeated_text(df: DataFrame, text: str, min_count: int = fixed.REPEATED_TEXT_MIN,
                  normalize=normalize_rationale) -> DataFrame:
    """A-13: normalized texts found in at least ``min_count`` rows: ``text_sha, text, n``.

    Digests are counted first, in a hash aggregation of fixed-size keys; only the texts that
    repeat are shuffled, once each per map task.
    """
    rows = (
        computed(df.select(text), __text=normalize(F.col(text)))
        .filter(F.col("__text") != "")
        .select(F.sha2("__text", 256).alias("text_sha"), F.col("__text").alias("text"))
    )
    repeated = (
        rows.groupBy("text_sha").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count).select("text_sha")
    )
    return (
        rows.join(repeated, "text_sha", "left_semi")
        .groupBy("text_sha", "text").agg(F.count(F.lit(1)).alias("n"))
    )


def repeated_text_members(df: DataFrame, ids: list[str], text: str,
                          min_count: int = fixed.REPEATED_TEXT_MIN,
                          normalize=normalize_rationale) -> DataFrame:
    """A-13: the rows behind each repeated text, one row per member.

    Members stay rows: a text that fills a third of the corpus is never collected.
    """
    rows = (
        computed(df.select(*ids, text), __text=normalize(F.col(text)))
        .filter(F.col("__text") != "")
        .select(*ids, F.sha2("__text", 256).alias("text_sha"))
    )
    repeated = (
        rows.groupBy("text_sha").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_count)
    )
    return salted_join(rows, repeated, ["text_sha"], ids, counts=repeated)


def must_differ(df: DataFrame, group: list[str], column: str, code: str) -> DataFrame:
    """A-15: groups whose members share a value of ``column``."""
    shared = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    per_group = shared.groupBy(*group).agg(F.count(F.lit(1)).alias("shared_values"))
    subject = F.concat_ws("/", *[F.col(g).cast("string") for g in group])
    return issue_rows(per_group, code, subject, F.col("shared_values"))
