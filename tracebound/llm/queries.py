"""The registered queries of the numbered operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracebound.llm.decontaminate import contamination
from tracebound.llm.filteraudit import filter_audit
from tracebound.llm.logbilinear import language_scores
from tracebound.llm.mixing import mix
from tracebound.llm.pii import personal_data
from tracebound.llm.quality import quality
from tracebound.llm.simhash import near_duplicates
from tracebound.llm.styletree import extract
from tracebound.llm.substrings import without_repeats
from tracebound.llm.tokencount import Vocabulary, token_counts
from tracebound.llm.tokens import round_trip
from tracebound.llm.toxicity import toxicity
from tracebound.llm.vafile import centroid_clusters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT j) AS n_hit
       FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
              string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
       FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""


@query("op5_benchmark_decontamination", OP5)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("spans")


@query("op6_simhash_near_duplicates")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op3_source_mixing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op4_token_files")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "documents"), tokenizer_file())


@query("op1_quality_rules")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP2 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
t AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
x AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS j FROM s JOIN t USING (g)),
g AS (SELECT r, list(j) AS gone FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE
    list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j])
    END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


@query("op2_substring_dedup", OP2)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents"), texts=False)


@query("op10_toxicity_classifier")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary.sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(table(spark, folder, "documents"), vocabulary)


@query("op9_personal_data")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


@query("op8_main_text")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return extract(table(spark, folder, "pages"))


def op13_sql(rounds: int = 3) -> str:
    nearest = """
n{t} AS (
  SELECT v.r, v.v, c.c, list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
  FROM k v, c{t} c),
a{t} AS (SELECT r, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM n{t} GROUP BY r)"""
    moved = """
m{t} AS (
  SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n
  FROM (SELECT c, v, unnest(range(1, 65)) AS j FROM a{t}) GROUP BY c, j),
c{n} AS (
  SELECT c.c, coalesce(x.v, c.v) AS v FROM c{t} c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM m{t} GROUP BY c) x USING (c))"""
    parts = ["""
k AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (
  SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, v FROM k ORDER BY h LIMIT 16))"""]
    for t in range(rounds):
        parts += [nearest.format(t=t), moved.format(t=t, n=t + 1)]
    parts.append(nearest.format(t=rounds))
    return f"""
WITH {",".join(parts)}
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN k USING (r) JOIN c{rounds} c ON a.c = c.c
"""


@query("op13_centroid_clusters", op13_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings"))


OP12 = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
             max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END AS a,
    CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 1 ELSE 0 END AS b,
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 1 ELSE 0 END AS c,
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
    CASE WHEN least_id < coalesce(w.doc_id, 9223372036854775807) THEN 1 ELSE 0 END AS e
  FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS least_id FROM w) w LEFT JOIN l ON w.doc_id = l.doc_id),
n AS (SELECT part, good, toxic, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(x, bit)),
o AS (
  SELECT concat(p.x, q.x, r.x, s.x, t.x) AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
  FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
    AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::BIGINT AS earlier
      FROM (SELECT filter_order, bits, unnest(range(1, 6)) AS step FROM o)),
r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM n, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
  CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


@query("op12_filter_interaction_audit", OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(spark, f"{folder}/documents.parquet", table(spark, folder, "labels"))


@query("op11_language_scores")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return language_scores(table(spark, folder, "documents"))
