import itertools
import random
import uuid

from tracebound.llm import filteraudit

DOCS = "doc_id bigint, text string, lang string, mask int, n bigint, id string"
LABELS = "doc_id bigint, quality int, toxic int, flags string"


def mask_of(text):
    words = text.split()
    return [len(words) < 100, 100 * len(set(words)) < 80 * len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), any(c in "#$%&*|" for c in text)]


def plain(docs, labels):
    inf = float("inf")
    least = {}
    for i, t, _ in docs:
        least[t or ""] = min(least.get(t or "", inf), inf if i is None else i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, part in docs:
        fails = mask_of(t or "") + [least[t or ""] < (inf if i is None else i)]
        rows.append((part or "", {f for f, bad in zip("ABCDE", fails) if bad}, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        share = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                gone = [r for r in own if f in r[0] and not r[0] & before]
                share[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    sum(not r[0] & (before | {f}) for r in own), len(gone),
                    sum(f in r[0] and bool(r[0] & before) for r in own), sum(r[0] == {f} for r in own),
                    sum(r[1] for r in gone), sum(r[2] for r in gone)]
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(share[f])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels, files, batches):
    path = f"/tmp/run-{uuid.uuid4().hex}"
    for k in range(files):
        part = docs[k::files]
        spark.createDataFrame([(i, t, p, 1, 2, "x") for i, t, p in part], DOCS).coalesce(1).write.mode(
            "append").parquet(path)
    found = filteraudit.filter_audit(
        spark, path, spark.createDataFrame([(*r, "y") for r in labels], LABELS), batches=batches)
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found.collect()}


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = [None, "", "ABC DEF", "a | b"]
    for _ in range(n):
        text = " ".join(rng.choices(words[:rng.choice((60, 400))], k=rng.choice((20, 110, 150))))
        out.append(rng.choice((text, text.upper(), text + " #", "ä" + text)))
    return out


def test_audit_equals_plain_counts_over_micro_batches(spark):
    rng = random.Random(2)
    pool = texts(15, 3)
    docs = [(rng.choice((None, *range(60))), rng.choice(pool), rng.choice((None, "", "en", "de"))) for _ in range(160)]
    docs += docs[:10]  # repeated rows
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 60, 2)] * 2 + [(None, 1, 1)]
    assert run(spark, docs, labels, 6, 6) == plain(docs, labels)


def test_smaller_ids_come_last(spark):
    """Every batch takes the first place from the batch before it."""
    docs = [(10 * (5 - k) + j, "same text", "en" if j else "de") for k in range(5) for j in range(3)]
    ordered = sorted(docs, key=lambda r: -r[0])
    dealt = [ordered[3 * (k % 5) + k // 5] for k in range(15)]  # file k holds the k-th largest ids
    found = run(spark, dealt, [(10, 1, 1)], 5, 5)
    assert found == plain(docs, [(10, 1, 1)])
    # E first: all but the row of the smallest id go
    assert found["en", "EABCD", 1][1] == 10 and found["de", "EABCD", 1][1] == 4


def test_hot_text_reaches_its_state_as_few_rows(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'one text' AS text", "'en' AS lang").repartition(4)
    rows = filteraudit.judged(docs, "doc_id", "lang").selectExpr("*", "0 AS flags")
    assert rows.mapInArrow(filteraudit.combined, filteraudit.ROWS).count() <= 16


def test_empty_table_and_second_run_goes_on(spark):
    assert run(spark, [], [], 1, 2) == {}
    path, folder = (f"/tmp/run-{uuid.uuid4().hex}" for _ in range(2))
    labels = spark.createDataFrame([], LABELS)
    frames = [spark.createDataFrame([(i, "t", "en", 1, 2, "x")], DOCS) for i in (5, 3)]
    for k, frame in enumerate(frames):
        frame.write.mode("append").parquet(path)
        counts = filteraudit.counters(spark, path, labels, folder)
    assert sorted((r["mask"], r.n) for r in counts.collect()) == [(1, 1), (17, 1)]
