import contextlib
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import psutil
import pytest
import test_mixing
import test_quality
import test_simhash

import corpus_pipeline
from tracebound.llm import decontaminate, mixing, quality, simhash, tokens
from tracebound.llm.queries import tokenizer_file


def test_stages_on_the_small_tables(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], folder)
        if k < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [[tuple(r) for r in df.collect()] for df in seen]
    names = docs.columns
    key, text, source = names.index("doc_id"), names.index("text"), names.index("source")

    kept = set(rows[1])
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for r in rows[0]:
        failed = test_quality.plain(r[text])[-1]
        if failed:
            assert r not in kept
        elif quality.get(r[key]) == 1:
            assert r in kept

    component = {i: c for i, _, c in test_simhash.expected([(r[key], r[text]) for r in rows[1]])}
    assert sorted(rows[2]) == sorted(r for r in rows[1] if component[r[key]] == r[key])

    items = [plain_words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert sorted(rows[3]) == sorted(r for r in rows[2] if not contaminated(plain_words(r[text]), items))

    times = Counter(rows[4])
    assert set(times) <= set(rows[3]) and max(times.values()) <= 2
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows[3]:
        n = test_mixing.words(r[text])
        sizes[r[source]] += n
        taken[r[source]] += n * times[r]
        largest[r[source]] = max(largest[r[source]], n)
    for s, target in test_mixing.plain_targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= largest[s]

    from tokenizers import Tokenizer

    tokenizer, start, want = Tokenizer.from_file(tokenizer_file()), 0, []
    for r in sorted(rows[4], key=lambda r: r[key]):
        ids = [*tokenizer.encode(r[text] or "", add_special_tokens=False).ids, 2]
        want.append((r[key], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows[5], key=lambda r: r[1]) == want


def plain_words(text):
    return decontaminate.fold_split((text or "").encode())


def contaminated(words, items):
    hit = set()
    for item in items:
        n = min(13, len(item))
        windows = {tuple(item[k:k + n]) for k in range(len(item) - n + 1)} if n else set()
        hit |= {j for k in range(len(words) - n + 1) if tuple(words[k:k + n]) in windows for j in range(k, k + n)}
    return len(hit) > 0 and 20 * len(hit) >= len(words)


def test_one_of_each_with_repeated_rows_and_null_keys(spark):
    rows = [(1, "a b c d", 0), (1, "a b c d", 0), (2, "a b c d", 1), (None, "a b c d", 2), (None, "x y z", 3),
            (None, "x y z", 3), (5, "q r s t u", 4), (5, "other words are here", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root int")
    assert sorted(simhash.one_of_each(df).collect(), key=str) == sorted(
        [(1, "a b c d", 0), (None, "x y z", 3), (5, "q r s t u", 4), (5, "other words are here", 5)], key=str)


def test_decontamination_against_brute_force(spark):
    items = [(1, "One two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
             (2, "short one"), (3, None), (4, "-- !"), (10, "Alpha"), (10, "beta gamma")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, items[0][1].upper()), (2, "x " * 300 + items[0][1]), (3, "a SHORT-one b"), (4, None), (5, ""),
            (6, "alpha beta gamma"), (7, "shorter ones"), (8, "one two three four five six seven eight nine ten eleven twelve"),
            (None, "Alpha"), (6, "alpha beta gamma"), (9, "two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, words string")
    plain = [plain_words(t) for _, t in items]
    for block in (1_000_000, 10):
        got = decontaminate.contamination(df, bench, block_words=block)
        assert sorted((str(r.doc_id), r.contaminated) for r in got.collect()) == sorted(
            (str(i), contaminated(plain_words(t), plain)) for i, t in docs)
        clean = decontaminate.clean_documents(df, bench, block_words=block)
        assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(
            str(i) for i, t in docs if not contaminated(plain_words(t), plain))
    none = decontaminate.contamination(df, bench.limit(0))
    assert not any(r.contaminated for r in none.collect())
    assert decontaminate.contamination(df.limit(0), bench).collect() == []
    assert mixing.WEIGHTS == (3, 1, 2)


def worker_memory(spark):
    """MB of every Python worker of the session, by process."""
    found = {}
    for p in psutil.Process(spark.sparkContext._gateway.proc.pid).children(recursive=True):
        with contextlib.suppress(OSError):
            rollup = Path(f"/proc/{p.pid}/smaps_rollup").read_text()
            found[p.pid] = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", rollup))) / 1024
    return found


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux tells the memory of processes")
def test_workers_keep_no_free_memory_between_stages(spark):
    def docs(rows):
        word = "conv(string(pmod(xxhash64(id, i), 20000)), 10, 36)"
        return spark.range(0, rows, 1, 1).selectExpr(
            "id AS doc_id", f"concat_ws(' ', transform(sequence(1, 500), i -> {word})) AS text")

    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")

    def stages(df):
        for out in (quality.rule_statistics(df), simhash.fingerprints(df), decontaminate.contamination(df, bench),
                    tokens.round_trip(df, tokenizer_file())):
            out.write.format("noop").mode("overwrite").save()

    stages(docs(50))
    before = worker_memory(spark)
    stages(docs(16_000))
    # a worker without libraries has 40 MB, words and vocabulary of the tokenizer take 40
    grown = {pid: mb - before.get(pid, 40) for pid, mb in worker_memory(spark).items()}
    assert max(grown.values()) < 75, grown
