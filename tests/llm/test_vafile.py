import hashlib
import math

import numpy as np

from tracebound.llm import vafile

SCHEMA = "vec_id bigint, embedding array<float>, label int, cluster string, block int"


def plain(rows, clusters, rounds, size, scale=64, seed=1):
    kept = [(i, [min(max(math.floor(scale * x), -vafile.LARGEST), vafile.LARGEST) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (name(r[0]), np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[0], []).append(v)
        for c, vectors in groups.items():
            centroids[c] = [sum(x) // len(vectors) for x in zip(*vectors)]
    found = [(i, *nearest(v)) for i, v in kept]
    out = []
    for i, c, d in found:
        digest = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        out.append((i, c, d, sum(x[2] for x in found if x[1] == c), sum(x[2] for x in found), digest))
    return sorted(out, key=str)


def run(spark, rows, clusters, rounds, size, **more):
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    found = vafile.centroid_clusters(table, clusters=clusters, rounds=rounds, size=size, **more)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, found.collect()), key=str)


def test_clusters_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(i % 3, 0.4, 6)]) for i in range(300)]
    for bits in (1, 3, 6):
        assert run(spark, rows, 5, 4, 6, bits=bits) == plain(rows, 5, 4, 6)


def test_dropped_vectors_ties_repeats_and_huge_values(spark):
    rows = [
        (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (None, [0.0, 1.0]),
        (6, [float("nan"), 0.0]), (7, [float("inf"), 0.0]), (8, [0.0, 0.0]), (9, []), (10, [3e38, -3e38]), (11, [2.0, 2.0]),
    ]
    for clusters in (1, 2, 20):
        got = run(spark, rows, clusters, 3, 2)
        assert len(got) == 7
        if clusters < 20:
            assert got == plain(rows, clusters, 3, 2)


def test_a_third_of_the_rows_is_one_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [0.25] * 4 if i % 3 == 0 else [float(x) for x in rng.normal(0, 1, 4)]) for i in range(240)]
    assert run(spark, rows, 4, 2, 4) == plain(rows, 4, 2, 4)


def test_empty_table(spark):
    assert run(spark, [], 3, 2, 4) == []
    assert run(spark, [(1, None)], 3, 2, 4) == []


def test_cells_decide_only_what_is_certain():
    rng = np.random.default_rng(7)
    vectors = np.floor(rng.normal(0, 20, (2000, 8))).astype(np.int64)
    table = vafile.Cells.of(vectors.mean(axis=0), vectors.std(axis=0), vectors.min(axis=0), vectors.max(axis=0))
    centroids = vectors[:5] * 3
    exact = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    low, high = table.intervals(table.encode(vectors), centroids)
    mean = centroids.mean(axis=0)
    shared = ((vectors - mean) ** 2).sum(axis=1)[:, None]
    assert (low <= exact - shared).all() and (exact - shared <= high).all()
    number, left = vafile.nearest(table.encode(vectors), table, centroids)
    sure = number >= 0
    assert 0.3 < sure.mean() < 1
    assert (number[sure] == exact.argmin(axis=1)[sure]).all()
    fetched = []

    def fetch(rows):
        fetched.extend(rows.tolist())
        return vectors[rows]

    assert (vafile.assigned(table.encode(vectors), fetch, table, centroids) == exact.argmin(axis=1)).all()
    assert fetched == np.flatnonzero(~sure).tolist()
