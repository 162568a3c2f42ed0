import random

import xxhash

from tracebound.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values):
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin(a ^ b).count("1") <= 2:
                label[find(a)] = find(b)
    return {v: find(v) for v in values}


def expected(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    root = plain_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    return sorted(((i, f"{f:016x}", least.get(root[f])) for i, f in prints), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.choice((1, 1, 4, 9))):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One TWO"), (904, "one two"), (905, "ÄÖ x"),
             (None, rows[0][1]), (7, rows[7][1]), (906, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(simhash.near_duplicates(df)) == expected(rows)


def test_dense_groups_are_split_without_losing_links(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 700:
        v = rng.choice(sorted(values)[-5:] if rng.random() < 0.3 else [base])
        for _ in range(rng.randrange(1, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(300)}
    df = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    want = plain_components(values)
    for group in (8192, 40):
        edges = simhash.similar(df, group)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        mine = {v: roots.get(simhash.signed(v), simhash.signed(v)) for v in values}
        pairs = {(want[v], mine[v]) for v in values}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(1, "a b c", "x", 2, 3)], "doc_id long, text string, fp string, mask int, root int")
    assert got(simhash.near_duplicates(df)) == expected([(1, "a b c")])
