import random
import re
import sys
from functools import lru_cache

from tracebound.llm import tokencount as C


def plain(vocabulary, word):
    @lru_cache(None)
    def best(end):
        if end == 0:
            return 0.0, 0
        n = len(word[end - 1].encode())
        s, k = best(end - 1)
        found = [(s + n * vocabulary.unknown, -(k - 0) - n)]
        found = [(s + n * vocabulary.unknown, k + n)]
        for start in range(end):
            p = vocabulary.scores.get(word[start:end])
            if p is not None:
                s, k = best(start)
                found.append((s + p, k + 1))
        return max(found, key=lambda x: (x[0], -x[1]))

    return best(len(word))[1]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "NODES", 200)
    rng = random.Random(2)
    vocabulary = C.Vocabulary.of([C.MARK, "a", "ab", "b", C.MARK + "a", "ba", "bab", "é", "éa", "c", "ca", "abc"])
    rows = [(i, " \t\n"[i % 3].join("".join(rng.choice("abcéñ") for _ in range(rng.randrange(1, 9)))
                                    for _ in range(rng.randrange(40)))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, " \n"), (None, rows[3][1]), (3, rows[3][1]), (903, "abca " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    want = []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        known = {w: plain(vocabulary, C.MARK + w) for w in set(words)}
        want.append((i, len(words), len(known), sum(known[w] for w in words)))
    got = [tuple(r) for r in C.token_counts(df, vocabulary).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert C.token_counts(df.limit(0), vocabulary).collect() == []


def test_shared_prefixes_are_scored_once():
    trie = C.Trie(C.Vocabulary.of(["a", "b", "ab"]))
    trie.tokens("abab")
    n = len(trie.best)
    trie.tokens("ababa")
    assert len(trie.best) == n + 1


def test_public_vocabulary():
    import public_tokenizers

    vocabulary = C.Vocabulary.sentencepiece(public_tokenizers.path("piece_bpe_32k.model"))
    assert len(vocabulary.scores) > 30_000
    trie = C.Trie(vocabulary)
    assert trie.tokens(C.MARK + "the") == 1 and trie.tokens(C.MARK + "\U0001F9FF") >= 4


def test_long_words_take_no_nodes(monkeypatch):
    rng = random.Random(6)
    vocabulary = C.Vocabulary.of(["a", "b", "ab", "abc", "c", "ca", "bb", "▁"])
    words = ["▁" + "".join(rng.choice("abcdé") for _ in range(n)) for n in (1, 40, 300, 900)]
    short = C.Trie(vocabulary)
    want = [short.tokens(w) for w in words]
    monkeypatch.setattr(C, "LONG", 10)
    long = C.Trie(vocabulary)
    assert [long.tokens(w) for w in words] == want
    assert len(long.best) < 5


def test_levels_of_many_words_match_brute_force(monkeypatch):
    rng = random.Random(9)
    pieces = {"".join(rng.choice("abcé🧿") for _ in range(rng.randrange(1, 7))) for _ in range(150)}
    vocabulary = C.Vocabulary.of([C.MARK, C.MARK + "ab", *sorted(pieces)])
    words = [C.MARK + "".join(rng.choice("abcdé🧿") for _ in range(rng.randrange(25))) for _ in range(1500)]
    want = [plain(vocabulary, w) for w in words]
    whole = C.Trie(vocabulary)
    assert whole.counts(words).tolist() == want
    assert len(whole.best) == len({w[:k] for w in words for k in range(len(w) + 1)})
    n = len(whole.best)
    assert whole.counts(words[::-1] + words[:7]).tolist() == want[::-1] + want[:7]
    assert len(whole.best) == n
    assert whole.counts([]).tolist() == [] and whole.counts(["", "\ud7ff"]).tolist() == [0, 3]
    monkeypatch.setattr(C, "NODES", 300)
    assert C.Trie(vocabulary).counts(words).tolist() == want
    assert C.Trie(C.Vocabulary.of([])).counts(["aé", "b"]).tolist() == [3, 1]


def test_nodes_are_scored_by_level_and_only_by_pieces_that_end_there():
    class Lookups(dict):
        n = 0

        def get(self, *args):
            Lookups.n += 1
            return super().get(*args)

    rng = random.Random(12)
    vocabulary = C.Vocabulary.of(["a", "b", "ab", "abcabcabcabcabcabc", "c", C.MARK])
    vocabulary.scores = Lookups(vocabulary.scores)
    trie, calls = C.Trie(vocabulary), 0
    trie.tokens(C.MARK)
    words = [C.MARK + "".join(rng.choice("abcd") for _ in range(30)) for _ in range(3000)]

    def called(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(called)
    try:
        trie.counts(words)
    finally:
        sys.setprofile(None)
    assert len(trie.best) > 50_000
    assert Lookups.n == 0 and calls < len(trie.best) / 2
