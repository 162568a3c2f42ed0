import hashlib
import random
import re

from tracebound.llm import pii


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def texts():
    rng = random.Random(3)
    bits = ["a.b@c.de", "x@y", "@", "é@mail.example.com", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4",
            "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (456) 555-2186", "+12", "++44.20.79460958", " ", "-",
            "word", "日本", "a@b.c@d.e", "9" * 30, "12 34", "\n", ",", "some text here"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)]
    return [*out, None, "", "x" * 100_000, "1" * 5000 + ".1.1.1", "+1 555 010 2030 " * 2000]


def clean_corpus(n=240):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(2, 8)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(30)]
        pick = i % 6
        extra = {0: f"{word()}.{i}@{word()}.example.com", 1: f"10.{i % 200}.3.77",
                 2: "4111 1111 1111 1111", 3: f"+1 ({200 + i}) 555-{1000 + i}", 4: f"{10 ** 6 + i}", 5: "at the dot"}[pick]
        words.insert(rng.randrange(30), extra)
        rows.append((i, " ".join(words)))
    return rows


def test_base_spans_against_plain_patterns():
    for text in texts():
        assert pii.base_spans(text or "") == plain_base(text or "")


def test_query_rows(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.cd"), (0, "x@y.z")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = pii.personal_data(df).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), pii.joined(plain_base(t or ""))) for i, t in rows)
    base = sorted((str(r.doc_id), r.base_sha256) for r in got)
    assert base == sorted((i, hashlib.sha256(s.encode()).hexdigest()) for i, s in want)
    lookup = {}
    for i, s in want:
        lookup.setdefault(i, set()).update(s.split(",") if s else ())
    for r in got:
        spans = r.spans.split(",") if r.spans else []
        assert len(spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added
    assert pii.personal_data(df.limit(0)).collect() == []


def test_model_adds_other_spellings_and_leaves_clean_text_alone(spark):
    df = spark.createDataFrame(clean_corpus(), "doc_id long, text string")
    model = pii.fit(df)
    found = lambda t: [(t[s:e], pii.KINDS[k]) for s, k, e in model.decode(t)]
    assert ("lora.17 at nomi dot example dot com", "email") in found("thus lora.17 at nomi dot example dot com goes")
    assert ("(312) 555-1234", "phone") in found("call (312) 555-1234 now")
    assert found("the dot is at the end of a line") == []
    assert found("order 1000731 of them") == []


def test_recall_on_planted_spellings():
    """At least nine in ten of the spellings that no rule knows, and no bare text."""
    rng, model = random.Random(8), pii.train([t for _, t in clean_corpus(240)])
    word = lambda: "".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randrange(3, 8)))
    caught = total = 0
    for at in pii.ATS:
        for dot in pii.DOTS:
            if (at, dot) == ("@", "."):
                continue
            for _ in range(12):
                mail = f"{word()}.{rng.randrange(90)}{at}{word()}{dot}example{dot}com"
                text = f"{word()} {word()} {mail} {word()}"
                spans = [(a + s, a + e) for a, b in pii.places(text) for s, k, e in model.decode(text[a:b]) if k == 0]
                start = text.index(mail)
                caught += any(s < start + len(mail) and e > start + len(mail) // 2 for s, e in spans)
                total += 1
    assert caught / total >= 0.9
    for text in ("look at the end", "we met at noon. then left", "a dot at the top of the page", "order 12 at 3.50 each"):
        assert not [x for a, b in pii.places(text) for x in model.decode(text[a:b])]


def test_a_long_table_of_numbers_is_one_place_in_bounded_memory():
    import tracemalloc

    model = pii.train([t for _, t in clean_corpus(60)])
    text = " ".join(str(100_000 + 7 * k) for k in range(10_000))
    assert len(pii.places(text)) == 1
    tracemalloc.start()
    model.decode(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(text)


def test_segmentation_is_the_best_one():
    model = pii.train([t for _, t in clean_corpus(60)])
    for _, text in clean_corpus(20):
        text = text[:120]
        tokens, spans = pii.candidates(text)
        _, scores = model.scores(text, tokens, spans)

        def best(j, memo={}):  # noqa: B006
            key = (text, j)
            if key not in memo:
                memo[key] = 0.0 if j == 0 else max(
                    [best(j - 1)] + [best(i) + scores[k].max() for k, (i, e, _) in enumerate(spans) if e == j])
            return memo[key]

        total = 0.0
        where = {(tokens[i][0], tokens[j - 1][1]): k for k, (i, j, _) in enumerate(spans)}
        for s, k, e in model.decode(text):
            total += scores[where[s, e]][k]
        assert abs(total - best(len(tokens))) < 1e-9
