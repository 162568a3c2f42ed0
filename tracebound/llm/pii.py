"""Personal data by rules and a semi-Markov conditional random field (operator 9).

Four rules find e-mail addresses, IP addresses, card numbers and phone numbers in their usual
form. A semi-Markov CRF adds other spellings: it scores whole candidate spans by features of the
span, its ends and its neighbours, and dynamic programming over spans of bounded length chooses
boundaries and kinds together.

The CRF is trained here, on a bounded sample of places where the rules agree with themselves:
their spans are the labels. Each training place also appears respelt (an e-mail with "at" and
"dot", either or both, a phone number without its plus), so that the model cannot lean on the rules'
own marks. Only places with a digit run, an at sign, a spelt-out dot, or a spelt-out at before a
domain are looked at.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracebound.llm.batches import pieces, shared
from tracebound.plans.lineage import cut

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the rules.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Longest span in tokens and characters, and what is looked at on both sides of a trigger.
MAX_TOKENS, MAX_CHARS, AROUND = 26, 64, 40
#: Training places per kind and without a span; a sample by hash of the place.
PLACES, EPOCHS, RATE = 60, 10, 0.3
TRIGGER = re.compile(
    r"@|[0-9](?:[ .()-]*[0-9]){5,}|(?i:[(\[ ]dot[)\] ])|(?i:[(\[ ]at[)\] ] ?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})")
#: Digits that a span without letters may have: no kind has more.
MAX_DIGITS = 19
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
#: Spellings of an at sign and a dot that training sees.
ATS, DOTS = ("@", " at ", "[at]", " (at) ", " [at] ", "(at)"), (".", " dot ", "[dot]", " (dot) ", "(dot)")
SEED = 3


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; walks from the at signs, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' spans in order of start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def places(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of the triggers."""
    out: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


# --- the model -----------------------------------------------------------------------------

def bucket(n: int) -> int:
    return n if n < 5 else 5 + min((n - 5) // 3, 6)


def features(text: str, start: int, end: int, tokens: int) -> list[str]:
    """Features of the whole span ``text[start:end]`` and of its two neighbours."""
    span = text[start:end]
    digits = digits_of(span)
    spelt = re.search(r"(?i)[ \[(]at[ \])]", span) is not None
    dots = len(re.findall(r"(?i)\.|[ \[(]dot[ \])]", span))
    out = [
        "bias", f"digits{bucket(len(digits))}", f"dots{min(dots, 5)}", f"tokens{bucket(tokens)}",
        f"first{kind_of(span[0])}", f"last{kind_of(span[-1])}",
        f"before{kind_of(text[start - 1]) if start else '^'}", f"after{kind_of(text[end]) if end < len(text) else '$'}",
        f"at{span.count('@') + spelt}", f"letters{any(c.isalpha() for c in span)}",
        f"blank{any(c.isspace() for c in span)}", f"mark{bool(re.search(r'[()+-]', span))}",
        f"at{span.count('@') + spelt}dots{min(dots, 3)}first{kind_of(span[0])}last{kind_of(span[-1])}",
    ]
    if digits and len(digits) == sum(not (c in " -") for c in span):
        out.append(f"number{12 <= len(digits) <= 19}luhn{luhn(digits)}")
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", span):
        out.append("quad")
    if re.fullmatch(r"\+?[0-9]{0,3}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", span):
        out.append("groups")
    return out


def kind_of(char: str) -> str:
    return "a" if char.isalpha() else "9" if char.isdigit() else "_" if char.isspace() else char


def token_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in TOKEN.finditer(text)]


def spans_from(text: str, tokens: list[tuple[int, int]], i: int) -> Iterator[tuple[int, int, int]]:
    """Candidate spans (first token, end token, tokens) that begin with token ``i``."""
    a = tokens[i][0]
    if not (text[a].isalnum() or text[a] in "+("):
        return
    signal, digits, bare = False, 0, True
    for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
        s, e = tokens[j - 1]
        if e - a > MAX_CHARS or "\n" in text[s:e]:
            return
        digits += e - s if text[s].isdigit() else 0
        bare &= not (text[s].isalpha() or text[s] == "@")
        if bare and digits > MAX_DIGITS:
            return
        signal |= text[s] in "@0123456789" or text[s:e].lower() in ("dot", "at")
        if signal and text[s].isalnum() and j - i > 1 or signal and e - s > 9:
            yield i, j, j - i


def candidates(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(tokens as spans, all candidate spans) of one place."""
    tokens = token_spans(text)
    return tokens, [x for i in range(len(tokens)) for x in spans_from(text, tokens, i)]


class SemiMarkov:
    """Weights per feature for the kinds; everything outside spans scores zero."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}

    def scores(self, text: str, tokens, spans, learn: bool = False):
        named = [features(text, tokens[i][0], tokens[j - 1][1], n) for i, j, n in spans]
        if learn:
            for x in named:
                for f in x:
                    self.weights.setdefault(f, np.zeros(len(KINDS)))
        return named, np.array([self.score(x) for x in named]).reshape(-1, len(KINDS))

    def decode(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation of a place; in a tie the earlier, shorter span.

        Spans are scored as they begin and reach MAX_TOKENS ahead at most, so a place of any length holds
        its tokens and one step back per token, never all its spans.
        """
        tokens = token_spans(text)
        ahead: dict[int, tuple[float, int, int]] = {}  # end token: value, first token, kind
        back: dict[int, tuple[int, int]] = {}
        best = 0.0
        for i in range(len(tokens) + 1):
            reached = ahead.pop(i, None)
            if reached is not None and reached[0] > best:
                best, back[i] = reached[0], reached[1:]
            if i == len(tokens):
                break
            for _, j, n in spans_from(text, tokens, i):
                scores = self.score(features(text, tokens[i][0], tokens[j - 1][1], n))
                kind = int(scores.argmax())
                if scores[kind] > 0 and best + scores[kind] > ahead.get(j, (-np.inf,))[0]:
                    ahead[j] = best + scores[kind], i, kind
        out, j = [], len(tokens)
        while j > 0:
            if j in back:
                i, kind = back[j]
                out.append((tokens[i][0], kind, tokens[j - 1][1]))
                j = i
            else:
                j -= 1
        return out[::-1]

    def score(self, named: list[str]) -> np.ndarray:
        known = [w for f in named if (w := self.weights.get(f)) is not None]
        return np.sum(known, axis=0) if known else np.zeros(len(KINDS))

    def step(self, text: str, gold: list[tuple[int, int, int]], rate: float) -> None:
        """One gradient step on the log-likelihood of the labelled segmentation."""
        tokens, spans = candidates(text)
        if not spans:
            return
        named, scores = self.scores(text, tokens, spans, learn=True)
        n = len(tokens)
        total = np.logaddexp.reduce(scores, axis=1)
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        ends: dict[int, list[int]] = {}
        begins: dict[int, list[int]] = {}
        for k, (i, j, _) in enumerate(spans):
            ends.setdefault(j, []).append(k)
            begins.setdefault(i, []).append(k)
        for j in range(1, n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[spans[k][0]] + total[k] for k in ends.get(j, ()))])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[spans[k][1]] + total[k] for k in begins.get(i, ()))])
        first = np.array([i for i, _, _ in spans])
        last = np.array([j for _, j, _ in spans])
        expected = np.exp(np.minimum(forward[first][:, None] + scores + backward[last][:, None] - forward[n], 0.0))
        wanted = {(a, b): k for a, k, b in gold}
        for k, (i, j, _) in enumerate(spans):
            kind = wanted.get((tokens[i][0], tokens[j - 1][1]))
            error = -expected[k]
            if kind is not None:
                error[kind] += 1
            if np.abs(error).max() > 1e-3:
                for f in named[k]:
                    self.weights[f] += rate * error


def respelt(text: str, gold: list[tuple[int, int, int]], rng: random.Random) -> tuple[str, list]:
    """The same place with its e-mail and phone spans in another spelling."""
    out, spans, at = [], [], 0
    for start, kind, end in gold:
        out.append(text[at:start])
        span = text[start:end]
        if kind == 0:
            a, d = rng.choice(ATS), rng.choice(DOTS)
            if (a, d) == ("@", "."):
                a = ATS[1]
            name, host = span.split("@", 1)
            span = name + a + host.replace(".", d)
        elif kind == 3:
            span = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", span)
        begin = sum(map(len, out))
        out.append(span)
        spans.append((begin, kind, begin + len(span)))
        at = end
    out.append(text[at:])
    return "".join(out), spans


def train(samples: list[str]) -> SemiMarkov:
    """Fit the model to places; the rules' spans in them are the labels."""
    rng, model, labelled = random.Random(SEED), SemiMarkov(), []
    for text in samples:
        gold, end = [], 0
        for start, kind, stop in base_spans(text):  # rules may overlap: the first one counts
            if start >= end:
                gold.append((start, kind, stop))
                end = stop
        labelled.append((text, gold))
        if any(k in (0, 3) for _, k, _ in gold):
            labelled.append(respelt(text, gold, rng))
    for epoch in range(EPOCHS):
        rng.shuffle(labelled)
        for text, gold in labelled:
            model.step(text, gold, RATE / (1 + epoch))
    return model


def fit(documents: DataFrame) -> SemiMarkov:
    """Train on at most PLACES places per kind and as many without a span."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches):
            rows = []
            for raw in texts:
                text = raw.decode(errors="replace")
                for a, b in places(text):
                    if b - a <= 8 * AROUND:
                        kinds = {k for _, k, _ in base_spans(text[a:b])}
                        rows.append((min(kinds, default=-1), text[a:b]))
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())],
                                  names=["kind", "place"])

    order = F.xxhash64("place", F.lit(SEED))
    rows = documents.select("text").mapInArrow(found, "kind int, place string").withColumn("h", order)
    found_rows = cut(rows.distinct())
    taken = [r.place for k in range(-1, len(KINDS))
             for r in found_rows.filter(F.col("kind") == k).orderBy("h", "place").limit(PLACES).collect()]
    return train(taken)


def personal_data(documents: DataFrame, model: SemiMarkov | None = None, key: str = "doc_id") -> DataFrame:
    """Spans of personal data in every row of ``documents(key, text)``.

    Returns the key, n_email, n_ip, n_card, n_phone (the rules' spans), base_sha256 over them, ``spans``
    (all spans as kind:start:end, comma-joined) and n_added. Positions count code points, ends are
    exclusive. Spans of the model that touch a rule's span are left out. Null and empty texts have
    none; repeated rows have equal results; equally good segmentations give the earlier spans; a text of
    any length is read whole, in time and memory that follow its length; other columns are not read.
    """
    sent = shared(documents.sparkSession, model or fit(documents))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches):
            counts, digests, spans, added = [], [], [], []
            for raw in texts:
                text = raw.decode(errors="replace")
                base = base_spans(text)
                more = []
                for a, b in places(text):
                    for s, k, e in sent().decode(text[a:b]):
                        if not near(base, a + s, a + e):
                            more.append((a + s, k, a + e))
                counts.append([sum(k == n for _, k, _ in base) for n in range(len(KINDS))])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more)))
                added.append(len(more))
            columns = list(zip(*counts)) or [()] * len(KINDS)
            yield pa.record_batch(
                [batch.column(key), *[pa.array(c, pa.int64()) for c in columns], pa.array(digests, pa.string()),
                 pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                names=[key, *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, "text").mapInArrow(
        marked, f"`{key}` {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS)
        + ", base_sha256 string, spans string, n_added bigint")


def near(base: list[tuple[int, int, int]], start: int, end: int) -> list[tuple[int, int, int]]:
    """The rules' spans that share a character with [start, end)."""
    return [x for x in base if x[0] < end and x[2] > start]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
