"""Personal data in text: fixed patterns, and further spans by weak supervision.

Four kinds have a fixed pattern (email, ip, card, phone); what it finds always counts.
Looser patterns propose further candidates: addresses spelt out, phone numbers without a
plus, account-like numbers, secrets. On every candidate and fixed span labelers vote
personal, not personal or nothing: a regex or checksum, gazetteers (domains, dial codes,
issuers), the words before it, its borders and its neighbours. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is, and a logistic
span classifier is trained on the resulting posteriors. A candidate counts if the
classifier gives it one half or more.

Votes and features are small integers, so a corpus of any size is, for training, a table
of counts with at most ``KINDS`` x 3^labelers x shapes rows; all documents go into it.

Defined cases: a null or empty text has no spans; very long texts are read whole, in time
proportional to their length; repeated rows count as often as they stand; with no
candidate anywhere only the fixed kinds are found; other columns go along.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("spelt_email", "local_phone", "account", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# The digits before a match can't be part of one: it would have begun with them.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SPELT_EMAIL = re.compile(r"\b[A-Za-z0-9_%+-]{1,64}\s?[(\[{]\s?(?:at|AT)\s?[)\]}]\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?)[A-Za-z0-9-]{1,63})+")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)\x20?|[0-9]{3,4}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_-]{0,64}[0-9])[A-Za-z0-9_-]{24,128}(?![A-Za-z0-9_/+=-])")

#: Fixed word lists of the gazetteer and context labelers.
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk it nl eu us info co".split())
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55",
              "61", "81", "82", "86", "91")
CUES = {
    "email": ("mail", "contact", "write"), "spelt_email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "from"),
    "card": ("card", "visa", "mastercard", "payment", "credit"), "account": ("account", "iban", "card", "konto", "compte", "cuenta"),
    "phone": ("phone", "tel", "call", "fax", "mobile"), "local_phone": ("phone", "tel", "call", "fax", "mobile"),
    "secret": ("token", "key", "secret", "password", "passwd", "auth"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "figure", "section", "chapter", "doi", "sha", "commit", "md5")
LABELERS = ("form", "gazetteer", "context", "borders", "neighbours")
CONTEXT_CHARS = 32


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of name@domain, by the at signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not any(d in text for d in "0123456789"):
        return out
    if text.count(".") >= 3:
        for m in IP.finditer(text):
            if all(len(p) < 4 and int(p) < 256 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of the looser patterns that touch no fixed span."""
    out: list[tuple[str, int, int]] = []
    if "at" in text or "AT" in text:
        if "(" in text or "[" in text or "{" in text:
            out += [("spelt_email", *m.span()) for m in SPELT_EMAIL.finditer(text)]
    if any(d in text for d in "0123456789"):
        out += [("local_phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
        out += [("account", *m.span()) for m in CARD.finditer(text) if 12 <= sum(c not in " -" for c in m[0]) <= 34]
        out += [("secret", *m.span()) for m in SECRET.finditer(text)]
    if not out:
        return out
    taken = sorted((a, b) for _, a, b in base)
    kept = []
    for kind, a, b in sorted(out, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        taken_here = any(x < b and a < y for x, y in _near(taken, a, b))
        if not taken_here and not (kept and kept[-1][2] > a):
            kept.append((kind, a, b))
    return kept


def _near(spans: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int]]:
    from bisect import bisect_left

    i = bisect_left(spans, (a, a))
    while i > 0 and spans[i - 1][1] > a:
        i -= 1
    j = bisect_left(spans, (b, b))
    return spans[max(0, i - 4):j]


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler: 1 personal, -1 not, 0 nothing."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = text[max(0, start - CONTEXT_CHARS):start].lower()
    form = gazetteer = 0
    if kind in ("email", "spelt_email"):
        tail = re.split(r"[.\s(\[{)\]}]+", span.rstrip(")]}"))[-1].lower()
        form = 1 if tail.isalpha() and len(tail) > 1 else -1
        gazetteer = 1 if tail in TOP_DOMAINS else 0
    elif kind == "ip":
        form, gazetteer = 1, -1 if span.startswith(("0.", "127.", "255.")) else 0
    elif kind in ("card", "account"):
        form = 1 if 13 <= len(digits) <= 19 and luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind in ("phone", "local_phone"):
        form = 1 if "(" in span or "-" in span or " " in span else 0
        gazetteer = (1 if digits.startswith(DIAL_CODES) else -1) if kind == "phone" else 0
    elif kind == "secret":
        letters = len(span) - len(digits)
        form = 1 if len(digits) >= 6 and letters >= 4 and len(set(span)) >= 10 else -1
        gazetteer = 1 if re.fullmatch(r"[0-9a-fA-F]{32,}", span) or span.startswith(("sk", "ghp", "AKIA", "xox")) else 0
    context = 1 if any(c in before for c in CUES[kind]) else -1 if any(c in before for c in AGAINST) else 0
    edge = (text[start - 1:start], text[end:end + 1])
    borders = -1 if any(c.isalnum() or c in "_/=" and c for c in edge) else 1
    around = text[max(0, start - 12):start] + text[end:end + 12]
    neighbours = -1 if sum(c.isdigit() for c in around) > 6 else 0
    return form, gazetteer, context, borders, neighbours


def shape(text: str, start: int, end: int) -> int:
    """A bucket of length and share of digits, 0..15."""
    span = text[start:end]
    length = min(3, (end - start) // 12)
    return length * 4 + min(3, 4 * sum(c.isdigit() for c in span) // max(1, len(span)))


@dataclass
class Model:
    """Weights of the span classifier; without any, no candidate counts."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    reliabilities: dict = field(default_factory=dict)

    def probability(self, kind: str, vote: tuple[int, ...], shaped: int) -> float:
        if not len(self.weights):
            return 0.0
        return float(1 / (1 + np.exp(-(features(kind, vote, shaped) @ self.weights))))


def features(kind: str, vote: tuple[int, ...], shaped: int) -> np.ndarray:
    out = np.zeros(len(KINDS) + 2 * len(LABELERS) + 16)
    out[KINDS.index(kind)] = 1
    for i, v in enumerate(vote):
        if v:
            out[len(KINDS) + 2 * i + (v < 0)] = 1
    out[len(KINDS) + 2 * len(LABELERS) + shaped] = 1
    return out


def pattern_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, votes, shape, count) over all spans and candidates of all documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if value:
                    base = base_spans(value)
                    for kind, a, b in base + proposals(value, base):
                        seen[kind, votes(value, kind, a, b), shape(value, a, b)] += 1
        rows = list(seen.items())
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([list(k[1]) for k, _ in rows], pa.list_(pa.int32())),
             pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())], ["kind", "votes", "shape", "n"])

    parts = docs.select(text).mapInArrow(counted, "kind string, votes array<int>, shape int, n long")
    return parts.groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))


def trained(counts: DataFrame, rounds: int = 200, ridge: float = 1.0) -> Model:
    """Reliabilities by expectation-maximisation, then the classifier by Newton steps on the posteriors."""
    rows = sorted((r[0], tuple(r[1]), r[2], r[3]) for r in counts.collect())  # finite patterns, not spans
    if not rows:
        return Model()
    vote = np.array([r[1] for r in rows])
    n = np.array([r[3] for r in rows], float)
    kind = np.array([KINDS.index(r[0]) for r in rows])
    # prior counts: a labeler that votes is right four times of five; fixed kinds are personal mostly, proposals half the time
    prior = np.zeros((2, len(LABELERS), 3))
    prior[1], prior[0] = np.array([4.0, 8.0, 16.0]), np.array([16.0, 8.0, 4.0])  # votes -1, 0, 1
    start = np.where(np.arange(len(KINDS)) < len(BASE_KINDS), 0.9, 0.5)
    share, table = start.copy(), prior / prior.sum(axis=2, keepdims=True)
    posterior = np.zeros(len(rows))
    for _ in range(rounds):
        logs = [np.log(table[c][np.arange(len(LABELERS)), vote + 1]).sum(axis=1) for c in (0, 1)]
        odds = np.log(share[kind] / (1 - share[kind])) + logs[1] - logs[0]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, posterior = np.abs(new - posterior).max(), new
        scale = 100.0 / max(100.0, n.sum())  # the prior weighs as a hundredth of what is seen, 28 votes at least
        for c, weight in ((1, n * posterior), (0, n * (1 - posterior))):
            for k in range(len(LABELERS)):
                table[c, k] = prior[c, k] / scale / 100 + np.bincount(vote[:, k] + 1, weights=weight, minlength=3) + prior[c, k]
        table /= table.sum(axis=2, keepdims=True)
        total = np.bincount(kind, weights=n, minlength=len(KINDS))
        share = (np.bincount(kind, weights=n * posterior, minlength=len(KINDS)) + 20 * start) / (total + 20)
        if moved < 1e-9:
            break
    x = np.array([features(r[0], r[1], r[2]) for r in rows])
    w, weight = np.zeros(x.shape[1]), n / n.sum() * min(n.sum(), 1e6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (posterior - p)) - ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Model(w, {name: table[:, k].round(4).tolist() for k, name in enumerate(LABELERS)})


def spans_of(text: str | None, model: Model, known: dict | None = None) -> tuple[list, list]:
    """Fixed spans, and the candidates that the classifier takes; each by kind as listed, then start."""
    if not text:
        return [], []
    base, added = base_spans(text), []
    for kind, a, b in proposals(text, base):
        key = kind, votes(text, kind, a, b), shape(text, a, b)
        p = known.get(key) if known is not None else None
        if p is None:
            p = model.probability(*key)
            if known is not None:
                known[key] = p
        if p >= 0.5:
            added.append((kind, a, b))
    return base, sorted(added, key=lambda s: (KINDS.index(s[0]), s[1]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(text: Column, model: Model) -> Column:
    """struct<n_email, n_ip, n_card, n_phone, base_sha256, spans>"""

    @F.arrow_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(column: pa.Array) -> pa.Array:
        known: dict = {}
        numbers: list[list[int]] = [[] for _ in BASE_KINDS]
        digests, texts = [], []
        for value in column.to_pylist():
            base, added = spans_of(value, model, known)
            for out, kind in zip(numbers, BASE_KINDS):
                out.append(sum(s[0] == kind for s in base))
            digests.append(sha256(joined(base).encode()).hexdigest())
            texts.append(joined(base + added))
        return pa.StructArray.from_arrays(
            [*(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
            [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return find(text)


def masked_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span as <KIND>; of overlapping spans the first names the place."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join([*out, text[last:]]) if spans else text


def masked(text: Column, model: Model) -> Column:
    """The text without its personal data; null stays null."""

    @F.arrow_udf("string")
    def mask(column: pa.Array) -> pa.Array:
        known: dict = {}
        return pa.array([x and masked_text(x, sum(spans_of(x, model, known), [])) for x in column.to_pylist()], pa.string())

    return mask(text)
