"""Operator 7: personal data by weak supervision.

Candidates are spans that a wide pattern finds. Labelers vote on each (+1, 0 or -1): a strict pattern with its checks, a
typical shape, a gazetteer, words in front of it, and words that speak against it. Expectation-maximisation estimates how
reliable each labeler is and the probability that a candidate is personal data; a logistic classifier of votes and span
shape is trained on those probabilities. Both work on the counts of (kind, votes, shape) patterns over all documents, a
table of bounded size. What the classifier accepts is added to the spans of the strict patterns, which all stay.

Patterns are searched so that no text takes more than linear time: starts inside a run that cannot match anew are skipped.

Defined results: a null or empty text has no spans; texts of any length are searched whole; spans count code points, end
exclusive; repeated rows and null doc_ids give one row each; an empty table gives no rows; `redacted` keeps all other
columns, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepared, record, table, texts, written

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What every match of any pattern, strict or wide, holds: texts without it have no candidates.
_ANY = re.compile(r"[0-9@]|[(\[]at[)\]]|[A-Fa-f]:[A-Fa-f]")

#: Wide patterns of the candidates that no strict pattern finds.
_WIDE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "phone": re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"),
}
#: Words of the context and the gazetteer labelers. Fixed values.
_FOR = {
    "email": ("mail", "contact", "write", "reach", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "from"),
    "card": ("card", "visa", "credit", "pay", "iban", "karte", "tarjeta", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "móvil"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "api"),
}
_AGAINST = ("version", "license", "licence", "isbn", "page", "section", "figure", "http", "sha", "md5", "commit", "$", "€", "%", "#")
_ENDINGS = frozenset("com org net edu gov io de fr es uk eu info".split())
_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91".split())


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """From each @, the domain to its right and the run of local characters to its left."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m and at >= done:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the strict patterns, by start and then kind as listed."""
    if not _ANY.search(text):
        return []
    out = [(a, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


def _votes(kind: str, text: str, start: int, end: int, strict: bool) -> int:
    """The labelers' votes in base 3 (a digit is the vote + 1)."""
    s = text[start:end]
    before = text[max(0, start - 24) : start].lower()
    digits = sum(c.isdigit() for c in s)
    if kind == "email":
        shape = s.count("@") == 1 and "." in s.split("@")[-1]
        listed = re.split(r"[.\x20)\]]", s)[-1].lower() in _ENDINGS
    elif kind == "ip":
        shape, listed = s.count(".") == 3 or s.count(":") == 7, not s.startswith(("0.", "255."))
    elif kind == "card":
        shape, listed = digits in (15, 16), s[0] in "3456"
    elif kind == "phone":
        shape = 10 <= digits <= 13 and any(c in s for c in "() -.")
        listed = any(s.startswith("+" + c) for c in _CODES)
    else:
        kinds = [any(f(c) for c in s) for f in (str.isdigit, str.islower, str.isupper)]
        shape, listed = sum(kinds) >= 2 and digits * 8 >= len(s), len(s.rstrip("=")) in (20, 24, 32, 36, 40, 44, 48, 64, 88)
    votes = (1 if strict else -1 if kind == "card" else 0, 1 if shape else -1, 1 if listed else 0, any(w in before for w in _FOR[kind]), -any(w in before for w in _AGAINST))
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


LABELERS = 5


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int, int]]:
    """(start, kind, end, pattern) of all candidates; the pattern holds whether a strict pattern found it, votes and shape."""
    if not _ANY.search(text):
        return []
    found = [(a, k, b, True) for a, k, b in base]
    known = {(a, k, b) for a, k, b in base}
    for kind, wide in _WIDE.items():
        for m in wide.finditer(text):
            if kind == "secret" and not (any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0])):
                continue
            if (m.start(), kind, m.end()) not in known:
                found.append((m.start(), kind, m.end(), False))
    for m in _CARD.finditer(text):
        digits = sum(c.isdigit() for c in m[0])
        # Without the checksum only words in front can speak for a card.
        named = any(w in text[max(0, m.start() - 24) : m.start()].lower() for w in _FOR["card"])
        if 12 <= digits <= 19 and named and (m.start(), "card", m.end()) not in known:
            found.append((m.start(), "card", m.end(), False))
    out = []
    for a, k, b, strict in found:
        shape = min(3, (b - a) // 16) * 2 + any(c.isalpha() for c in text[a:b])
        out.append((a, k, b, (strict * 3**LABELERS + _votes(k, text, a, b, strict)) * 8 + shape))
    return out


class SpanClassifier:
    """For each kind the patterns whose probability is at least a half."""

    def __init__(self, counts: dict[str, dict[int, int]], rounds: int = 30):
        self.accepted: dict[str, set[int]] = {}
        self.reliability: dict[str, np.ndarray] = {}
        for kind, patterns in counts.items():
            codes = np.array(sorted(patterns))
            n = np.array([patterns[c] for c in codes.tolist()], float)
            votes = np.stack([codes // 8 // 3 ** (LABELERS - 1 - i) % 3 for i in range(LABELERS)], 1)
            p = 1 / (1 + np.exp(-(votes - 1).sum(1).astype(float)))  # majority vote to begin with
            for _ in range(rounds):
                prior = (n @ p + 1) / (n.sum() + 2)
                table = np.array([[[(n @ (y * (votes[:, i] == v)) + 0.5) / (n @ y + 1.5) for v in range(3)] for i in range(LABELERS)] for y in (1 - p, p)])
                log = np.log(table)[:, np.arange(LABELERS), votes].sum(2) + np.log([1 - prior, prior])[:, None]
                p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
            self.reliability[kind] = table
            features = np.concatenate([np.eye(3)[votes].reshape(len(codes), -1), np.eye(8)[codes % 8], np.ones((len(codes), 1))], 1)
            w = np.zeros(features.shape[1])
            for _ in range(25):  # Newton's method with a ridge
                q = 1 / (1 + np.exp(-features @ w))
                gradient = features.T @ (n * (p - q)) - w
                hessian = (features * (n * q * (1 - q))[:, None]).T @ features + np.eye(len(w))
                w = w + np.linalg.solve(hessian, gradient)
            self.accepted[kind] = {int(c) for c, q in zip(codes, features @ w, strict=True) if q >= 0}

    def added(self, base: list[tuple[int, str, int]], found: list[tuple[int, str, int, int]]) -> list[tuple[int, str, int]]:
        """Base spans and the accepted candidates that overlap neither them nor each other (leftmost, then longest)."""
        starts = sorted(a for a, _, _ in base)
        ends = list(accumulate((b for _, _, b in sorted((a, k, b) for a, k, b in base)), max))  # of all that start so far
        out, done = list(base), 0
        for a, k, b, pattern in sorted(found, key=lambda s: (s[0], -s[2], KINDS.index(s[1]))):
            if a < done or pattern not in self.accepted.get(k, ()):
                continue
            before = bisect_left(starts, b)  # base spans that start before this one ends
            if not before or ends[before - 1] <= a:
                out.append((a, k, b))
                done = b
        return sorted(out, key=lambda s: (s[0], KINDS.index(s[1])))


_FOUND = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(pa.int64())), ("found", pa.list_(pa.int64()))])


def _flat(text: str) -> tuple[list[int], list[int]]:
    base = base_spans(text)
    found = candidates(text, base)
    return [x for a, k, b in base for x in (a, KINDS.index(k), b)], [x for a, k, b, p in found for x in (a, KINDS.index(k), b, p)]


def _unflat(base: list[int], found: list[int]):
    return [(base[i], KINDS[base[i + 1]], base[i + 2]) for i in range(0, len(base), 3)], [(found[i], KINDS[found[i + 1]], found[i + 2], found[i + 3]) for i in range(0, len(found), 4)]


@prepared
def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, base and found, flat lists of the spans of the strict patterns and of the candidates."""

    def run(batches):
        for batch in batches:
            flat = [_flat(t) for t in texts(batch)]
            yield record(_FOUND, doc_id=batch.column("doc_id"), base=[x for x, _ in flat], found=[x for _, x in flat])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, base array<long>, found array<long>")


def fit(found: DataFrame) -> SpanClassifier:
    """The classifier from the pattern counts of all documents; patterns are at most len(KINDS) * 16 * 3^LABELERS."""
    each = F.transform(F.expr("sequence(0, cast(size(found) div 4 as int) - 1)"), lambda i: F.struct(F.get("found", i * 4 + 1).alias("kind"), F.get("found", i * 4 + 3).alias("pattern")))
    rows = found.where(F.size("found") > 0).select(F.explode(each).alias("c")).groupBy("c.kind", "c.pattern").agg(F.count("*").alias("n")).collect()
    counts: dict[str, dict[int, int]] = {}
    for r in rows:
        counts.setdefault(KINDS[r.kind], {})[r.pattern] = r.n
    return SpanClassifier(counts)


_SPANS = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:4]), ("base_sha256", pa.string()), ("spans", pa.string())])


@prepared
def spans(docs: DataFrame) -> DataFrame:
    """Base counts, the digest of the base spans, and all spans of each document."""
    found = written(docs.sparkSession, found_in(docs), "pii")
    classifier = fit(found)
    joined = lambda s: ",".join(f"{k}:{a}:{b}" for a, k, b in s)

    def run(batches):
        for batch in batches:
            both = [_unflat(*x) for x in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist(), strict=True)]
            columns = {f"n_{k}": [sum(s[1] == k for s in base) for base, _ in both] for k in KINDS[:4]}
            yield record(_SPANS, doc_id=batch.column("doc_id"), **columns, base_sha256=[hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in both], spans=[joined(classifier.added(*x)) for x in both])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


@prepared
def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; other columns are as they were."""
    classifier = fit(written(docs.sparkSession, found_in(docs), "pii"))
    at = docs.columns.index("text")

    def replaced(text: str | None) -> str | None:
        if not text or not _ANY.search(text):
            return text
        base = base_spans(text)
        out, done = [], 0
        for a, k, b in classifier.added(base, candidates(text, base)):
            if b <= done:
                continue
            if a >= done:
                out += [text[done:a], f"<{k.upper()}>"]
            done = b  # what is left of an overlapping span goes with the one before
        return "".join([*out, text[done:]])

    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([replaced(t) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents"))
