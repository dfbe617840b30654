"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Base kinds (email, ip, card, phone) are always reported. The method adds kinds: ``iban`` (mod-97)
and ``ssn`` (issued ranges), which are kept only where pattern, validator and context together
score at least MIN_SCORE. Every span has a score: the kind's prior, plus BOOST where one of the
kind's context words stands within CONTEXT code points of it.

Each text is scanned whole and in time linear in its length (addresses are looked up from their
``@``). Null and empty texts have no spans. Rows are independent: no shuffle, nothing dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds as listed; those of the base come first.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4
# Prior confidence by kind, and words near a span that raise it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
NEAR = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "server", "host", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
BOOST = 0.3
CONTEXT = 48
MIN_SCORE = 0.5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
WORDS = re.compile(r"[^\W_]+(?:-[^\W_]+)?")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: from each @, back over the local part, never behind the last match's end."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping dotted quads. A quad can start at any digit run; possessive runs keep this linear."""
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (text[m.start() : m.start(1) - 1], m[1], m[2], m[3])):
            yield m.span()


def find_spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, rank of the kind, end, score), by start and kind."""
    found: list[tuple[int, int, int]] = [(s, 0, e) for s, e in emails(text)]
    found += [(s, 1, e) for s, e in ips(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            found.append((m.start(), 4, m.end()))
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            found.append((m.start(), 5, m.end()))
    scored = []
    for start, rank, end in sorted(found):
        kind = KINDS[rank]
        near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
        boost = BOOST if not set(NEAR[kind]).isdisjoint(w.lower() for w in WORDS.findall(near)) else 0.0
        score = min(1.0, PRIOR[kind] + boost)
        if rank < BASE or score >= MIN_SCORE:
            scored.append((start, rank, end, score))
    return scored


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"


def _joined(spans: list[tuple[int, int, int, float]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            spans = find_spans(text) if text else []
            counts = [sum(1 for s in spans if s[1] == k) for k in range(BASE)]
            base = _joined([s for s in spans if s[1] < BASE])
            rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), _joined(spans), ",".join(f"{s[3]:.2f}" for s in spans)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])


def report(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: counts of base kinds, a digest of base spans, all spans and their scores."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_report, SCHEMA)
