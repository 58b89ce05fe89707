"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

One pass over each text inside ``mapInArrow``; no shuffle, one row out per row
in. Scans are written so that their time grows in proportion to the text: a
digit run is tried once from its start, an e-mail address is grown outwards from
its ``@``.

Edge cases: a null text counts as empty and has no spans; rows are judged one by
one, so repeated rows give equal results; of spans that start alike the kind listed
first comes first; a very long text is searched whole; an empty table gives no rows;
other columns are not read. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Order in which kinds are listed where spans start alike: the base kinds, then the added ones.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")

#: Words within CONTEXT code points of a span that make its kind likelier.
CONTEXT = 40
CONTEXT_WORDS = {
    "email": {"email", "mail", "contact", "address", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "client"},
    "card": {"card", "credit", "visa", "mastercard", "amex", "payment", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "telefon", "teléfono", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
#: Score of a span by kind before its context is read, and what a context word adds.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.95, "ssn": 0.4}
CONTEXT_BONUS = 0.2
#: Added kinds are reported from this score on; base kinds always are.
LEAST_SCORE = 0.5


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    rest = 0
    for c in turned:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        m = _DOMAIN.match(text, at + 1) if first < at else None
        if m:
            yield first, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that their kind's check confirms, by kind."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b
    if _DIGIT.search(text):
        for m in _IP.finditer(text) if "." in text else ():
            if all(map(_small, m.groups())):
                yield "ip", m.start(), m.end()
        for m in _CARD.finditer(text):
            if m.end() - m.start() > 13:
                digits = _NOT_DIGIT.sub("", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    yield "card", m.start(), m.end()
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    yield "phone", m.start(), m.end()
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield "iban", m.start(), m.end()
        for m in _SSN.finditer(text) if "-" in text else ():
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", m.start(), m.end()


def find_spans(text: str | None) -> list[Span]:
    """All spans of a text, by start, then kind as listed in ``KINDS``."""
    text = text or ""
    found = []
    for kind, a, b in _proposals(text):
        around = text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]
        near = any(w.lower() in CONTEXT_WORDS[kind] for w in _WORD.findall(around))
        score = min(1.0, PRIOR[kind] + CONTEXT_BONUS * near)
        if kind in BASE or score >= LEAST_SCORE:
            found.append(Span(kind, a, b, score))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


BASE = KINDS[:4]


def redact(text: str | None, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first stays."""
    text, out, done = text or "", [], 0
    for s in spans:
        if s.start >= done:
            out += [text[done : s.start], f"[{s.kind.upper()}]"]
            done = s.end
    return "".join([*out, text[done:]])


SPAN_SCHEMA = "array<struct<kind:string,start:int,end:int,score:double>>"


def detect(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``doc_id`` and ``spans`` of each row; ``with_text`` adds the redacted text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            spans = [find_spans(t.as_py()) for t in texts]
            cols = [ids, pa.array([[vars(s) for s in x] for x in spans], kind)]
            if with_text:
                cols.append(pa.array([redact(t.as_py(), x) for t, x in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "spans", "redacted"][: len(cols)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans {SPAN_SCHEMA}" + (", redacted string" if with_text else ""))
