"""Personal data: patterns propose spans, checksums confirm, context scores.

Base kinds (email, ip, card, phone) are proposed by fixed patterns, leftmost
and without overlap within a kind; matches that fail their check (address
parts up to 255, Luhn, number of digits) are dropped.  The base spans always
stay.  Three kinds are added: ``iban`` (confirmed by mod 97), and
``local_phone`` and ``national_id``, which have no checksum and count only if
words near them raise their score to ``THRESHOLD``.

Every span has a score in [0, 1]: a start value for its kind, raised by each
supporting and lowered by each contradicting word among the ``WINDOW``
characters before it.

Offsets are code points, the end exclusive.  Null text counts as empty; texts
are scanned whole, in time linear in their length; rows are independent, so
repeated rows give repeated results and an empty table an empty one.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, take

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone", "national_id")
WINDOW = 48
THRESHOLD = 0.5
STEP = 0.25
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9,
         "local_phone": 0.3, "national_id": 0.3}
SUPPORT = {
    "email": {"email", "mail", "contact", "write", "address"},
    "ip": {"ip", "host", "server", "address", "login", "client"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "pay"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "contact", "telephone"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"},
    "local_phone": {"phone", "tel", "call", "mobile", "fax", "telephone"},
    "national_id": {"ssn", "social", "security", "identity", "national"},
}
AGAINST = {
    "email": {"example"},
    "ip": {"version", "release", "section", "chapter"},
    "card": {"order", "invoice", "tracking", "serial"},
    "phone": {"version", "offset", "score"},
    "iban": {"serial", "sku"},
    "local_phone": {"order", "invoice", "part", "serial", "isbn"},
    "national_id": {"order", "invoice", "part", "serial", "isbn"},
}

# Each pattern starts where no earlier start could reach, which changes no
# match and keeps the scan linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")
NATIONAL_ID = re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
WORD = re.compile(r"\w+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[Span]:
    out, free = [], 0
    for m in AT_DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append(("email", start, m.end()))
            free = m.end()
    return out


def base_spans(text: str) -> list[Span]:
    """The spans of the base kinds, by kind and start."""
    out = emails(text) if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text)
            if all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in m[0].split(".")))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def score(text: str, kind: str, start: int) -> float:
    near = set(WORD.findall(text[max(0, start - WINDOW):start].lower()))
    s = START[kind] + STEP * len(near & SUPPORT[kind]) - STEP * len(near & AGAINST[kind])
    return min(1.0, max(0.0, s))


def find(text: str) -> list[tuple[str, int, int, float]]:
    """All spans of a text with their scores, by kind as in ``KINDS``, then start."""
    out = [(k, a, b, score(text, k, a)) for k, a, b in base_spans(text)]
    taken = [(a, b) for _, a, b, _ in out]
    for kind, pattern in (("iban", IBAN), ("local_phone", LOCAL_PHONE), ("national_id", NATIONAL_ID)):
        for m in pattern.finditer(text):
            if kind == "iban":
                sure = mod97(m[0])
            else:
                sure = score(text, kind, m.start()) >= THRESHOLD and not any(
                    a < m.end() and m.start() < b for a, b in taken)
            if sure:
                out.append((kind, *m.span(), score(text, kind, m.start())))
    return out


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                            ("score", pa.float64())]))


def find_pii(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``spans`` (kind, start, end, score) of each row's whole text."""
    rows = take(df, id=id, text=text)

    def one(columns: list[pa.Array]) -> list[pa.Array]:
        texts = columns[1].cast(pa.string())
        found = [find(t.as_py() or "") for t in texts]
        return [columns[0], pa.array(found, ARROW)]

    return map_batches(rows, one, [(id, rows.dtypes[0][1]), ("spans", SPANS)])
