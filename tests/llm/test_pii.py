"""Spans against the plain patterns, checksums, context words."""

import hashlib
import random
import re

from tablelearn.llm import pii
from tablelearn.llm.queries import QUERIES
from tests.conftest import SF01

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(d):
    odd = sum(map(int, d[-1::-2]))
    return (odd + sum(sum(map(int, str(2 * int(c)))) for c in d[-2::-2])) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub(r"[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(d) <= 19 and plain_luhn(d)
                    or kind == "phone" and 8 <= len(d) <= 15):
                out.append((kind, *m.span()))
    return out


def test_random_texts():
    rng = random.Random(2)
    bits = list("@@..--+ ()%_19a") + ["4111 1111 1111 1111", "127.0.0.1", "x@y.zz", "é", "+49 170", "255", "256"]
    for _ in range(30000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 18)))
        assert pii.base_spans(t) == plain(t), t


def test_no_quadratic_scan():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@" * 100_000, "+1" * 100_000,
              "+1" + "." * 200_000, "1 " * 100_000, "a.b@" * 60_000, "AB12 " * 60_000):
        pii.find(t)


def test_parts_with_many_zeros():
    for t in ("1.2.3." + "0" * 5000 + "4", "0" * 5000 + ".0.0.0"):
        assert pii.base_spans(t)[0] == ("ip", 0, len(t))
    assert pii.base_spans("1.2.3." + "0" * 5000 + "256") == []


def test_added_kinds_and_scores():
    t = "Bank IBAN DE89 3704 0044 0532 0130 00 and DE88370400440532013000. Call 555-123-4567; part 555-123-4567x"
    kinds = [(k, t[a:b]) for k, a, b, _ in pii.find(t)]
    assert ("iban", "DE89 3704 0044 0532 0130 00") in kinds
    assert not any(k == "iban" and "DE88" in s for k, s in kinds)
    assert ("local_phone", "555-123-4567") in kinds and len(kinds) == 2
    assert not pii.find("ref 555-123-4567") and pii.find("SSN 078-05-1120")
    high, low = (pii.find(f"{w} 10.0.0.1")[0][3] for w in ("server ip", "version"))
    assert high > low


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "é x@y.de", "b"), (2, "", None)],
                               "doc_id long, text string, Text string")
    out = {(r.doc_id, tuple(map(tuple, r.spans))) for r in pii.find_pii(df).collect()}
    assert out == {(1, ()), (2, ()), (None, (("email", 2, 8, 0.9),))}
    assert pii.find_pii(df).count() == 4
    assert pii.find_pii(df.limit(0)).count() == 0


def test_query(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = QUERIES["op10_pii"](spark, SF01).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = plain(docs[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]
        assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
        assert r.spans.startswith(shown)
    assert sum(r.n_email for r in rows) > 0
