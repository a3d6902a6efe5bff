"""Personal data: base kinds against plain patterns, added kinds by planted cases, and the whole table."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gaugeworks.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def checksum(digits: str) -> int:
    return sum((int(c) * (1 + i % 2) - 1) % 9 + 1 if int(c) else 0 for i, c in enumerate(reversed(digits))) % 10


def brute(text: str | None) -> list[tuple]:
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            right = {
                "email": lambda: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and checksum(d) == 0, "phone": lambda d=digits: 8 <= len(d) <= 15,
            }
            if right[kind]():
                out.append((kind, m.start(), m.end()))
    return out


pieces = st.sampled_from(["a", "b.", "@", "x@y.z", "1", "22", ".", "255.", "256", "+", "+4", "-", " ", "(", ")", "%", "_", "4111111111111111", "é", "٣", "\n"])


@settings(max_examples=500, deadline=None)
@given(st.lists(pieces, max_size=30).map("".join))
def test_base_kinds_equal_plain_patterns(text):
    assert [x[:3] for x in pii.find(text) if x[0] in pii.BASE] == brute(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "999." * 100_000, "a@" * 100_000, "AB12 " * 50_000, "12:" * 100_000, "(12) " * 30_000])
def test_time_grows_with_the_text(text):
    """Patterns that try every place of such a run anew would not end."""
    assert not any(x[0] in ("email", "phone", "iban", "ssn", "ipv6") for x in pii.find(text))


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("my iban DE89 3704 0044 0532 0130 00 thanks", "iban", "DE89 3704 0044 0532 0130 00"),
        ("BIC COBADEFF GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
        ("call 030 1234 5678 now", "local_phone", "030 1234 5678"),
        ("amex card 378282246310005", "short_card", "378282246310005"),
        ("ssn 123-45-6789", "ssn", "123-45-6789"),
        ("server 2001:db8::1 is up", "ipv6", "2001:db8::1"),
    ],
)
def test_added_kinds_are_found(text, kind, value):
    assert [(k, text[s:e]) for k, s, e, _ in pii.find(text)] == [(kind, value)]


@pytest.mark.parametrize(
    "text", ["DE88 3704 0044 0532 0130 00", "part 030 1234 5678", "030 1234 5678", "378282246310005", "123-45-6789", "card 378282246310006", "at 12:30:45 std::vector", "666-12-3456 ssn", "call order 030 1234 5678"]
)
def test_wrong_checksums_and_plain_numbers_are_not(text):
    assert pii.find(text) == []


def test_context_and_overlap():
    plain, told = pii.find("x 10.0.0.1 y")[0], pii.find("host 10.0.0.1 y")[0]
    assert plain[3] < told[3] and plain[0] == told[0] == "ip"
    # A base phone number holds what a local number would be; the base span stays alone.
    assert [x[0] for x in pii.find("phone +49 30 1234 5678")] == ["phone"]
    assert pii.redact("mail a@b.de or +1 (017) 555-7713!") == "mail [EMAIL] or [PHONE]!" and pii.redact(None) is None


def test_odd_rows_and_columns(spark):
    rows = [(1, None, 9, 9), (1, None, 9, 9), (None, "a@b.c", 9, 9), (3, "", 9, 9), (4, "word " * 200_000 + "a@b.c", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id long, spans long")
    got = {(r["doc_id"], len(r["spans"])) for r in pii.scan(df).collect()}
    assert got == {(1, 0), (None, 1), (3, 0), (4, 1)} and pii.scan(df).count() == 5
    assert pii.scan(df.limit(0)).collect() == []


def test_query_on_the_whole_table(spark, data):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op12_pii(spark, data).collect()
    assert len(got) == len(texts)
    seen = 0
    for r in got:
        spans = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert r["spans"].split(",")[: len(spans)] == [f"{k}:{s}:{e}" for k, s, e in spans] or not spans
        seen += len(spans)
    assert seen > 0


def test_stored_scores_are_those_of_the_text(spark):
    df = spark.createDataFrame([(1, "host 10.0.0.1 mail a@b.c")], "doc_id long, text string")
    assert pii.scan(df).select(F.explode("spans").alias("s")).select("s.kind", "s.score").collect() == [("email", 1.0), ("ip", 1.0)]
