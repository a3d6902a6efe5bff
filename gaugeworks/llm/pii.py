"""Personal data: patterns propose spans, checksums confirm them, and words nearby adjust their score.

Four base kinds (mail addresses, IP addresses, payment cards, international phone numbers) always stand.
Further kinds are proposed by looser patterns: bank accounts (mod 97), cards of 12 to 15 digits (Luhn and
issuer), phone numbers without a country code, social security numbers and IPv6 addresses. A proposal that
its validator confirms starts with the score of its kind; words near it that speak for the kind raise the
score, words that speak for a plain number lower it. What reaches the threshold is kept.

Every pattern takes time in proportion to the text: a run of characters that leads to nothing isn't
looked at again from its next character.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "short_card", "local_phone", "ssn", "ipv6")
KINDS = BASE + ADDED
BEFORE, AFTER = 48, 24  # code points around a proposal that are read for context
CLOSE = 2  # words before a proposal, the last of which say whether it is a plain number
RAISE, LOWER = 0.3, 0.4
THRESHOLD = 0.6

#: Score of a confirmed proposal without context.
PRIOR = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "short_card": 0.4, "local_phone": 0.35, "ssn": 0.4, "ipv6": 0.7}

#: Words that speak for a kind, in the languages of the texts.
CONTEXT = {
    "email": "mail e-mail email contact write kontakt schreiben courriel adresse correo escribir почта",
    "ip": "ip address host server client login adresse direccion serveur servidor",
    "card": "card visa mastercard amex credit debit payment pay karte kreditkarte carte tarjeta карта",
    "phone": "phone tel telephone call mobile cell fax telefon anruf mobil handy téléphone appel portable teléfono llamar móvil телефон",
    "iban": "iban account bank transfer konto bankverbindung compte virement cuenta счет",
    "ssn": "ssn social security",
    "ipv6": "ip ipv6 address host server",
}
CONTEXT["short_card"], CONTEXT["local_phone"] = CONTEXT["card"], CONTEXT["phone"]
#: Words that speak for a number that is no personal data.
PLAIN = frozenset("order invoice version isbn issn serial ticket part article item page bestellung rechnung artikel facture commande factura pedido".split())
CONTEXT = {kind: frozenset(words.split()) for kind, words in CONTEXT.items()}

#: Length of a bank account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18,
    "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits that no dotted parts follow is passed over whole: no later digit of it could begin a match.
IP = re.compile(r"[0-9]++(?:\.([0-9]++)\.([0-9]++)\.([0-9]++))?+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
IBAN_BODY = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:[ -]?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTH.values())}
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-][0-9]{2,5}){1,4}(?![\w-])")
SSN = re.compile(r"(?<![\w-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![\w-])")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.])")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether a string of digits has a right Luhn checksum."""
    return (sum(map(int, digits[::-2])) + sum(int("0246813579"[int(c)]) for c in digits[-2::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether letters and digits of an account number leave 1 over modulo 97, its first four moved to the end."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]+", "", text)


def emails(text: str) -> Iterator[Span]:
    at, low = text.find("@"), 0
    while at >= 0:
        start = low + len(text[low:at].rstrip(LOCAL_PART))
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        low = found.end() if found else at + 1
        at = text.find("@", low)


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in (m[0].partition(".")[0].lstrip("0") or "0", *(x.lstrip("0") or "0" for x in m.groups()))):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[Span]:
    for head in IBAN_HEAD.finditer(text):
        length = IBAN_LENGTH.get(head[1])
        m = IBAN_BODY[length].match(text, head.start()) if length else None
        if m and mod97(re.sub("[ -]", "", m[0])):
            yield m.span()


def short_cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 15 and digits[0] in "3456" and luhn(digits):
            yield m.span()


def local_phones(text: str) -> Iterator[Span]:
    for m in LOCAL_PHONE.finditer(text):
        if 7 <= len(_digits(m[0])) <= 12:
            yield m.span()


def ssns(text: str) -> Iterator[Span]:
    for m in SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def ipv6s(text: str) -> Iterator[Span]:
    for m in IPV6.finditer(text):
        try:
            if int(ipaddress.IPv6Address(m[0])) > 1:
                yield m.span()
        except ValueError:
            pass


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {
    "email": emails, "ip": ips, "card": cards, "phone": phones,
    "iban": ibans, "short_card": short_cards, "local_phone": local_phones, "ssn": ssns, "ipv6": ipv6s,
}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The score of a confirmed proposal, from its kind and the words around it."""
    before = [w.lower() for w in WORD.findall(text[max(0, start - BEFORE) : start])]
    near = {*before, *(w.lower() for w in WORD.findall(text[end : end + AFTER]))}
    value = PRIOR[kind] + RAISE * bool(near & CONTEXT[kind]) - LOWER * bool(PLAIN & {*before[-CLOSE:]})
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Kind, start, end (exclusive) and score of all personal data of a text, by kind as in KINDS, then start.

    All confirmed base proposals stay. A proposal of another kind stays if its score reaches ``threshold`` and it
    overlaps no base span and no better proposal; of equal ones the first stays.
    """
    text = text or ""
    base = [(kind, *span, score(text, kind, *span)) for kind in BASE for span in FINDERS[kind](text)]
    more = [(kind, *span, score(text, kind, *span)) for kind in ADDED for span in FINDERS[kind](text)]
    more = sorted((x for x in more if x[3] >= threshold), key=lambda x: (-x[3], x[1], KINDS.index(x[0])))
    return base + sorted(_apart(base, more), key=lambda x: (KINDS.index(x[0]), x[1]))


def _apart(base: list[tuple], more: list[tuple]) -> list[tuple]:
    """Those of ``more``, taken in order, that overlap nothing of ``base`` and nothing taken before."""
    if not more:
        return []
    taken = np.zeros(max(x[2] for x in base + more), dtype=bool)
    for _, start, end, _ in base:
        taken[start:end] = True
    kept = []
    for x in more:
        if not taken[x[1] : x[2]].any():
            taken[x[1] : x[2]] = True
            kept.append(x)
    return kept


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Personal data of every whole text: ``id_col, spans``.

    ``spans`` is an array of ``struct<kind, start, end, score>`` by kind as in KINDS, then start, counted in code
    points with an exclusive end. One narrow pass: one row per input row, equal rows give equal results, null ids
    stay. A null text is empty and has no spans. A very long text is read whole, one at a time. Where proposals of
    added kinds overlap, the better score stays, then the earlier start, then the earlier kind. An empty table
    gives an empty one; other columns are ignored.
    """
    shape = "array<struct<kind:string,start:long,end:long,score:double>>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in text_chunks(batch.column(1)):
                found = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in find(t, threshold)] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(found, span)], ["id", "spans"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans {shape}").withColumnRenamed("id", id_col)


def redact(text: str | None, threshold: float = THRESHOLD) -> str | None:
    """The text with every span replaced by its kind in brackets; where spans overlap, the first kind stands for all."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e, _ in find(text, threshold)):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
