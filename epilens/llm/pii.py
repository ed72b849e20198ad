"""Personal data: patterns propose, checksums confirm, context words weigh.

Base kinds (fixed patterns, leftmost and non-overlapping for each kind):
email; ip, each part at most 255; card, 16 to 19 digits passing Luhn; phone,
8 to 15 digits. A match that fails its test is dropped without another try.
Added kinds: iban, as long as its country's are (else ending at any word,
longest first) and confirmed by mod 97; short_card, 13 to 15 digits passing
Luhn, which stays only if context lifts its score to `threshold`.

A span's score starts from its kind's prior; a checksum lifts it, and so does
each kind-specific word within `NEAR` characters, the nearer the more; words
that speak of order numbers and the like lower it. Base spans always stay.

Cases: null or empty text has no spans; offsets are code points, end
exclusive; scans are linear in the text, also in long runs of digits or of
address characters; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilens.llm.common import ship

NEAR = 48
BASE = ("email", "ip", "card", "phone")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "short_card": 0.3}
CONTEXT = {
    "email": ("mail", "contact", "write", "correo"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "amex", "credit", "karte", "carte", "tarjeta"),
}
AGAINST = ("order", "invoice", "version", "isbn", "tracking", "serial")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_WORD_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
#: Characters of an IBAN by country.
IBAN_LENGTH = {
    c: n
    for n, countries in {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items()
    for c in countries.split()
}
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern would match, but each local part is read once, backwards from its @."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            end = max(end, at)
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            yield m.span()


def numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """card and short_card spans that pass Luhn."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card" if len(digits) >= 16 else "short_card", *m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _IBAN.search(text, at):
        # A proposal holds at most 64 characters, and the next may begin within one that fails.
        at = m.start() + 1
        for end in sorted((e.start() for e in _WORD_END.finditer(text, m.start(), m.end() + 1) if e.start() <= m.end()), reverse=True):
            code = text[m.start() : end].replace(" ", "")
            if len(code) == IBAN_LENGTH.get(code[:2], len(code)) and len(code) >= 15 and mod97(code):
                yield m.start(), end
                at = end
                break


def score(text: str, kind: str, start: int, end: int) -> float:
    s = PRIOR[kind]
    for m in _WORD.finditer(text, max(0, start - NEAR), min(len(text), end + NEAR)):
        gap = start - m.end() if m.end() <= start else m.start() - end
        if gap < 0:
            continue
        word, weight = m[0].lower(), 1 - gap / (2 * NEAR)
        if word in CONTEXT[kind]:
            s += 0.3 * weight
        elif word in AGAINST:
            s -= 0.3 * weight
    return round(min(1.0, max(0.0, s)), 4)


def spans_of(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in order of kind, then start."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        found += [("ip", *s) for s in ips(text)]
        found += sorted(numbers(text), key=lambda x: x[0])
        found += [("phone", *s) for s in phones(text)] if "+" in text else []
        found += [("iban", *s) for s in ibans(text)]
    scored = [(k, a, b, score(text, k, a, b)) for k, a, b in found]
    kinds = {k: i for i, k in enumerate((*BASE, "iban", "short_card"))}
    return sorted((s for s in scored if s[0] in BASE or s[3] >= threshold), key=lambda s: (kinds[s[0]], s[1]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _find(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in spans_of(t.as_py() or "", threshold)] for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _SPANS)], ["doc_id", "found"])

    return run


def find_pii(spark: SparkSession, docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, found: array of (kind, start, end, score) in order of kind and start, for every row."""
    ship(spark)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(_find(threshold), "doc_id long, found array<struct<kind:string,start:long,end:long,score:double>>")


def pii_digest(found: DataFrame) -> DataFrame:
    """Counts and joined spans of each document."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", name), ",").alias("spans"))
