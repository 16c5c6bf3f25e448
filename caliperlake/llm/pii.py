"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds: email, ip, card (Luhn) and phone hold by their pattern and check alone; iban (mod-97) needs its
checksum; national_id needs a context word nearby to reach the threshold.

Defined results: a null text has no spans; ties cannot occur, as spans of a kind never overlap; repeated
rows each get their row; an empty table gives an empty table; other columns are ignored by
``find_pii`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id")
THRESHOLD, WINDOW = 0.5, 60
#: Score of a pattern alone, of one that its checksum confirms, and what a context word adds.
PATTERN_ONLY, CONFIRMED, CONTEXT = 0.3, 0.6, 0.3
CONTEXT_WORDS = {
    "email": ("email", "mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social security", "sozialversicherung", "dni"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these can only start where a run of digits starts; saying so keeps long digit runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 "
    "LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()
}
_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_ANY_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, one look at each @ and each character before it, so linear in the text."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        end = None
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        floor = end or at + 1
        at = text.find("@", floor)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed IBANs, leftmost first.  Words and numbers that follow may look like further groups, so every group border is a
    possible end: the one at the country's length first, then the others from the longest.  A start has at most 34 characters, so linear in the text."""
    at = 0
    while m := _IBAN.search(text, at):
        s, ends, n = m.start(), [], 0
        for k in range(s, m.end()):
            n += text[k] != " "
            if n >= 15 and text[k] != " " and not (k + 1 < len(text) and text[k + 1].isascii() and text[k + 1].isalnum()):
                ends.append((n == _IBAN_LENGTHS.get(text[s : s + 2]), n, k + 1))
        at = next((e for _, _, e in sorted(ends, reverse=True) if mod97(text[s:e].replace(" ", ""))), None)
        if at:
            yield s, at
        at = at or s + 1


def _good_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in s.split("."))


def _good_card(s: str) -> bool:
    d = _NOT_DIGIT.sub("", s)
    return 13 <= len(d) <= 19 and luhn(d)


def _good_phone(s: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", s)) <= 15


def _context(kind: str, text: str, start: int, end: int) -> bool:
    near = text[max(0, start - WINDOW) : end + WINDOW].lower()
    return any(re.search(rf"\b{w}\b", near) for w in CONTEXT_WORDS[kind])


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, by kind and then start; scores below the threshold are left out."""
    if not text:
        return []
    found: list[tuple[str, int, int, float]] = []

    def keep(kind: str, start: int, end: int, confirmed: bool) -> None:
        score = (CONFIRMED if confirmed else PATTERN_ONLY) + CONTEXT * _context(kind, text, start, end)
        if score >= THRESHOLD:
            found.append((kind, start, end, round(score, 6)))

    for s, e in _emails(text):
        keep("email", s, e, True)
    if not _ANY_DIGIT.search(text):
        return found
    for kind, pattern, good in (("ip", _IP, _good_ip), ("card", _CARD, _good_card), ("phone", _PHONE, _good_phone)):
        for m in pattern.finditer(text):
            if good(m[0]):
                keep(kind, m.start(), m.end(), True)
    for s, e in _ibans(text):
        keep("iban", s, e, True)
    for m in _NATIONAL.finditer(text):
        keep("national_id", m.start(), m.end(), False)
    return found


_DIGEST_FIELDS = [("doc_id", None), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.string())]


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        counts, shas, every, scores = {k: [] for k in BASE}, [], [], []
        for text in b.column(1).to_pylist():
            found = spans_of(text)
            for k in BASE:
                counts[k].append(sum(f[0] == k for f in found))
            said = [(k, f"{k}:{s}:{e}") for k, s, e, _ in found]
            shas.append(hashlib.sha256(",".join(x for k, x in said if k in BASE).encode()).hexdigest())
            every.append(",".join(x for _, x in said))
            scores.append(",".join(f"{score:.2f}" for *_, score in found))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(shas, pa.string()), pa.array(every, pa.string()), pa.array(scores, pa.string())], [n for n, _ in _DIGEST_FIELDS])


def pii_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, all spans and their scores in the same order."""
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = base.mapInArrow(_digest, f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE) + ", base_sha256 string, spans string, scores string")
    return out.withColumnRenamed("doc_id", id_col)


def find_pii(text: Column) -> Column:
    """Spans of a text column, for use in any select."""
    found = F.pandas_udf(lambda s: s.map(lambda t: [{"kind": k, "start": b, "end": e, "score": v} for k, b, e, v in spans_of(t)]), "array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return found(text)


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text:
        return text
    out, at = [], 0
    for kind, s, e, _ in sorted(spans_of(text), key=lambda f: (f[1], -f[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(text: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(redacted), "string")(text)
