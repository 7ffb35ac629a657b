"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

A null or empty text has no spans. Every span counts its offsets in code points of
the whole text, end exclusive. Rows are mapped one by one, so repeated rows give
repeated results and an empty table an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from paneloom.llm.rows import per_row
from paneloom.llm.spans import Covered

BASE_KINDS = ["email", "ip", "card", "phone"]
ADDED_KINDS = ["iban", "local_phone", "ssn"]
KINDS = BASE_KINDS + ADDED_KINDS
SPANS = ArrayType(StructType([
    StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()),
    StructField("value", StringType()), StructField("base", BooleanType()), StructField("score", DoubleType())]))

# Prior score of a kind, and the words that speak for it nearby.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "local_phone": 0.4, "ssn": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
    "card": ("card", "credit", "debit", "visa", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"), "local_phone": ("phone", "tel", "call", "mobile", "fax"),
    "ssn": ("ssn", "social", "security"),
}
CHECKSUM_GAIN, CONTEXT_GAIN = 0.4, 0.2

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive, and tried at the start of a run of digits only: the same matches without a quadratic search.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# Characters of an account number by country; others are tried at every length.
_IBAN_LENGTHS = {country: int(n) for n, countries in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC 33:RU").split())
    for country in countries.split(",")}
_LOCAL_PHONE = re.compile(r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20-][0-9]{3}-[0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NO_DIGITS = str.maketrans("", "", " ().-+")
_DIGITS = b"0123456789"
_WORDS = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(account: str) -> bool:
    """The check digits of an account number with a country code."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str | None):
    """(kind, start, end) of the four base kinds, leftmost and non-overlapping within a kind."""
    if not text:
        return []
    out = [("email", *span) for span in _emails(text)] if "@" in text else []
    raw = text.encode()
    if len(raw.translate(None, _DIGITS)) == len(raw):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].translate(_NO_DIGITS)
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
            if 9 <= len(m[0].translate(_NO_DIGITS)) <= 15]
    return out


def _accounts(text: str):
    """(start, end) of account numbers whose check digits hold, leftmost and non-overlapping.

    What follows a number can look like a part of it, so every end before a blank is tried: first the one that
    gives the length of the country, then the longest. Without a valid end the search goes on at the next character.
    """
    found = _IBAN.search(text)
    while found:
        start, stop = found.span()
        ends = [stop] + [at for at in range(stop - 1, start, -1) if text[at] == " "]
        known = _IBAN_LENGTHS.get(text[start:start + 2])
        numbers = [(end, text[start:end].replace(" ", "")) for end in ends]
        numbers = [(end, number) for end, number in numbers if len(number) >= 15]
        numbers.sort(key=lambda x: len(x[1]) != known)
        end = next((end for end, number in numbers if mod97(number)), None)
        if end is not None:
            yield start, end
        found = _IBAN.search(text, start + 1 if end is None else end)


def _proposals(text: str):
    """(kind, its spans from left to right, confirmed by a checksum) of the kinds beyond the base, in the order of their claims."""
    yield "iban", _accounts(text), True
    yield "local_phone", (m.span() for m in _LOCAL_PHONE.finditer(text)), False
    yield "ssn", (m.span() for m in _SSN.finditer(text)), False


def _score(text: str, kind: str, start: int, end: int, confirmed: bool, reach: int) -> float:
    near = text[max(0, start - reach):start] + " " + text[end:end + reach]
    spoken = not set(_WORDS.findall(near.lower())).isdisjoint(CONTEXT[kind])
    return min(1.0, PRIOR[kind] + CHECKSUM_GAIN * confirmed + CONTEXT_GAIN * spoken)


def personal_data(text: str | None, reach: int = 40, least: float = 0.6) -> list[tuple]:
    """All spans of a text; a span beyond the base needs `least` and must not overlap an earlier one."""
    base = base_spans(text)
    out = [(k, s, e, text[s:e], True, _score(text, k, s, e, k == "card", reach)) for k, s, e in base]
    if not text or len(text.encode().translate(None, _DIGITS)) == len(text.encode()):
        return out
    held = Covered((s, e) for _, s, e in base)
    for kind, proposed, confirmed in _proposals(text):
        own = []  # spans of one kind do not overlap
        for start, end in proposed:
            if not held.meets(start, end) and (score := _score(text, kind, start, end, confirmed, reach)) >= least:
                own.append((start, end))
                out.append((kind, start, end, text[start:end], False, score))
        held.add(own)
    return out


def find_personal_data(docs: DataFrame, text: str = "text", into: str = "pii", keep: list[str] | None = None,
                       reach: int = 40, least: float = 0.6) -> DataFrame:
    """`docs` with the spans of `text` in the column `into`: kind, start, end, value, base, score."""
    names = [f.name for f in SPANS.elementType]

    def start():
        return lambda value: ([dict(zip(names, span)) for span in personal_data(value, reach, least)],)

    return per_row(docs, [text], {into: SPANS}, start, keep)


def joined(spans: Column, kinds: list[str], by_start: bool = False) -> Column:
    """kind:start:end of the spans, comma-joined; by kind as listed, then start, or by start first."""
    order = F.array(*[F.lit(k) for k in kinds])
    rank = lambda x: F.array_position(order, x["kind"])
    keys = F.array_sort(F.transform(spans, lambda x: (
        F.struct(x["start"].alias("a"), rank(x).alias("b"), x["end"].alias("c"), x["kind"].alias("k"), x["start"].alias("s"))
        if by_start else
        F.struct(rank(x).cast("bigint").alias("a"), x["start"].alias("b"), x["end"].alias("c"), x["kind"].alias("k"), x["start"].alias("s")))))
    return F.array_join(F.transform(keys, lambda x: F.concat_ws(":", x["k"], x["s"], x["c"])), ",")


def digest(docs: DataFrame, kinds: list[str], base: list[str], by_start: bool, spans: str) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as a string."""
    own = F.filter(spans, lambda x: x["base"])
    of_kind = lambda k: F.size(F.filter(own, lambda x: x["kind"] == k)).cast("bigint")
    counts = [of_kind(k).alias(f"n_{k}") for k in base]
    return docs.select("doc_id", *counts, F.sha2(joined(own, kinds, by_start), 256).alias("base_sha256"),
                       joined(F.col(spans), kinds, by_start).alias("spans"))
