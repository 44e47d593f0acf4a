"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds with a pattern of their own (`BASE`) are always reported. Further kinds (`MORE`) are reported when their score, raised
by a checksum and by words that stand near, reaches `ACCEPT`. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shared import grouped, mapped, without

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "secret")
ACCEPT = 0.6
#: Characters before and after a span in which context words count.
NEAR = 48
#: What a kind scores by its pattern, what a passed check adds, what a context word adds.
SCORES = {
    "email": (0.8, 0.0, 0.15), "ip": (0.5, 0.2, 0.2), "card": (0.4, 0.45, 0.15), "phone": (0.6, 0.1, 0.2),
    "iban": (0.2, 0.6, 0.2), "ssn": (0.3, 0.1, 0.4), "secret": (0.4, 0.1, 0.4),
}
CONTEXT = {
    "email": r"e-?mail|mail|contact|write|address", "ip": r"ip|host|server|address|client", "card": r"card|credit|visa|mastercard|payment|carte|karte|tarjeta",
    "phone": r"phone|tel|call|mobile|fax|cell", "iban": r"iban|account|bank|konto|compte|cuenta", "ssn": r"ssn|social|security|insurance", "secret": r"token|secret|api[ _-]?key|passw(?:or)?d|bearer|auth",
}
CONTEXT_RE = {k: re.compile(rf"(?<![a-z])(?:{v})(?![a-z])", re.I) for k, v in CONTEXT.items()}
ORDER = {k: i for i, k in enumerate(BASE + MORE)}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is taken whole: what follows it decides, so no start inside it can match where the first doesn't.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VG": 24, "XK": 20,
}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z_/+-]*[0-9])(?:[0-9a-fA-F]{32,128}|[A-Za-z0-9+/_-]{24,128}={0,2})(?![A-Za-z0-9+/_=-])")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The check digit of payment cards."""
    total = sum(map(int, digits[-1::-2])) + sum(d if d < 10 else d - 9 for d in (2 * int(x) for x in digits[-2::-2]))
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check digits of an IBAN."""
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain. The local part never holds an @, so each @ has one candidate: the whole run before it."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    """Accounts as long as their country's are, whatever capitals or digits follow a space, and whether their check digits hold."""
    for m in IBAN.finditer(text):
        length, end = IBAN_LENGTHS.get(m[0][:2], 0), m.start()
        for _ in range(length):
            end += text[end : end + 1] == " "
            end += 1
        if length and end <= m.end() and not text[end : end + 1].isalnum():
            yield m.start(), end, mod97(text[m.start() : end].replace(" ", ""))


def near(kind: str, text: str, start: int, end: int) -> bool:
    return bool(CONTEXT_RE[kind].search(text, max(0, start - NEAR), start) or CONTEXT_RE[kind].search(text, end, end + NEAR))


def spans(text: str | None) -> list[Span]:
    """All spans by start, kind and end. No text has none."""
    if not text:
        return []
    found: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        found += [("email", s, e, True) for s, e in emails(text)]
    if any(c in text for c in "0123456789"):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span(), True))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span(), True))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span(), True))
        found += [("iban", *x) for x in ibans(text)]
        found += [("ssn", *m.span(), True) for m in SSN.finditer(text)]
        found += [("secret", *m.span(), len(set(m[0])) >= 8) for m in SECRET.finditer(text)]
    out = []
    for kind, s, e, passed in found:
        base, check, word = SCORES[kind]
        score = min(1.0, base + check * passed + word * near(kind, text, s, e))
        if kind in BASE or (passed and score >= ACCEPT):
            out.append(Span(kind, s, e, round(score, 3)))
    return sorted(out, key=lambda x: (x.start, ORDER[x.kind], x.end))


def masked(text: str, found: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind."""
    out, done = [], 0
    for x in found:
        if x.start >= done:
            out += [text[done : x.start], f"[{x.kind.upper()}]"]
        done = max(done, x.end)
    return "".join(out) + text[done:]


def with_spans(df: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """df with its spans. One row out for each row in; null and empty texts have none; a column of that name is replaced."""
    return _mapped(df, text, {out: SPAN}, lambda texts: [[[x._asdict() for x in spans(t)] for t in texts]])


def redacted(df: DataFrame, text: str = "text", out: str = "pii_kinds") -> DataFrame:
    """df with its spans masked in the text (null stays null, empty stays empty), and the kinds that were found, one entry for each
    span. One row out for each row in, repeated rows too; an empty table gives an empty result."""

    def run(texts: list[str | None]) -> list[list]:
        each = [spans(t) for t in texts]
        return [[masked(t, s) if s else t for t, s in zip(texts, each, strict=True)], [[x.kind for x in s] for s in each]]

    return _mapped(df, text, {text: T.StringType(), out: T.ArrayType(T.StringType())}, run)


def _mapped(df: DataFrame, text: str, added: dict[str, T.DataType], run) -> DataFrame:
    df = without(df, [k for k in added if k != text])
    fields = {f.name: f for f in df.schema.fields} | {k: T.StructField(k, v) for k, v in added.items()}
    schema, at = T.StructType(list(fields.values())), df.columns.index(text)
    from pyspark.sql.pandas.types import to_arrow_type

    types = {k: to_arrow_type(v) for k, v in added.items()}

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grouped(batch, at):
                new = [pa.array(x, t) for x, t in zip(run(part.column(at).to_pylist()), types.values(), strict=True)]
                columns = dict(zip(part.schema.names, part.columns, strict=True)) | dict(zip(types, new, strict=True))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return mapped(df, go, schema)
