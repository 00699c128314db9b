"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are leftmost non-overlapping matches of
their pattern that pass their check: parts up to 255, 13 to 19 digits with a valid Luhn
sum, 9 to 15 digits. A match that fails is dropped and its characters are not tried
again. Further kinds are proposed by weaker patterns:

* ``iban``: the length of its country and remainder 1 by 97;
* ``secret``: 16 or more letters and digits mixed, sure by itself only as an access key id;
* ``ssn`` and ``local_phone``: digit groups that mean nothing without a word that says so.

Every span starts with the score of its kind (``START``) and gains ``NEARBY`` when a
context word of the kind stands within ``REACH`` characters. Base spans stay whatever their
score; the others stay from ``KEEP`` on, unless they overlap a base span.

Each text is read whole, in time linear in its length (no pattern is tried again
inside a run it has failed on). Rows are independent: no shuffle, nothing is collected.

Nulls and edge cases: a null or empty text has no spans; positions are code points, the end
is exclusive; repeated rows and ids give equal rows, one for each; a column named like an
output is replaced only in the result, which has the columns stated here.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shotline.llm.common import long_texts, sliced

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret", "ssn", "local_phone")
START = {
    "email": 0.9,
    "ip": 0.6,
    "card": 0.8,
    "phone": 0.6,
    "iban": 0.9,
    "secret": 0.3,
    "ssn": 0.3,
    "local_phone": 0.3,
}
ACCESS_KEY = 0.9
NEARBY, REACH, KEEP = 0.4, 24, 0.5
#: Letters that make a context word, per kind; case does not matter for A-Z.
CONTEXT = {
    "email": ("mail", "contact", "correo"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobil", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "secret": ("password", "passwd", "pwd", "token", "secret", "api key", "api_key", "apikey", "credential", "bearer"),
    "ssn": ("ssn", "social security"),
    "local_phone": ("phone", "tel", "call", "mobil", "fax"),
}
# Characters of an IBAN by country, as the registry states them.
IBAN_LENGTH = {
    "AT": 20,
    "BE": 16,
    "BG": 22,
    "CH": 21,
    "CY": 28,
    "CZ": 24,
    "DE": 22,
    "DK": 18,
    "EE": 20,
    "ES": 24,
    "FI": 18,
    "FR": 27,
    "GB": 22,
    "GR": 27,
    "HR": 21,
    "HU": 28,
    "IE": 22,
    "IS": 26,
    "IT": 27,
    "LI": 21,
    "LT": 20,
    "LU": 20,
    "LV": 21,
    "MT": 31,
    "NL": 18,
    "NO": 15,
    "PL": 28,
    "PT": 25,
    "RO": 24,
    "SE": 24,
    "SI": 19,
    "SK": 24,
}

#: The proposing patterns, as stated; ``_proposed`` searches them without repeated attempts.
PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{4}){2,7}( [A-Z0-9]{1,3})?)",
    "secret": r"[A-Za-z0-9]{16,}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
}


def context_pattern(kind: str) -> str:
    """The kind's context words as one pattern that takes A-Z for a-z and nothing else."""
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    return "|".join(map(letters, CONTEXT[kind]))


LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is never entered in its middle: a match takes it whole, a failure fails for its rest too.
SEARCH = {
    "ip": re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": re.compile(PATTERN["phone"]),
    "iban": re.compile(PATTERN["iban"]),
    "secret": re.compile(r"[A-Za-z0-9]{16,}+"),
    "ssn": re.compile(PATTERN["ssn"]),
    "local_phone": re.compile(PATTERN["local_phone"]),
}
DIGIT = re.compile("[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")
KEY_ID = re.compile("AKIA[0-9A-Z]{16}")
NEAR = {kind: re.compile(context_pattern(kind)) for kind in KINDS}


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled and summed by digits, makes a multiple of ten."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(letters: str) -> int:
    """Remainder by 97 of an IBAN: its first four characters last, letters as 10 to 35."""
    rest = 0
    for c in letters[4:] + letters[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over the local part and on over the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            free = match.end()
            yield start, free
        at = text.find("@", at + 1)


def _confirmed(kind: str, text: str, start: int, end: int) -> int:
    """Where the span ends if its check holds, else -1."""
    found = text[start:end]
    if kind == "ip":
        parts = [p.lstrip("0") for p in found.split(".")]
        return end if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts) else -1
    if kind == "card":
        digits = NOT_DIGITS.sub("", found)
        return end if 13 <= len(digits) <= 19 and luhn(digits) else -1
    if kind == "phone":
        return end if 9 <= len(NOT_DIGITS.sub("", found)) <= 15 else -1
    if kind == "iban":
        size = IBAN_LENGTH.get(found[:2], 99)
        letters = found.replace(" ", "")
        if len(letters) < size or mod97(letters[:size]) != 1:
            return -1
        for place, c in enumerate(found):
            size -= c != " "
            if not size:
                return start + place + 1
    if kind == "secret":
        digits = DIGIT.search(found) is not None
        return end if digits and not found.isdigit() else -1
    if kind in ("ssn", "local_phone"):
        around = text[max(0, start - 1) : start] + text[end : end + 1]
        return -1 if DIGIT.search(around) or "-" in around else end
    return end


def _proposed(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind == "email":
        yield from _emails(text)
    elif kind != "phone" or "+" in text:
        for match in SEARCH[kind].finditer(text):
            yield match.span()


class Taken:
    """The spans found so far, asked whether another one meets any of them."""

    def __init__(self, spans: list[tuple[str, int, int, float]]):
        self.starts = sorted(s[1] for s in spans)
        self.reach = list(accumulate((s[2] for s in sorted(spans, key=lambda s: s[1])), max))

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.reach[before - 1] > start


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as listed, then start."""
    out: list[tuple[str, int, int, float]] = []
    if not text:
        return out
    taken = Taken([])
    kinds = KINDS if DIGIT.search(text) else ("email",) if "@" in text else ()
    for kind in kinds:
        for start, stop in _proposed(kind, text):
            end = _confirmed(kind, text, start, stop)
            if end < 0:
                continue
            score = ACCESS_KEY if kind == "secret" and KEY_ID.fullmatch(text, start, end) else START[kind]
            if NEAR[kind].search(text[max(0, start - REACH) : start]) or NEAR[kind].search(text[end : end + REACH]):
                score = min(1.0, score + NEARBY)
            if kind not in BASE and (score < KEEP or taken.meets(start, end)):
                continue
            out.append((kind, start, end, round(score, 3)))
        if kind == BASE[-1]:
            taken = Taken(out)
    return out


SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("score", T.DoubleType()),
    ]
)


@F.arrow_udf(T.ArrayType(SPAN))
def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The spans of each text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = ("kind", "start", "end", "score")
    for column in batches:
        found = [[dict(zip(names, s)) for s in spans_of(t.as_py())] for t in column]
        yield pa.array(found, kind)


def masked_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in angle brackets, overlapping spans by the first one's."""
    out, at = [], 0
    for kind, start, end, _ in sorted(spans_of(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return text if not out else "".join(out) + text[at:]


@F.arrow_udf(T.StringType())
def masked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The masked texts."""
    for column in batches:
        yield pa.array([masked_text(t.as_py()) for t in column], pa.string())


def find(docs: DataFrame) -> DataFrame:
    """doc_id and found (array of kind, start, end, score), one row per document."""
    return long_texts(docs).select("doc_id", spans("text").alias("found"))


def masked_documents(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked; all other columns stay."""
    return long_texts(docs).withColumn("text", masked("text"))


def written(found: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of base spans, all spans, and the scores in the same order."""
    of = F.col("found")
    count = lambda kind: F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long")
    return find(docs).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(written(F.filter(of, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        written(of).alias("spans"),
        F.concat_ws(",", F.transform(of, lambda s: F.format_number(s["score"], 1))).alias("scores"),
    )
