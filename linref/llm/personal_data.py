"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds whose matches always count; the others are found besides, where their score is enough.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "local_phone", "national_id")
#: Letters before and after a span whose words count.
NEARBY = 60
ENOUGH = 0.5
SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs are taken whole (possessive), and never from their middle: a match there would be one from the run's start too. So no text is scanned twice.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])")
_NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[^\W\d_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


@dataclass(frozen=True)
class Rule:
    """A kind's score without words nearby, and the words that raise and lower it by WEIGHT."""

    score: float
    more: frozenset
    less: frozenset = frozenset()


WEIGHT = 0.3
_NO = frozenset("order invoice item model version ref reference isbn serial sku part ticket".split())
RULES = {
    "email": Rule(0.9, frozenset("mail email contact write".split())),
    "ip": Rule(0.7, frozenset("ip address host server client".split()), frozenset("version release section".split())),
    "card": Rule(0.8, frozenset("card credit debit visa mastercard payment pay".split()), _NO),
    "phone": Rule(0.8, frozenset("phone tel telephone call mobile fax cell".split()), _NO),
    "iban": Rule(0.9, frozenset("iban account bank transfer konto compte cuenta".split())),
    "short_card": Rule(0.3, frozenset("card credit debit visa amex mastercard payment".split()), _NO),
    "local_phone": Rule(0.3, frozenset("phone tel telephone call mobile fax cell".split()), _NO),
    "national_id": Rule(0.3, frozenset("ssn social security insurance".split()), _NO),
}


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others: every second one from the right is doubled, its digits added up."""
    back = digits[::-1]
    odd = sum(map(int, back[::2]))
    even = sum(2 * int(d) - 9 * (d > "4") for d in back[1::2])
    return (odd + even) % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number's check digits hold: its first four letters last, letters as 10 to 35, the remainder by 97 is 1."""
    rest = 0
    for c in code[4:] + code[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    past = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > past and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            past = m.end()
            yield start, past


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int, str]]:
    """Of the longest runs of digits with single spaces or hyphens between, those of 13 to 19 that Luhn's sum confirms."""
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.start(), m.end(), digits


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


def _score(text: str, kind: str, start: int, end: int) -> float:
    rule = RULES[kind]
    near = {w.lower() for w in _WORD.findall(text, max(0, start - NEARBY), start)} | {w.lower() for w in _WORD.findall(text, end, min(len(text), end + NEARBY))}
    return round(min(1.0, max(0.0, rule.score + WEIGHT * bool(near & rule.more) - WEIGHT * bool(near & rule.less))), 2)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) in code points, end exclusive: by kind, in the order of KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] += _emails(text)
    if "." in text:
        found["ip"] += _ips(text)
    for start, end, digits in _cards(text):
        if len(digits) >= 16:
            found["card"].append((start, end))
        elif digits[0] in "3456":
            found["short_card"].append((start, end))
    if "+" in text:
        found["phone"] += _phones(text)
    found["iban"] += [m.span() for m in _IBAN.finditer(text) if mod97(m.group().replace(" ", ""))]
    if "-" in text or "." in text:
        found["local_phone"] += [m.span() for m in _LOCAL_PHONE.finditer(text)]
        found["national_id"] += [m.span() for m in _NATIONAL_ID.finditer(text) if m.group()[:3] not in ("000", "666") and m.group()[0] != "9" and m.group()[4:6] != "00" and m.group()[7:] != "0000"]
    out = [(kind, start, end, _score(text, kind, start, end)) for kind in BASE for start, end in found[kind]]
    taken: list[tuple[int, int]] = []  # apart from each other, in order
    for start, end in sorted((s, e) for _, s, e, _ in out):
        if taken and start < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(end, taken[-1][1]))
        else:
            taken.append((start, end))
    for kind in KINDS[len(BASE):]:
        for start, end in found[kind]:
            at = bisect_left(taken, (start, end))
            free = (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0])
            if free and (score := _score(text, kind, start, end)) >= ENOUGH:
                out.append((kind, start, end, score))
                taken.insert(at, (start, end))
    return out


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find(t)] for t in (v.as_py() or "" for v in batch.column("text"))]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind)], ["key", "spans"])


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans) of every row: array of (kind, start, end, score) in code points, end exclusive, by kind, then start.

    email, ip, card (16 to 19 digits, Luhn) and phone are the longest leftmost matches of their patterns that hold, whatever their score. Besides them,
    where words nearby bring the score to ENOUGH: iban (mod 97), short_card (13 to 15 digits, Luhn), local_phone, national_id; these overlap
    nothing else. Null or empty texts have no spans, a null key stays null, repeated rows are rows of their own, an empty table gives no rows;
    other columns are ignored. Each text is read whole, in time that grows with its length; nothing is shuffled."""
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_found, f"key long, spans {SPANS}").withColumnRenamed("key", key)


def masked(text: Column, spans: Column) -> Column:
    """The text with the kind in angle brackets in the place of each span; a span that overlaps one before it is covered by that one's mark."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["done"], gap, mark).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int"))))


def digest(df: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the four base kinds, and all spans as text."""
    found = personal_data(df)
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
