"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Base kinds, leftmost and without overlap within a kind: email, ip (parts at most 255), card (14 to
19 digits that pass Luhn) and phone (10 to 15 digits after a plus). A proposal that fails its test is
dropped, without another try inside it. Their score is at least THRESHOLD, so all are reported.

Added kinds: iban (as long as its country says, mod 97; tried at each possible start), card13 (13 digits that pass Luhn), ssn (ddd-dd-dddd) and local_phone
(a number without a plus) and secret. Each starts from the score in ADDED, gains CONTEXT_GAIN if one of its context
words stands within CONTEXT_CHARS code points before it or half as many after it, and is reported from THRESHOLD on.
A secret is a run of SECRET_CHARS or more letters, digits and the signs of base64, or several joined by single dots as in signed tokens, that holds
letters and digits and at least SECRET_BITS bits of entropy a character; only its context tells it from other codes. An added span that overlaps a base span, or one of an added kind that is listed before its own, is left out.

The patterns are anchored so that each scans a text once, also texts of one long run of digits
or letters. Positions are code points, the end exclusive.

Defined results: null and empty texts have no spans; very long texts are scanned whole; repeated rows
are answered one by one; an empty table gives an empty result; other columns are carried through, but for one named pii, which is replaced.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.common import map_batches, sha256_hex, table

BASE = ("email", "ip", "card", "phone")
ORDER = {k: i for i, k in enumerate((*BASE, "iban", "card13", "ssn", "local_phone", "secret"))}
THRESHOLD, CONTEXT_GAIN, CONTEXT_CHARS = 0.5, 0.35, 60
#: Kind -> score of a confirmed proposal without context.
ADDED = {"iban": 0.9, "card13": 0.3, "ssn": 0.3, "local_phone": 0.2, "secret": 0.3}
#: Least characters of a secret (of each part between dots), and its least entropy in bits a character.
SECRET_CHARS, SECRET_BITS = 16, 3.0
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7}
CONTEXT = {
    "email": "mail email contact write correo courriel",
    "ip": "ip host server address network",
    "card": "card credit debit visa mastercard amex payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile cell fax contact telefon telefono telefon",
    "iban": "iban account bank transfer konto compte cuenta",
    "card13": "card credit debit visa payment karte carte tarjeta",
    "ssn": "ssn social security taxpayer",
    "local_phone": "phone tel telephone call mobile cell fax telefon telefono",
    "secret": "token secret key apikey password passwd pwd auth authorization bearer credential credentials signature",
}
#: Length of an IBAN by country.
IBAN_LENGTH = dict(
    x.split(":")
    for x in "AD:24 AE:23 AT:20 BE:16 BG:22 CH:21 CY:28 CZ:24 DE:22 DK:18 EE:20 ES:24 FI:18 FR:27 GB:22 GR:27 HR:21 HU:28 IE:22 IL:23 IS:26 IT:27 LI:21 LT:20 LU:20 LV:21 MC:27 MT:31 NL:18 NO:15 PL:28 PT:25 RO:24 SA:24 SE:24 SI:19 SK:24 SM:27 TR:26".split()
)

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = {k: re.compile(rf"(?: ?[A-Z0-9]){{{int(n) - 4}}}(?![A-Za-z0-9])") for k, n in IBAN_LENGTH.items()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_SECRET = re.compile(rf"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{{{SECRET_CHARS},}}+(?:\.[A-Za-z0-9_+/-]{{{SECRET_CHARS},}}+)*+")
_WORD = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])) % 10 == 0


def mod97(text: str) -> bool:
    """ISO 13616: the first four characters go last, letters become 10 to 35."""
    text = text.replace(" ", "")
    return IBAN_LENGTH.get(text[:2]) == str(len(text)) and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.get(m[0][:2])
        if rest and m.start() >= done and (end := rest.match(text, m.end())) and mod97(text[m.start() : end.end()]):
            done = end.end()
            yield m.start(), done


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From sign to sign: the part before it runs back over its characters, at most to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        end = _DOMAIN.match(text, at + 1) if start < at else None
        if end:
            yield start, end.end()
            done = end.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        # A part's length is tested first: int() refuses very long digit strings.
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def in_context(text: str, start: int, end: int, kind: str) -> bool:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS // 2]
    return not set(CONTEXT[kind].split()).isdisjoint(w.lower() for w in _WORD.findall(near))


def is_secret(run: str) -> bool:
    if run.isalpha() or not any(map(str.isalpha, run)) or not any(map(str.isdigit, run)):
        return False
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= SECRET_BITS


def proposals(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The confirmed proposals of each added kind, in the order of the kinds."""
    yield [(a, b, "iban") for a, b in ibans(text)]
    yield [(*m.span(), "card13") for m in _CARD.finditer(text) if len(m[0]) >= 13 and len(d := m[0].replace(" ", "").replace("-", "")) == 13 and luhn(d)]
    yield [(*m.span(), "ssn") for m in _SSN.finditer(text)]
    yield [(*m.span(), "local_phone") for m in _LOCAL_PHONE.finditer(text)]
    yield [(*m.span(), "secret") for m in _SECRET.finditer(text) if is_secret(m[0])]


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, apart from each other and ascending."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def scored_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str, float]]:
    """Base spans and the added ones that reach THRESHOLD, with their scores, in the same order."""
    score = lambda a, b, kind, least: min(1.0, least + CONTEXT_GAIN * in_context(text, a, b, kind))
    out = [(a, b, k, score(a, b, k, BASE_SCORE[k])) for a, b, k in base]
    if _DIGIT.search(text):
        for found in proposals(text):  # spans of one kind do not overlap each other
            if found:
                starts, ends = merged([s[:2] for s in out])
                # Of the stretches that begin before b the last one ends last.
                free = [(a, b, k) for a, b, k in found if not (i := bisect_left(starts, b)) or ends[i - 1] <= a]
                out += [(a, b, k, s) for a, b, k in free if (s := score(a, b, k, ADDED[k])) >= THRESHOLD]
    return sorted(out, key=lambda s: (s[0], ORDER[s[2]]))


def find_pii(docs: DataFrame) -> DataFrame:
    """The documents with pii, array<struct<kind, start, end, score, text>>."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for text in batch.column("text"):
            text = text.as_py() or ""
            found.append([{"kind": k, "start": a, "end": b, "score": s, "text": text[a:b]} for a, b, k, s in scored_spans(text, base_spans(text))])
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("text", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "pii"])

    return map_batches(docs, run, "pii array<struct<kind:string,start:int,end:int,score:double,text:string>>")


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract, n_added (spans of added kinds) and top_score (null without spans), from the operator's spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    counts = [F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]  # noqa: B023
    added = (F.size(spans) - F.size(base)).cast("long").alias("n_added")
    top = F.array_max(F.transform(spans, lambda s: s["score"])).alias("top_score")
    return found.select("doc_id", *counts, sha256_hex(listed(base)).alias("base_sha256"), listed(spans).alias("spans"), added, top)
