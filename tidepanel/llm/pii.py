"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs before a digit, digits, digits before a dot, URL schemes and identifier
cues. From each anchor a local parser of its kind expands to both sides, decides where the value starts and ends, and validates
it (octets, Luhn, digit counts, IBAN check digits). Within a kind spans are leftmost and do not overlap; a candidate that fails
validation is passed over as a whole.

Kinds, in this order: email, ip, card, phone (the base), and url, iban, account. Offsets are code points, ends exclusive.
Null texts count as empty and have no spans. Repeated rows are searched each. An empty table gives no rows. Texts are searched whole.
Spans of different kinds may overlap; redaction replaces spans that overlap as one, under the kind of the first of them.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import sparing

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://")
CUES = tuple(form for cue in ("iban", "account", "acct", "konto", "cuenta", "compte", "routing", "passport") for form in (cue, cue.upper(), cue.capitalize()))

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\x00-\x20<>\"'|]*)?")
IBAN = re.compile(r"[\x20:#.-]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"(?:[\x20]?(?:number|no|nr|id))?[\x20:#.=-]{1,4}([A-Z]{0,2}[0-9](?:[\x20-]?[0-9]){5,16})(?![0-9A-Za-z])", re.I)


@functools.lru_cache(1)
def anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in [
        ("@", "email"),
        *[(d, "card") for d in DIGITS],
        *[(d + ".", "ip") for d in DIGITS],
        *[("+" + d, "phone") for d in DIGITS],
        *[(s, "url") for s in SCHEMES],
        *[(c, "cue") for c in CUES],
    ]:
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def octet(digits: str) -> bool:
    """At most 255, however many zeros lead."""
    digits = digits.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _start(text: str, at: int, least: int, inside) -> int:
    """Where the run of characters of `inside` that ends before `at` begins, not before `least`."""
    while at > least and text[at - 1] in inside:
        at -= 1
    return at


def find(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end), ordered by kind as in KINDS, then start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)
    for end, (kind, size) in anchors().iter(text):
        at = end + 1 - size
        if kind == "card":
            if at >= past["card"] and (m := CARD.match(text, at)):
                past["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif kind == "ip":
            if at >= past["ip"] and (m := IP.match(text, _start(text, at, past["ip"], DIGITS))):
                past["ip"] = m.end()
                if all(map(octet, m[0].split("."))):
                    spans["ip"].append(m.span())
        elif kind == "email":
            if at >= past["email"] and (first := _start(text, at, past["email"], LOCAL)) < at and (m := DOMAIN.match(text, at)):
                past["email"] = m.end()
                spans["email"].append((first, m.end()))
        elif kind == "phone":
            if at >= past["phone"] and (m := PHONE.match(text, at)):
                past["phone"] = m.end()
                if 8 <= sum(c in DIGITS for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif kind == "url":
            if at >= past["url"] and (m := URL.match(text, end + 1)):
                stop = end + 1 + len(m[0].rstrip(".,;:!?)-"))
                past["url"] = m.end()
                if stop > end + 1:
                    spans["url"].append((at, stop))
        else:
            if (at == 0 or not text[at - 1].isalnum()) and (m := IBAN.match(text, end + 1)) and m.start(1) >= past["iban"] and iban_valid(m[1]):
                past["iban"] = m.end(1)
                spans["iban"].append(m.span(1))
            elif (at == 0 or not text[at - 1].isalnum()) and (m := ACCOUNT.match(text, end + 1)) and m.start(1) >= past["account"]:
                past["account"] = m.end(1)
                spans["account"].append(m.span(1))
    return [(k, a, b) for k in KINDS for a, b in spans[k]]


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, and spans that overlap as one, replaced by the kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _run(docs: DataFrame, text: str, result, schema: str, rows: int = 1000) -> DataFrame:
    """row (the other columns of docs as a struct, and whether the text is null) and what `result` makes of the texts."""
    others = [F.col(c) for c in docs.columns if c != text]
    row = F.struct(F.struct(F.lit(None).cast("string").alias("none") if not others else others[0], *others[1:]).alias("others"), F.col(text).isNull().alias("null"))
    given = docs.select(row.alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    fields = StructType.fromDDL(schema).fields
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), *result(part.column(1).to_pylist())], names=["row", *names])

    return given.mapInArrow(sparing(run), StructType([given.schema["row"], *fields]))


def search(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end)."""

    def result(texts: list[str]):
        return [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in texts], _ARROW_SPANS)]

    return _run(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", result, f"spans {SPANS}").select("row.others.doc_id", "spans")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in their texts replaced; null texts stay null; same columns."""

    def result(texts: list[str]):
        return [pa.array([redacted(t, found) if (found := find(t)) else t for t in texts], pa.string())]

    out = _run(docs, text, result, "clean string")
    body = F.when(~F.col("row")["null"], F.col("clean"))
    return out.select(*[(body if c == text else F.col("row")["others"][c]).alias(c) for c in docs.columns])


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
