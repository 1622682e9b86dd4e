"""Secret scan: keyword automaton, anchored patterns near hits, checksums.

One Aho-Corasick automaton reads the lower-cased text once and reports where a keyword
stands. Patterns are not searched for: each is tried at the places of its own keyword
only. What a pattern accepts is then checked by the checksum that its format embeds,
where it has one. Runs of hex digits have no keyword; they are found by their alphabet.

Kinds, in the order that breaks ties of one start:

- ``assign``: a password, secret, token or key that is assigned a value of 6+ characters
- ``access``: ``AKIA`` and capitals or digits, 20+ characters
- ``hex``: 24+ hex digits in lower case
- ``vcs``: ``ghp_``, ``gho_``, ``ghu_``, ``ghs_``, ``ghr_`` and ``npm_`` tokens of 36
  characters whose last six are the CRC-32 of the rest in base 62
- ``card``: a payment card number near a card word, with a right Luhn digit
- ``iban``: an account number whose remainder by 97 is 1

The first three are the base rules: leftmost matches that do not overlap within their
kind, short ones dropped after they have taken their place. The method's kinds add spans
and never remove one. Positions are code points, ends exclusive. A document is read by
one task as a whole, whatever its length; nothing is shuffled.

Nulls: a null text is empty and has no spans; a null id stays null. Copies are answered
row by row. Extra columns stay; columns named like the operator's own are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

KINDS = ("assign", "access", "hex", "vcs", "card", "iban")
BASE = KINDS[:3]

# Keywords (lower case) by kind. The patterns are tried at the hits.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "vcs": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "card": ("card", "visa", "mastercard", "cc:", "cvv"),
    "iban": ("iban",),
}
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_VCS = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])")
# A number within 40 characters after its word.
_CARD = re.compile(r"[^0-9]{0,40}?(?<![0-9])([0-9](?:[ -]?[0-9]){12,18})(?![0-9])")
_IBAN = re.compile(r"[^A-Z0-9]{0,10}?([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(65, 91)}  # code points keep their places

SPANS = "spans array<struct<kind: string, start: int, end: int>>"


@cache
def _automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            machine.add_word(w, (kind, len(w)))
    machine.make_automaton()
    return machine


def crc_ok(body: str, check: str) -> bool:
    """The six base-62 digits are the CRC-32 of the body."""
    n = 0
    for c in check:
        n = n * 62 + _BASE62.index(c)
    return n == zlib.crc32(body.encode())


def luhn_ok(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    twice = [d * 2 - 9 * (d > 4) for d in digits[-2::-2]]
    return 13 <= len(digits) <= 19 and any(digits) and (sum(twice) + sum(digits[-1::-2])) % 10 == 0


def mod97_ok(account: str) -> bool:
    a = account.replace(" ", "")
    return 15 <= len(a) <= 34 and int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of one text, by start and then kind."""
    found: list[tuple[str, int, int]] = [("hex", *m.span()) for m in _HEX.finditer(text)]
    # A keyword that ends later may start earlier, so hits are put in order of their start.
    hits: dict[str, list[int]] = {}
    for last, (kind, size) in _automaton().iter(text.translate(_LOWER)):
        hits.setdefault(kind, []).append(last - size + 1)
    for kind, places in hits.items():
        taken = 0
        for at in sorted(set(places)):
            if at < taken:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(text, at):
                    taken = m.end()
                    if m.end(2) - m.start(2) >= 6:
                        found.append((kind, *m.span()))
            elif kind == "access":
                if m := _ACCESS.match(text, at):
                    taken = m.end()
                    if m.end() - at >= 20:
                        found.append((kind, *m.span()))
            elif kind == "vcs":
                if (m := _VCS.match(text, at)) and crc_ok(m[1], m[2]):
                    taken = m.end()
                    found.append((kind, *m.span()))
            elif kind == "card":
                if (m := _CARD.match(text, at + 2)) and luhn_ok(m[1]):
                    taken = m.end()
                    found.append((kind, *m.span(1)))
            elif (m := _IBAN.match(text, at + 4)) and (end := _account_end(m)):
                taken = end
                found.append((kind, m.start(1), end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _account_end(m: re.Match) -> int:
    """Words in capitals may follow an account number: the longest valid group of it."""
    body, end = m[1], len(m[1])
    while end >= 15:
        if mod97_ok(body[:end]):
            return m.start(1) + end
        end = body.rfind(" ", 0, end)
    return 0


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans of every text."""
    kept = docs.drop("spans")
    at = kept.columns.index(text)
    out = StructType(kept.schema.fields + StructType.fromDDL(SPANS).fields)
    kind = to_arrow_schema(StructType.fromDDL(SPANS)).field(0).type

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [
                [{"kind": k, "start": a, "end": b} for k, a, b in scan(value or "")]
                for value in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], names=out.names)

    return kept.mapInArrow(probe, out)


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their digest, and all spans as text."""

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        key, *map(count, BASE), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )


def mask(found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``find`` with every span replaced; overlapping spans become one mark."""
    at, spans_at = found.columns.index(text), found.columns.index("spans")

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [
                None if value is None else masked(value, [(s["start"], s["end"]) for s in spans], mark)
                for value, spans in zip(batch.column(at).to_pylist(), batch.column(spans_at).to_pylist())
            ]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return found.mapInArrow(hide, found.schema)


def masked(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    parts, done = [], 0
    for start, end in sorted(spans):
        if start >= done:
            parts += [text[done:start], mark]
        done = max(done, end)
    return "".join([*parts, text[done:]])
