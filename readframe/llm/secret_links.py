"""Secret scan: patterns that stand alone, and weak parts that count only next to their complements."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns that stand alone, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")

IDENTIFIER = re.compile(r"""(?:client|account|app|user|login|key)[_-]?(?:id|name)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.ASCII | re.IGNORECASE)
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"(?:https?|ftp|amqps?|postgres(?:ql)?|mysql|mongodb|redis|s3)://[^\s\"'<>]+", re.ASCII)
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")
MIN_ENTROPY = 3.5

Span = tuple[int, int, str]  # start, end, kind


def strong_spans(text: str) -> list[Span]:
    """Spans of the patterns that stand alone; each pattern is matched from left to right without overlap."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= MIN_ASSIGNED]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def linked_spans(text: str, strong: list[Span], reach: int) -> list[Span]:
    """Weak identifiers, secrets and endpoints whose complementary parts stand in the same scope.

    The scope of a part reaches ``reach`` code points beyond both of its ends, but not over a blank line.  An identifier
    needs a secret in its scope, a secret needs an identifier, an endpoint needs both.  Strong parts complement weak ones:
    access keys are identifiers, assigned and hexadecimal values are secrets.
    """
    taken = Intervals([(a, b) for a, b, _ in strong])
    weak = {
        "identifier": [m.span() for m in IDENTIFIER.finditer(text)],
        "secret": [m.span() for m in OPAQUE.finditer(text) if _opaque(m[0])],
        "endpoint": [m.span() for m in ENDPOINT.finditer(text)],
    }
    weak = {kind: [s for s in spans if not taken.meets(*s)] for kind, spans in weak.items()}
    if not any(weak.values()):
        return []
    walls = [m.start() for m in BLANK_LINE.finditer(text)]

    def scoped(spans):
        """Spans moved apart by more than any reach for each blank line before them, so that no scope crosses one."""
        return [(a + s, b + s) for a, b in spans for s in [bisect_left(walls, a) * (2 * reach + 2)]]

    identifiers = Intervals(scoped(weak["identifier"] + [(a, b) for a, b, k in strong if k == "access"]))
    secrets = Intervals(scoped(weak["secret"] + [(a, b) for a, b, k in strong if k != "access"]))
    needs = {"identifier": [secrets], "secret": [identifiers], "endpoint": [identifiers, secrets]}
    return [
        (a, b, kind)
        for kind, spans in weak.items()
        for (a, b), (c, d) in zip(spans, scoped(spans), strict=True)
        if all(other.meets(c - reach, d + reach) for other in needs[kind])
    ]


class Intervals:
    """Intervals in order of their starts, to be asked which ranges meet one of them."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = []  # largest end so far
        for _, b in spans:
            self.ends.append(max(b, self.ends[-1]) if self.ends else b)

    def meets(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before > 0 and self.ends[before - 1] > start


def _opaque(token: str) -> bool:
    """Whether a token looks drawn at random: letters of both cases, digits and high entropy."""
    if not (re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token)):
        return False
    counts = Counter(token).values()
    return -sum(n / len(token) * math.log2(n / len(token)) for n in counts) >= MIN_ENTROPY


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def _text_of(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(text: str | None, reach: int) -> tuple[list[Span], list[Span]]:
    """Strong spans, and all spans, of one text."""
    strong = strong_spans(text or "")
    return strong, sorted(strong + linked_spans(text or "", strong, reach), key=_order)


def find_secrets(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Secrets of every document: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked).

    ``spans`` lists kind:start:end in code points, end exclusive, by start.  Parts are linked inside one document by a
    merge of sorted intervals, so a document costs n log n of its parts and nothing is shuffled.

    Null or empty text: no spans.  Null or repeated doc_id: one row for each input row.  Equal starts: by kind, as listed.
    Further columns are ignored.  No rows: no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                strong, spans = scan(text, reach)
                n = Counter(kind for _, _, kind in strong)
                base = hashlib.sha256(_text_of(strong).encode()).hexdigest()
                out.append((doc_id, n["assign"], n["access"], n["hex"], base, _text_of(spans), len(spans) - len(strong)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types, strict=True)], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]
    schema = f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    types = [pa.int32() if id_type == "int" else pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return docs.select("doc_id", "text").mapInArrow(rows, schema)


def redacted(text: str, reach: int) -> str:
    """The text with each stretch that spans cover replaced by the kind of its first span."""
    out, at = [], 0
    for a, b, kind in scan(text, reach)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Documents with their secrets replaced by ``[kind]``; all columns stay, and n_chars, if there, is made anew."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: None if t is None else redacted(t, reach))

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
