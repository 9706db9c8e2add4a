"""Secrets in text: named patterns, and strings too random to be words."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import as_batch, small_batches, text_of

SCHEMA = "doc_id long, secrets array<struct<kind: string, start: long, end: long, entropy: double>>"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "api")
BASE = ("assign", "access", "hex")
#: Candidate strings for the entropy test; one letter class alone is a word, not a secret.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits per character that a window must reach, by the character class of the candidate.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
#: Never secrets: identifiers with public structure, paths, placeholders, one character over and over.
ALLOWED = re.compile(r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|sample|placeholder|x{6,}|0{8,}|^[0-9_=+/-]+$|^(/[a-z]+)+/?$|^[a-z]+([-_/][a-z]+)*$")


def char_class(s: str) -> str:
    if re.fullmatch(r"[0-9a-fA-F]+", s):
        return "hex"
    return "alnum" if s.isalnum() else "base64"


def window_entropy(s: str, width: int) -> float:
    """The largest Shannon entropy (bits a character) of any window of ``width``
    characters; each step takes one character out of the counts and one in."""
    width = min(width, len(s))
    if not width:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2(c)
    best = 0.0
    f = [0.0] + [c * log2(c) for c in range(1, width + 2)]
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += f[n + 1] - f[n]
        if i >= width:
            old = s[i - width]
            n = counts[old]
            counts[old] = n - 1
            total += f[n - 1] - f[n]
        if i >= width - 1:
            best = max(best, log2(width) - total / width)
    return best


def scan(text: str, width: int, thresholds: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, entropy), by start, then base kinds as listed, then the rest."""
    out = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        out += [("assign", m.start(), m.end(), window_entropy(m[2], width)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), window_entropy(m[0], width)) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), window_entropy(m[0], width)) for m in HEX.finditer(text)]
    # the base spans as disjoint stretches, in order: one search settles whether a candidate meets any
    covered: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b, _ in out):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    ends = [b for _, b in covered]
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isalpha() for c in s)) or ALLOWED.search(s):
            continue
        k = bisect_right(ends, m.start())
        if k < len(covered) and covered[k][0] < m.end():
            continue
        e = window_entropy(s, width)
        if e >= thresholds[char_class(s)]:
            out.append(("entropy", m.start(), m.end(), e))
    rank = {k: i for i, k in enumerate((*BASE, "entropy"))}
    return sorted(out, key=lambda x: (x[1], rank[x[0]], x[2]))


def _scanner(width: int, thresholds: dict[str, float], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text", 8 << 20):
            rows = [[dict(zip(("kind", "start", "end", "entropy"), x, strict=True)) for x in scan(t, width, thresholds)] for t in b.column("text").to_pylist()]
            yield as_batch(schema, [b.column("doc_id"), rows])

    return run


def find_secrets(docs: DataFrame, width: int = 20, thresholds: dict[str, float] | None = None) -> DataFrame:
    """doc_id and ``secrets`` of every row of ``docs`` (doc_id, text).

    Base spans are what the three patterns match.  ``entropy`` spans are other
    strings of 20 characters or more, with letters and digits, one window of
    which reaches the threshold of its character class and which the allow list
    does not know; none overlaps a base span.  Positions count code points, end
    exclusive.  A null or empty text has none; repeated rows are scanned each; a
    null doc_id stays null; a long text takes time in proportion to its length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_scanner(width, THRESHOLDS | (thresholds or {}), schema), SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans of ``find_secrets``."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(F.array_join(F.transform(base, label), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("secrets", label), ",").alias("spans"))
