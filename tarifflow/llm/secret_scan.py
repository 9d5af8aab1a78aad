"""Secret scans: fixed patterns plus sliding-window Shannon entropy per character class.

Entropy is kept by incremental counts while a window slides over candidate strings:
with counts n_c of a window of w characters, H = log2(w) - sum(n_c log2 n_c)/w, so one
step changes two terms.  Allow-listed parts of candidates (addresses, repeated or
sequential filler, plain words) are not reported, what is joined to them is; matches of
the fixed patterns always stay.

Defined results: null and empty texts have no spans.  Repeated rows give repeated
results.  Extra columns are carried through `scan` and may be named like the results,
except that a result column replaces an input column of its name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import pieces

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KEY_PARTS = ("passw", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: character class -> (members, bits that a window must reach by its size)
CLASSES = {
    "entropy_hex": (frozenset("0123456789abcdefABCDEF"), {24: 3.1, 16: 2.6}),
    "entropy_base64": (frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), {24: 3.9, 16: 3.0}),
}
SHORTEST = 16
#: Parts of candidates: filler, paths, and what stands between / = _ - and is a plain word or starts like an address or example.
ALLOWED = re.compile(r"(.)\1{5,}|(?i:0123456789|abcdefghij|/[a-z]+/[a-z]+(?=/))|(?:^|(?<=[/=_-]))(?:(?i:https?|www|file|example|placeholder|changeme|lorem)[^/=_-]*|[A-Z]?[a-z]{4,}|[A-Z]{4,})(?:[/=_-]+|$)")
#: Words in camel case; more of the letters are in them, and more are vowels, than in keys.
WORDS, WORDY, VOWELS = re.compile("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), 0.8, 0.27
KINDS = ("assign", "access", "hex", *CLASSES)
_RANK = {k: i for i, k in enumerate(KINDS)}
#: A window at the bar counts, whatever rounding its counts went through.
ROUNDING = 1e-9
_LOGS = [0.0, *(n * math.log2(n) for n in range(1, 129))]


def window_spans(text: str, members: frozenset, window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Maximal unions of windows within runs of `members` whose entropy reaches `bits`."""
    run: list[str] = []
    counts: dict[str, int] = {}
    total, open_at, open_to = 0.0, -1, -1
    for i, c in enumerate(text):
        if c not in members:
            run, counts, total = [], {}, 0.0
            continue
        run.append(c)
        n = counts.get(c, 0)
        total += _LOGS[n + 1] - _LOGS[n]
        counts[c] = n + 1
        if len(run) > window:
            old = run[-window - 1]
            n = counts[old]
            total += _LOGS[n - 1] - _LOGS[n]
            counts[old] = n - 1
        if len(run) >= window and math.log2(window) - total / window >= bits - ROUNDING:
            start = i - window + 1
            if open_at >= 0 and start > open_to:
                yield open_at, open_to
                open_at = -1
            open_at = start if open_at < 0 else open_at
            open_to = i + 1
    if open_at >= 0:
        yield open_at, open_to


def mixed(text: str) -> bool:
    """Keys mix digits or cases within their letters; words and numbers don't."""
    digits, letters = sum(c.isdigit() for c in text), sum(c.isalpha() for c in text)
    if digits >= 3 or not letters:
        return letters > 0
    if text.upper() == text or text.lower() == text:
        return digits > 0
    return sum(len(w) for w in WORDS.findall(text)) <= WORDY * letters or sum(c in "aeiouAEIOU" for c in text) < VOWELS * letters


def parts(word: str) -> Iterator[tuple[int, str]]:
    """(start, text) of what the allow-list leaves of a candidate."""
    at = 0
    for m in ALLOWED.finditer(word):
        yield at, word[at : m.start()]
        at = m.end()
    yield at, word[at:]


def entropy_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of a class's windows of all sizes, joined where they overlap."""
    for kind, (members, sizes) in CLASSES.items():
        a, b = 0, 0
        for start, end in sorted(s for window, bits in sizes.items() for s in window_spans(text, members, window, bits)):
            if start > b and b:
                yield kind, a, b
            a, b = (a if b and start <= b else start), max(b, end)
        if b:
            yield kind, a, b


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) in code points, by start and then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(part in low for part in KEY_PARTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        for at, part in parts(m.group()):
            if len(part) < SHORTEST or not mixed(part):
                continue
            for kind, a, b in entropy_spans(part):
                if mixed(part[a:b]):
                    found.append((kind, m.start() + at + a, m.start() + at + b))
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """The text with each union of overlapping spans replaced by `mark`."""
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(df: DataFrame, text: str = "text", spans: str = "secret_spans", redacted: str | None = None) -> DataFrame:
    """`df` with the spans of each text as an array of (kind, start, end), and the redacted text if asked for."""
    new = {spans: SPANS} | ({redacted: T.StringType()} if redacted else {})
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *(T.StructField(k, v) for k, v in new.items())])

    def run(batches):
        for batch in (p for b in batches for p in pieces(b, b.schema.get_field_index(text))):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [spans_of(t) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            columns.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found], kind))
            if redacted:
                columns.append(pa.array([redact(t, s) for t, s in zip(texts, found)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)


DIGEST = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def digest(scanned: DataFrame, spans: str = "secret_spans") -> DataFrame:
    """Per document: counts and digest of the fixed patterns' spans, and all spans joined."""

    def run(batches):
        for batch in batches:
            rows = [[(s["kind"], s["start"], s["end"]) for s in r] for r in batch.column(1).to_pylist()]
            base = [[s for s in r if s[0] in ("assign", "access", "hex")] for r in rows]
            columns = [batch.column(0), *(pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in ("assign", "access", "hex"))]
            columns += [pa.array([hashlib.sha256(joined(r).encode()).hexdigest() for r in base], pa.string()), pa.array([joined(r) for r in rows], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scanned.select("doc_id", spans).mapInArrow(run, DIGEST)
