"""Secret scan: known formats, and entropy windows over candidate strings.

A candidate is a run of 20 or more characters from the alphabets that keys are
written in.  Within it every window of 20 characters gets its Shannon entropy,
kept up to date as the window slides: one count falls, one rises, and the sum of
c*log2(c) follows.  Each class of characters (hexadecimal, alphanumeric,
base64) has its own limit, and the class is that of the window: hexadecimal stretches
of a candidate are held against their own limit whatever stands around them.  Windows at or above the limit join into spans.  The
allow-list suppresses windows found by entropy, never spans of a known format: those that
overlap a match, and for words such as EXAMPLE also those that begin or end within WINDOW characters of it.

Cases: null and empty texts have no spans; very long texts are scanned whole, in
one pass; repeated rows get equal answers; an empty table gives an empty result;
further columns pass through, and one named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import aside, back
from tessera.llm.textblock import whole_text

#: The base formats.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # 18 characters or more
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HEX_CLASS = re.compile(r"[0-9A-Fa-f]+\Z")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{20,}")
ALNUM_CLASS = re.compile(r"[0-9A-Za-z]+\Z")
#: Bits per character that a window of each class must reach.
LIMITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.7}
#: What looks random but is public or a placeholder.
ALLOW = (
    re.compile(r"EXAMPLE|example|sample|placeholder|changeme|your[-_]?(key|token|secret)", re.I),
    re.compile(r"(.)\1{7}"),
    re.compile(r"0123456789|abcdefghij|ABCDEFGHIJ"),
    re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z", re.I),
)
#: Of these, the first names its whole neighbourhood a placeholder; the others only stand for themselves.
REACH = (WINDOW, 0, 0, 0)
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def char_class(s: str) -> str:
    return "hex" if HEX_CLASS.match(s) else "alnum" if ALNUM_CLASS.match(s) else "base64"


def entropy_windows(s: str, limit: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Merged [start, end) of windows of ``width`` characters with ``limit`` bits or more."""
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, ch in enumerate(s):
        if i >= width:
            old = s[i - width]
            c = counts[old]
            total += _C_LOG_C[c - 1] - _C_LOG_C[c]
            counts[old] = c - 1
        c = counts.get(ch, 0)
        total += _C_LOG_C[c + 1] - _C_LOG_C[c]
        counts[ch] = c + 1
        if i >= width - 1 and math.log2(width) - total / width >= limit - 1e-9:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = i + 1
            else:
                spans.append([start, i + 1])
    return [tuple(x) for x in spans]


def _like_key(s: str) -> bool:
    return any(ch.isdigit() for ch in s) and any(ch.isalpha() for ch in s)  # a long word or number is no key


def allowed_parts(s: str) -> Iterator[tuple[int, int]]:
    """[start, end) of the parts of a candidate that no match of the allow-list reaches."""
    blocked = sorted((m.start() - reach, m.end() + reach) for p, reach in zip(ALLOW, REACH, strict=True) for m in p.finditer(s))
    at = 0
    for a, b in [*blocked, (len(s), len(s))]:
        if a - at >= WINDOW:
            yield at, a
        at = max(at, b)


def entropy_spans(text: str) -> Iterator[tuple[int, int]]:
    for m in CANDIDATE.finditer(text):
        if not _like_key(m[0]):
            continue
        for lo, hi in allowed_parts(m[0]):
            s = m[0][lo:hi]
            if not _like_key(s):
                continue
            found = entropy_windows(s, LIMITS[char_class(s)])
            if char_class(s) != "hex":
                for h in HEX_RUN.finditer(s):
                    if _like_key(h[0]):
                        found += [(h.start() + a, h.start() + b) for a, b in entropy_windows(h[0], LIMITS["hex"])]
            end = None
            for a, b in sorted(found):
                if end is not None and a <= end:
                    end = max(end, b)
                    continue
                if end is not None:
                    yield m.start() + lo + start, m.start() + lo + end
                start, end = a, b
            if end is not None:
                yield m.start() + lo + start, m.start() + lo + end


def scan(text: str) -> tuple[int, int, int, str, str, int]:
    """(n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of one text."""
    low = text if ("=" in text or ":" in text) else ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(low) if len(m[2]) >= MIN_VALUE]
    n_assign = len(base)
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    n_access = len(base) - n_assign
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    n_hex = len(base) - n_assign - n_access
    extra = []
    ordered = sorted((s, e) for s, _, e in base)
    reach, joined = -1, []
    for s, e in ordered:
        if s > reach:
            joined.append([s, e])
        else:
            joined[-1][1] = max(e, joined[-1][1])
        reach = joined[-1][1]
    at = 0
    for s, e in entropy_spans(text):
        while at < len(joined) and joined[at][1] < e:
            at += 1
        if not (at < len(joined) and joined[at][0] <= s):
            extra.append((s, 3, e))
    say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    said = say(base)
    return n_assign, n_access, n_hex, hashlib.sha256(said.encode()).hexdigest(), say(base + extra) if extra else said, len(extra)


def find_secrets(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts, digest and all spans (code points, end exclusive) for each document; narrow, no shuffle."""
    names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            cols = list(zip(*found, strict=True)) if found else [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, cols, types)], names=[*keep, *names])

    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema], "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], whole_text().alias("__text")).mapInArrow(run, schema)


def redact(docs: DataFrame, mask: str = "<secret>") -> DataFrame:
    """The documents with every found span replaced by ``mask``."""

    def masked(text: str, spans: str) -> str:
        out, at = [], 0
        for part in sorted((int(s), int(e)) for _, s, e in (x.split(":") for x in spans.split(",") if x)):
            if part[1] <= at:
                continue
            if part[0] >= at:
                out += [text[at : part[0]], mask]
            at = part[1]
        return "".join(out) + text[at:]

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else masked(t, s) for t, s in zip(texts, spans, strict=True)])

    hidden = aside(docs, "text")
    i = docs.columns.index("text")
    found = find_secrets(hidden)
    return back(found.withColumn(f"__d{i}", F.pandas_udf(run, "string")("text", "spans")), docs)
