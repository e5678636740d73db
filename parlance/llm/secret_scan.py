"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class.

Three patterns give the base spans. The method adds to them: a candidate is a run of ``window`` or
more characters of ``[A-Za-z0-9+/_.=-]``. A window slides over it; counts of characters and of
classes change by one character in and one out, and with them the window's entropy. A window is hot
if its entropy reaches the threshold of the narrowest class that holds all its characters (hex,
one-case letters with digits, or the base64 alphabet) and it mixes letters with digits. Overlapping
hot windows merge into one span. Candidates that an allow-list pattern matches as a whole (UUIDs,
host names and paths, dates, placeholders) are suppressed; base spans never are.

Every document is judged alone, without a shuffle. Cases: a null text counts as empty and has no
spans. Repeated rows are judged alike. Very long texts are scanned whole, in linear time. An empty
table gives an empty result. Only the id and text columns are read, so others cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so a run of 16 is a match of 16
LEAST_VALUE, LEAST_ACCESS = 12, 18
WINDOW = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{WINDOW},}}")
#: Least entropy of a window, in bits a character, by class.
THRESHOLDS = {"hex": 3.0, "one_case": 3.6, "base64": 3.8}
#: Candidates that are no secrets, matched as a whole.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}(/[A-Za-z0-9_.=/-]*)?",
    r"\d{4}-\d{2}-\d{2}([T_-][0-9.-]*)?",
    r"(?i:.*(example|placeholder|changeme|xxxx).*)",
)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches that are long enough."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


_LOWER, _UPPER, _DIGIT, _HEX_LOWER, _HEX_UPPER, _OTHER = range(6)


def _class(c: str) -> int:
    if c.isdigit():
        return _DIGIT
    if c.islower():
        return _HEX_LOWER if c <= "f" else _LOWER
    if c.isupper():
        return _HEX_UPPER if c <= "F" else _UPPER
    return _OTHER


_CLASS = {chr(c): _class(chr(c)) for c in range(128)}


def hot_windows(candidate: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy reaches their class's threshold."""
    weight = [0.0, *[c * math.log2(c) for c in range(1, window + 1)]]
    whole = math.log2(window)
    counts: dict[str, int] = {}
    classes = [0] * 6
    spread, out = 0.0, []  # spread: the sum of c * log2(c) over characters
    for k, char in enumerate(candidate):
        c = counts.get(char, 0)
        spread += weight[c + 1] - weight[c]
        counts[char] = c + 1
        classes[_CLASS[char]] += 1
        if k >= window:
            gone = candidate[k - window]
            c = counts[gone]
            spread += weight[c - 1] - weight[c]
            counts[gone] = c - 1
            classes[_CLASS[gone]] -= 1
        if k < window - 1 or not classes[_DIGIT] or classes[_DIGIT] + classes[_OTHER] == window:
            continue
        lower, upper = classes[_LOWER] + classes[_HEX_LOWER], classes[_UPPER] + classes[_HEX_UPPER]
        if not classes[_OTHER] and not classes[_LOWER] and not classes[_UPPER] and not (lower and upper):
            kind = "hex"
        elif not classes[_OTHER] and not (lower and upper):
            kind = "one_case"
        else:
            kind = "base64"
        if whole - spread / window >= thresholds[kind]:
            start = k - window + 1
            if out and out[-1][1] >= start:
                out[-1] = (out[-1][0], k + 1)
            else:
                out.append((start, k + 1))
    return out


def entropy_spans(text: str, allowed: re.Pattern) -> list[tuple[int, str, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        candidate = m.group()
        if not candidate.isalpha() and not allowed.fullmatch(candidate):
            out += [(m.start() + a, "entropy", m.start() + b) for a, b in hot_windows(candidate)]
    return out


def scan_text(text: str | None, allowed: re.Pattern | None = None) -> list[tuple[int, str, int]]:
    """All spans by start, then kind."""
    if not text:
        return []
    found = base_spans(text) + entropy_spans(text, allowed or re.compile("|".join(ALLOWED)))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """Returns id_col and spans, an array of (kind, start, end) in code points, end exclusive."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField("id", source.schema["id"].dataType), T.StructField("spans", T.ArrayType(span))])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{x})" for x in allowed) or r"(?!)")
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in scan_text(x.as_py(), allow)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    return source.mapInArrow(run, schema).withColumnRenamed("id", id_col)
