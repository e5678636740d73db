"""JSON arrays of objects, read by byte ranges.

A file is cut into ranges wherever they end. Whether a range begins within a string, and how deep, depends
on all bytes before it; but what a range does to that state does not: a first job scans every range once for
each state it might begin in (outside of strings, within one, after a backslash within one) and returns where
that leads. Chained up, a row per range, this tells where each range really begins. The second job reads the
objects that begin within its range, the last one beyond the range's end, and parses them by the schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_BYTES = 32 << 20
OUTSIDE, WITHIN, ESCAPED = range(3)
#: A string that ends, one that does not, or a bracket.
_TOKEN = re.compile(rb'"(?:[^"\\]|\\.)*"|"|[\[\]{}]', re.S)
_REST = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)
_TAIL = re.compile(rb"(?:[^\\]|\\.)*(\\?)\Z", re.S)


def tokens(data: bytes, state: int) -> Iterator[tuple[int, int]]:
    """(position, byte) of the brackets outside of strings; at last (-1, the state at the end)."""
    at = 0
    if state != OUTSIDE:
        if state == ESCAPED and not data:
            yield -1, ESCAPED
            return
        end = _REST.match(data, 1 if state == ESCAPED else 0)
        if end is None:
            yield -1, ESCAPED if _TAIL.match(data, 1 if state == ESCAPED else 0)[1] else WITHIN
            return
        at = end.end()
    for found in _TOKEN.finditer(data, at):
        text = found[0]
        if text == b'"':  # a string without an end here
            yield -1, ESCAPED if _TAIL.match(data, found.end())[1] else WITHIN
            return
        if len(text) == 1:
            yield found.start(), text[0]
    yield -1, OUTSIDE


def effect(data: bytes, state: int) -> tuple[int, int]:
    """(change of depth, state at the end)."""
    depth, end = 0, OUTSIDE
    for at, byte in tokens(data, state):
        if at < 0:
            end = byte
        else:
            depth += 1 if byte in b"[{" else -1
    return depth, end


def objects(read, first: int, last: int, size: int, state: int, depth: int) -> Iterator[bytes]:
    """The array's objects that begin at [first, last). read(from, to): bytes of the file."""
    data, begin, stop, moved = read(first, last), None, last, False
    while True:
        level, begin, moved = depth, None, False
        for at, byte in tokens(data, state):
            if at < 0:
                break
            if byte in b"[{":
                if level == 1 and byte == 0x7B and first + at < last:
                    begin = at
                level += 1
            else:
                level -= 1
                if level == 1 and begin is not None:
                    yield data[begin : at + 1]
                    done, begin, moved = at + 1, None, True
                    if first + done >= last:
                        return
        if begin is None or stop >= size:
            return
        # an object goes on behind the range: read on from its beginning
        data, first, state, depth = data[begin:], first + begin, OUTSIDE, 1
        more = min(size, stop + max(RANGE_BYTES // 4, 1))
        data, stop = data + read(stop, more), more


def _opened(path: str):
    system, name = fs.FileSystem.from_uri(path) if re.match(r"\w+://", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _reader(file):
    def read(first: int, last: int) -> bytes:
        file.seek(first)
        return file.read(last - first)

    return read


def read_array(spark: SparkSession, path: str, schema: str, range_bytes: int | None = None) -> DataFrame:
    """Rows of a file that holds one array of objects. A folder, or a file in a store that only Spark opens,
    is read by Spark, a task per file."""
    whole = spark.read.schema(schema).option("multiLine", True)
    try:
        with _opened(path) as file:
            size = file.size()
    except (OSError, ValueError, pa.ArrowException):
        return whole.json(path)
    step = range_bytes or RANGE_BYTES
    if size <= step:
        return whole.json(path)
    cuts = [(k, at, min(size, at + step)) for k, at in enumerate(range(0, size, step))]
    ranges = spark.createDataFrame(cuts, "k long, first long, last long").repartitionByRange(len(cuts), "k")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with _opened(path) as file:
                for row in batch.to_pylist():
                    data = _reader(file)(row["first"], row["last"])
                    found = [x for state in (OUTSIDE, WITHIN, ESCAPED) for x in effect(data, state)]
                    yield pa.RecordBatch.from_pydict({"k": [row["k"]], "found": pa.array([found], pa.list_(pa.int64()))})

    rows = ranges.mapInArrow(scanned, "k long, found array<long>").collect()  # six figures for each range
    state, depth, begins = OUTSIDE, 0, []
    for (k, first, last), r in zip(cuts, sorted(rows, key=lambda r: r["k"]), strict=True):
        begins.append((k, first, last, state, depth))
        depth, state = depth + r["found"][2 * state], r["found"][2 * state + 1]
    known = spark.createDataFrame(begins, "k long, first long, last long, state int, depth int").repartitionByRange(len(cuts), "k")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with _opened(path) as file:
                for row in batch.to_pylist():
                    held: list[str] = []
                    for text in objects(_reader(file), row["first"], row["last"], size, row["state"], row["depth"]):
                        held.append(text.decode("utf-8"))
                        if len(held) >= 1000:
                            yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})
                            held = []
                    yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.string())})

    parsed = known.mapInArrow(read, "value string").select(F.from_json("value", schema).alias("r"))
    return parsed.select("r.*")
