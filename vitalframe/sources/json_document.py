"""One JSON document, however large, read as records by many tasks.

The records are the elements of the array at a dotted path (``root``), or the one value
there. The file is scanned in pieces that end at commas. What a comma means depends on
all before it, so each block first tells, for a start outside and inside a string, how it
would end: inside or not, how much deeper, how far up in between, and at which levels it
has commas. The answers, a row a block, are chained in order. Then each block knows its
level and finds the keys of ``root`` and the commas between records at once. A record that
goes on over blocks is put together from their ends. No task holds more than its batches
and one record.

A path that is not there gives no rows; of a key that comes twice, the last counts. A part
of the path that holds a comma, a document that ends inside a string or an open bracket, and
one that is followed by more are errors. Damaged records fail when parsed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1
_BLANK = b" \t\r\n"
_BOM = b"\xef\xbb\xbf"
EMIT_BYTES = 4 << 20


class Start(NamedTuple):
    """How a block begins: inside a string, at which level, and where the record at hand began."""

    inside: bool
    level: int
    owner: int


class Place(NamedTuple):
    block: int
    at: int
    first: int


def marks(data: bytes, inside: bool, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, which of them are outside strings (closing quotes are), and the level behind each."""
    b = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(b == 34)
    if 92 in data and len(quotes):
        at = np.arange(len(b))
        last = np.maximum.accumulate(np.where(b != 92, at, -1))  # the last byte that is no backslash
        before = np.where(quotes > 0, quotes - 1 - last[quotes - 1], 0)
        quotes = quotes[before % 2 == 0]
    turns = np.zeros(len(b), np.int8)
    turns[quotes] = 1
    outside = (np.bitwise_xor.accumulate(turns) ^ np.int8(inside)) == 0 if len(b) else np.zeros(0, bool)
    return b, outside, level + np.cumsum(np.where(outside, _STEP[b], 0), dtype=np.int64)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """(block, text) by batches; each text ends with a comma."""
    for batch in batches:
        blocks, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi > lo:
                yield int(blocks[lo]), (",".join(texts[lo:hi]) + ",").encode()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, ends = -1, []

    def row() -> pa.RecordBatch:
        kind = pa.struct([("inside", pa.bool_()), ("level", pa.int64()), ("lowest", pa.int64()), ("commas", pa.list_(pa.int64()))])
        values = [{"inside": e[0], "level": e[1], "lowest": e[2], "commas": sorted(e[3])} for e in ends]
        return pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([v], kind) for v in values)], names=["block", "a", "b"])

    for key, data in _pieces(batches):
        if key != block:
            if block >= 0:
                yield row()
            block, ends = key, [[False, 0, 0, set()], [True, 0, 0, set()]]
        for e in ends:
            b, outside, level = marks(data, e[0], e[1])
            e[3].update(np.unique(level[outside & (b == 44)]).tolist())
            e[0], e[1], e[2] = not outside[-1], int(level[-1]), min(e[2], int(level.min()))
    if block >= 0:
        yield row()


def _keys(begins, level_of: int, part: str, place: Place):
    """Values of ``part`` in the object that opens at ``place``; ``first`` is null where
    an object at that level ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, over, found = -1, False, []
        for key, data in _pieces(batches):
            if key < place.block:
                continue
            if key != block:
                block, at, over = key, 0, False
                inside, level, _ = begins.value[key]
            b, outside, levels = marks(data, inside, level)
            lo = max(0, place.at + 1 - at) if key == place.block else 0
            if not over and lo < len(b):
                low = np.flatnonzero(levels[lo:] < level_of)
                hi = lo + int(low[0]) if len(low) else len(b)
                for colon in (lo + np.flatnonzero(outside[lo:hi] & (b[lo:hi] == 58) & (levels[lo:hi] == level_of))).tolist():
                    closing = len(data[:colon].rstrip(_BLANK)) - 1
                    before = np.flatnonzero(outside[:closing])  # the last of them is before the name's quote
                    name = data[int(before[-1]) + 1 if len(before) else 0 : closing + 1]
                    if (len(before) or not inside) and json.loads(name, strict=False) == part:
                        rest = data[colon + 1 :].lstrip(_BLANK)
                        found.append((key, at + len(data) - len(rest), rest[0]))
                if len(low):
                    over = True
                    found.append((key, at + hi, None))
            inside, level, at = not outside[-1], int(levels[-1]), at + len(data)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["block", "at", "first"])

    return run


def _ends_of(levels: np.ndarray, commas: np.ndarray, lo: int, cut_level: int, many: bool) -> tuple[list[int], int | None]:
    """Where records end from ``lo`` on, and the end of the last one."""
    low = np.flatnonzero(levels[lo:] < cut_level)
    close = lo + int(low[0]) if len(low) else None
    stop = len(levels) if close is None else close
    cuts = (lo + np.flatnonzero(commas[lo:stop] & (levels[lo:stop] == cut_level))).tolist()
    return (cuts, close) if many else ([], cuts[0] if cuts else close)


def _closes(begins, place: Place, cut_level: int, many: bool):
    """A row if the last record ends in the block where the first begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, closed = 0, False
        inside, level, _ = begins.value[place.block]
        for key, data in _pieces(batches):
            if key == place.block and not closed:
                b, outside, levels = marks(data, inside, level)
                lo = max(0, place.at + many - at)
                closed = lo < len(b) and _ends_of(levels, outside & (b == 44), lo, cut_level, many)[1] is not None
                inside, level, at = not outside[-1], int(levels[-1]), at + len(data)
        if closed:
            yield pa.RecordBatch.from_arrays([pa.array([True])], names=["closed"])

    return run


def _cutter(begins, place: Place, cut_level: int, last: int, many: bool, whole: bool):
    """Records that lie in one block, or else the ends of those that don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out, size = -1, [], 0
        held: list[bytes] = []
        begun = done = False

        def put(text: bytes, kind: str) -> None:
            nonlocal size
            if whole == (kind == "record"):
                out.append((begins.value[block].owner if kind in ("head", "middle") else block, block, text))
                size += len(text)

        def finish() -> None:
            if block >= 0 and not done:
                put(b"".join(held), "tail" if begun else "middle")
            held.clear()

        def after(text: bytes) -> None:
            if cut_level == int(many) and text.strip(_BLANK + b","):
                raise ValueError("more follows behind the document")

        for key, data in _pieces(batches):
            if key > last:
                after(data)
            if not place.block <= key <= last:
                continue
            if key != block:
                finish()
                block, at, done, cuts_before = key, 0, False, False
                begun = key == place.block
                inside, level, _ = begins.value[key]
            b, outside, levels = marks(data, inside, level)
            lo = max(0, place.at + many - at) if key == place.block else 0
            if done:
                after(data)
            elif lo < len(b):
                cuts, close = _ends_of(levels, outside & (b == 44), lo, cut_level, many)
                for c in [*cuts, *([] if close is None else [close])]:
                    text = b"".join([*held, data[lo:c]])
                    held.clear()
                    if not (c == close and many and key == place.block and not cuts_before and not text.strip(_BLANK)):  # an empty array
                        put(text, "record" if begun else "head")
                    lo, begun, cuts_before = c + 1, True, True
                done = close is not None
                (after if done else held.append)(data[lo:])
            inside, level, at = not outside[-1], int(levels[-1]), at + len(data)
            if size > EMIT_BYTES:
                yield packed(out)
                out, size = [], 0
        finish()
        if out:
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        owner, block, text = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(block, pa.int64()), pa.array([t.decode() for t in text])], names=["owner", "block", "text"])

    return run


def records(spark: SparkSession, path: str, root: Sequence[str] = ()) -> DataFrame:
    """``text``: the JSON text of each record of the document at ``path``."""
    empty = spark.createDataFrame([], "text string")
    chunks = spark.read.text(path, lineSep=",").select(F.col("_metadata.file_block_start").alias("block"), "value")
    kind = "struct<inside: boolean, level: long, lowest: long, commas: array<long>>"
    found = sorted(chunks.mapInArrow(_answers, f"block long, a {kind}, b {kind}").collect())  # a row per block of the file
    starts: dict[int, Start] = {}
    facts: dict[int, tuple[int, set[int]]] = {}
    inside, level = False, 0
    for r in found:
        got = r["b"] if inside else r["a"]
        starts[r["block"]] = Start(inside, level, -1)
        facts[r["block"]] = (level + got["lowest"], {level + c for c in got["commas"]})
        inside, level = got["inside"], level + got["level"]
    if inside or level:
        raise ValueError(f"{path}: the document ends inside a string or an open bracket")

    if any("," in part for part in root):
        raise ValueError("a part of root holds a comma")
    head = "".join(r["value"] + "," for r in chunks.where("block = 0").select("value").limit(1).collect()).encode()
    if not head.removeprefix(_BOM).strip(_BLANK + b","):
        raise ValueError(f"{path}: no JSON document")
    at = len(head) - len(head.removeprefix(_BOM).lstrip(_BLANK))
    place = Place(0, at, head[at])
    for depth, part in enumerate(root, 1):
        if place.first != ord("{"):
            return empty
        begins = spark.sparkContext.broadcast(starts)
        seen = sorted(chunks.mapInArrow(_keys(begins, depth, part, place), "block long, at long, first int").collect(), key=lambda r: (r["block"], r["at"]))
        end = next(i for i, r in enumerate(seen) if r["first"] is None)  # an end a block at most, and keys of one object before it
        if not end:
            return empty
        place = Place(*seen[end - 1])

    many = place.first == ord("[")
    cut_level = len(root) + many
    begins = spark.sparkContext.broadcast(starts)
    last = owner = place.block
    if chunks.where(F.col("block") == place.block).mapInArrow(_closes(begins, place, cut_level, many), "closed boolean").isEmpty():
        for block in (b for b in starts if b > place.block):
            starts[block] = starts[block]._replace(owner=owner)
            lowest, commas = facts[block]
            last = block
            if lowest < cut_level or (not many and cut_level in commas):
                break
            owner = block if cut_level in commas else owner
        begins = spark.sparkContext.broadcast(starts)
    out = "owner long, block long, text string"
    whole = chunks.mapInArrow(_cutter(begins, place, cut_level, last, many, True), out).select("text")
    if last == place.block:
        return whole
    ends = chunks.mapInArrow(_cutter(begins, place, cut_level, last, many, False), out)
    joined = ends.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    return whole.union(joined.select(F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))
