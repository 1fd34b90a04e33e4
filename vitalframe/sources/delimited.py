"""Delimited text with quoted line breaks, read by many tasks.

A line break ends a record only outside quotes, and whether a block of the file begins
inside them depends on all that comes before it. So each block first tells how it would
end, were it begun outside and inside quotes; the blocks' answers, a row each, are chained
in order; and then every block knows how it begins and cuts its own records. A record
that goes on over blocks is put together from their ends.

Quotes count where they open a field; doubled ones stand for themselves. Empty lines
outside quotes are left out. A quote that is never closed makes the rest one record.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NO_NULL = "\u0001"


def ends_inside(line: str, inside: bool, sep: str, quote: str) -> bool:
    """Whether the end of ``line`` is inside quotes, given whether its start is."""
    if quote not in line:
        return inside
    at, size = 0, len(line)
    while True:
        if not inside:
            if line.startswith(quote, at):
                at += 1
            else:  # an unquoted field: quotes in it are characters
                at = line.find(sep, at)
                if at < 0:
                    return False
                at += len(sep)
                continue
        while True:  # to the closing quote
            at = line.find(quote, at)
            if at < 0:
                return True
            at += 1
            if not line.startswith(quote, at):
                break
            at += 1
        inside = False
        at = line.find(sep, at)
        if at < 0 or at >= size:
            return False
        at += len(sep)


def cut(lines: Iterable[str], inside: bool, sep: str, quote: str) -> Iterator[tuple[str, str]]:
    """("head" | "record" | "tail", text): the end of a record begun before, whole
    records, and one that goes on behind the last line. ``middle``: neither end is here."""
    held: list[str] = []
    begun = inside
    for line in lines:
        held.append(line)
        inside = ends_inside(line, inside, sep, quote)
        if not inside:
            text = "\n".join(held)
            if begun:
                yield "head", text
            elif text.strip("\r"):
                yield "record", text
            held, begun = [], False
    if held:
        yield ("middle" if begun else "tail"), "\n".join(held)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[str]]]:
    """Lines of each block in turn, as they come from a scan."""
    rows = ((b, v or "") for batch in batches for b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
    row = next(rows, None)

    def lines(block: int) -> Iterator[str]:
        nonlocal row
        while row is not None and row[0] == block:
            yield row[1]
            row = next(rows, None)

    while row is not None:
        block = row[0]
        yield block, lines(block)


def chained(blocks: Sequence[tuple[int, bool, bool, bool]]) -> dict[int, tuple[bool, int]]:
    """(block, ends inside if begun outside, if begun inside, is outside at some line's end
    if begun inside) -> block: (begins inside, the block where the record at hand begins)."""
    out: dict[int, tuple[bool, int]] = {}
    inside, owner = False, -1
    for block, from_outside, from_inside, closes in sorted(blocks):
        out[block] = (inside, owner)
        ends = from_inside if inside else from_outside
        if ends and (not inside or closes):
            owner = block
        inside = ends
    return out


def records(spark: SparkSession, path: str, sep: str, quote: str) -> DataFrame:
    """``block, i, text``: the records of a file (``i`` from 0 in each block; null if a
    record goes on over blocks, whose ``block`` is then its first)."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_block_start").alias("block"), "value")

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, text in _blocks(batches):
            outside, inside, closes = False, True, False
            for line in text:
                if outside == inside and closes:
                    outside = inside = ends_inside(line, inside, sep, quote)
                else:
                    outside, inside = ends_inside(line, outside, sep, quote), ends_inside(line, inside, sep, quote)
                closes = closes or not inside
            yield pa.RecordBatch.from_pylist([{"block": block, "a": outside, "b": inside, "c": closes}])

    found = lines.mapInArrow(answers, "block long, a boolean, b boolean, c boolean").collect()  # a row per block of the file
    begins = spark.sparkContext.broadcast(chained([tuple(r) for r in found]))

    def cutter(whole: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, text in _blocks(batches):
                inside, owner = begins.value[block]
                i, held, size = 0, [], 0
                for kind, record in cut(text, inside, sep, quote):
                    if kind == "record":
                        if whole:
                            held.append((block, i, None, record))
                            size += len(record)
                        i += 1
                    elif not whole:
                        held.append((block, None, block if kind == "tail" else owner, record))
                    if size > 4 << 20 or len(held) > 10_000:
                        yield packed(held)
                        held, size = [], 0
                if held:
                    yield packed(held)

        return run

    def packed(held: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["block", "i", "owner", "text"])

    kind = "block long, i long, owner long, text string"
    out = lines.mapInArrow(cutter(True), kind).select("block", "i", "text")
    open_ = [b for b, (inside, _) in begins.value.items() if inside]
    if open_ or any(r["a"] for r in found):  # else no record goes on over blocks
        ends = lines.mapInArrow(cutter(False), kind).groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
        out = out.union(ends.select(F.col("owner").alias("block"), F.lit(None).cast("long").alias("i"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text")))
    return out


def begins_whole(rows: DataFrame) -> bool:
    """Whether the first record of the file lies in its first block."""
    return not rows.where("block = 0 and i = 0").isEmpty()


def parsed(rows: DataFrame, names: Sequence[str], sep: str, quote: str) -> DataFrame:
    """Columns of string from a column ``text`` of records."""
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    text = F.regexp_replace("text", "\r$", "")
    return rows.select(F.from_csv(text, schema, {"sep": sep, "quote": quote, "escape": quote, "nullValue": NO_NULL, "maxCharsPerColumn": "-1"}).alias("__r")).select("__r.*")
