"""Files and folders: Parquet, ORC, CSV, JSON, JSONL, XML, gz and zip, Excel.

Listing and small headers go through Hadoop's file systems, so any path that
Spark can read works. JSON comes as VARIANT (``v``), which keeps mixed types and
missing keys; CSV and XML leaves are strings.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import zipfile
from collections.abc import Mapping
from pathlib import PurePosixPath
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import delimited, json_document
from .registry import Dataset

FORMATS = {".csv", ".json", ".jsonl", ".ndjson", ".xml", ".xlsx", ".xls", ".parquet", ".orc"}
SNIFF_BYTES = 8192


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def head_bytes(spark: SparkSession, path: str, n: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file, decompressed if it is gzipped; no more is read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        data = bytes(stream.readNBytes(n if not path.endswith(".gz") else 1 << 20))
    finally:
        stream.close()
    if path.endswith(".gz"):
        import zlib

        data = zlib.decompressobj(31).decompress(data, n)
    return data[:n]


def classify(name: str, member: str | None = None, strict: bool = True) -> tuple[str, str | None] | None:
    """(format, compression) of a file name; None if it is to be skipped."""
    suffix = PurePosixPath(name).suffix.lower()
    compression = {".gz": "gzip", ".zip": "zip"}.get(suffix)
    inner = PurePosixPath(member or (name[: -len(suffix)] if compression else name)).suffix.lower()
    problem = f"unsupported file type {inner or suffix}" if inner not in FORMATS else "compressed Excel files are not supported" if compression and inner in (".xlsx", ".xls") else None
    if problem and strict:
        raise ValueError(f"{name}: {problem}")
    return None if problem else (inner, compression)


def zip_members(spark: SparkSession, path: str) -> list[str]:
    row = spark.read.format("binaryFile").load(path).first()
    with zipfile.ZipFile(io.BytesIO(bytes(row["content"]))) as z:
        return [n for n in z.namelist() if not n.endswith("/")]


def _member(spark: SparkSession, path: str, wanted: str | None, strict: bool) -> str | None:
    names = zip_members(spark, path)
    found = wanted if wanted in names else names[0] if len(names) == 1 and not wanted else None
    if found is None and strict:
        raise ValueError(f"{path}: " + (f"{wanted} is not in the archive" if wanted else "empty archive" if not names else f"name one member of {', '.join(names)}"))
    return found


def list_files(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = False) -> list[tuple[str, str]]:
    """(path, name relative to the folder) of files; one pair for a file."""
    fs, at = _fs(spark, root)
    if not fs.exists(at):
        raise FileNotFoundError(root)
    if fs.getFileStatus(at).isFile():
        return [(root, PurePosixPath(root).name)]
    base = str(fs.getFileStatus(at).getPath().toString()).rstrip("/")
    found, it = [], fs.listFiles(at, recursive or bool(pattern and "/" in pattern))
    while it.hasNext():
        p = it.next().getPath().toString()
        rel = p[len(base) + 1 :]
        if not any(part.startswith(("_", ".")) for part in rel.split("/")) and (not pattern or fnmatch.fnmatchcase(rel, pattern)):
            found.append((p, rel))
    return sorted(found)


def open_files(spark: SparkSession, spec: Mapping[str, Any]) -> list[Dataset]:
    """One object per file; ``path``, and optionally ``pattern``, ``recursive``,
    ``member``, ``root`` (JSON path or XML element)."""
    root = spec["path"]
    fs, at = _fs(spark, root)
    single = fs.exists(at) and fs.getFileStatus(at).isFile()
    if not single and (root.endswith((".parquet", ".orc")) or fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root, "_SUCCESS"))):
        kind = "orc" if root.endswith(".orc") else "parquet"
        return [Dataset(PurePosixPath(root).stem, spark.read.format(kind).load(root), {"path": root})]
    out = []
    for path, rel in list_files(spark, root, spec.get("pattern"), bool(spec.get("recursive"))):
        member = None
        if path.lower().endswith(".zip"):
            member = _member(spark, path, spec.get("member"), strict=single)
            if member is None:
                continue
        kind = classify(path, member, strict=single)
        if kind is None:
            continue
        name = PurePosixPath(member).stem if member else PurePosixPath(rel[:-3] if kind[1] == "gzip" else rel).stem
        folder = str(PurePosixPath(rel).parent)
        prefix = "" if single or folder == "." else f"{folder}/"
        out += [Dataset(prefix + n, df, {"path": path, "format": kind[0], "compression": kind[1]}) for n, df in _read(spark, path, kind[0], member, name, spec)]
    if not out:
        raise ValueError(f"no supported files in {root}")
    return out


def _read(spark: SparkSession, path: str, kind: str, member: str | None, name: str, spec: Mapping[str, Any]) -> list[tuple[str, DataFrame]]:
    if member:
        return [(name, _zipped(spark, path, kind, member, spec))]
    if kind in (".xlsx", ".xls"):
        return _excel(spark, path)
    read = {".csv": read_csv, ".json": read_json, ".jsonl": read_jsonl, ".ndjson": read_jsonl, ".xml": read_xml}.get(kind)
    if read:
        return [(name, read(spark, path, spec))]
    return [(name, spark.read.format(kind[1:]).load(path))]


#: What may separate fields; a blank or a letter that comes as often in each line may not.
DELIMITERS = ",;\t|"


def sniff(text: str) -> tuple[str, str, bool]:
    """Separator, quote and whether there is a header, from the start of a file."""
    try:
        d = csv.Sniffer().sniff(text, DELIMITERS)
        sep, quote = d.delimiter, d.quotechar or '"'
    except csv.Error:
        sep, quote = ",", '"'
    try:
        header = csv.Sniffer().has_header(text)
    except (csv.Error, ValueError):
        header = True
    return sep, quote, header


def _dialect(start: str, spec: Mapping[str, Any] | None) -> tuple[str, str, bool]:
    """As ``sniff``; what ``spec`` says of ``sep``, ``quote`` and ``header`` holds."""
    found = dict(zip(("sep", "quote", "header"), sniff(start), strict=True))
    given = {k: v for k, v in (spec or {}).items() if k in found and v is not None}
    return tuple((found | given).values())


def _named(start: str, sep: str, quote: str, header: bool) -> list[str]:
    """Column names from the first record; repeated and empty ones get their place."""
    first = next(csv.reader(io.StringIO(start, newline=""), delimiter=sep, quotechar=quote), [])
    if not header:
        return [f"col_{i + 1}" for i in range(len(first))]
    names = [n if n else f"col_{i + 1}" for i, n in enumerate(first)]
    return [n if names.count(n) == 1 else f"{n}_{i + 1}" for i, n in enumerate(names)]


def read_csv(spark: SparkSession, path: str, spec: Mapping[str, Any] | None = None) -> DataFrame:
    """All columns as strings; without a header they are col_1, col_2, ... A file is cut
    into records by many tasks, whatever line breaks its quotes hold. The header is the first
    record, and no other row is left out for looking like it."""
    start = head_bytes(spark, path).decode("utf-8-sig", "replace")
    sep, quote, header = _dialect(start, spec)
    names = _named(start, sep, quote, header)
    if not names:
        return spark.createDataFrame([], "col_1 string")
    rows = delimited.records(spark, path, sep, quote)
    rows = rows.withColumn("text", F.when((F.col("block") == 0) & F.coalesce(F.col("i") == 0, F.lit(True)), F.regexp_replace("text", "^\ufeff", "")).otherwise(F.col("text")))
    if header:  # the first record of the file; if it goes on over blocks, it has no number
        whole = delimited.begins_whole(rows)
        first = F.col("i").eqNullSafe(F.lit(0) if whole else F.lit(None).cast("long"))
        rows = rows.where(~((F.col("block") == 0) & first))
    return delimited.parsed(rows, names, sep, quote)


def read_jsonl(spark: SparkSession, path: str, spec: Mapping[str, Any] | None = None) -> DataFrame:
    """A record per line; what is no object becomes {"value": x}; damaged lines fail."""
    mode = (spec or {}).get("mode", "FAILFAST")
    df = spark.read.option("singleVariantColumn", "v").option("mode", mode).json(path)
    return df.where("v is not null").select(_object(F.col("v")).alias("v"))


def read_json(spark: SparkSession, path: str, spec: Mapping[str, Any] | None = None) -> DataFrame:
    """One document, cut into records by many tasks; ``root`` is a dotted path to them."""
    root = [p for p in ((spec or {}).get("root") or "").split(".") if p]
    return json_document.records(spark, path, root).select(_object(F.parse_json("text")).alias("v"))


def _object(v):
    """VARIANT objects as they are, other values as {"value": x}."""
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(F.parse_json(F.concat(F.lit('{"value":'), F.to_json(v), F.lit("}"))))


def _row_tag(spark: SparkSession, path: str) -> str:
    """The name of the first child of a document's element, from the file's start; of
    the element itself if it has none."""
    import xml.etree.ElementTree as ET

    pull, open_ = ET.XMLPullParser(["start"]), []
    try:
        pull.feed(head_bytes(spark, path))
        open_ = [e.tag for _, e in pull.read_events()]
    except ET.ParseError as e:
        raise ValueError(f"{path} is no XML: {e}") from e
    if not open_:
        raise ValueError(f"{path} has no element in its beginning")
    return open_[min(1, len(open_) - 1)].rpartition("}")[2]


def read_xml(spark: SparkSession, path: str, spec: Mapping[str, Any] | None = None) -> DataFrame:
    """Elements named ``root``, by default the children of the document's element;
    attributes under ``@attributes``, text in ``#text``."""
    tag = (spec or {}).get("root") or "*"
    if tag == "*":
        tag = _row_tag(spark, path)
    df = spark.read.format("xml").options(rowTag=tag, attributePrefix="@", valueTag="#text", inferSchema="false").load(path)
    attributes = [c for c in df.columns if c.startswith("@")]
    if not attributes:
        return df
    return df.select(F.struct(*(F.col(f"`{c}`").alias(c[1:]) for c in attributes)).alias("@attributes"), *(F.col(f"`{c}`") for c in df.columns if c not in attributes))


def _zip_start(spark: SparkSession, path: str, member: str, size: int = 1 << 16) -> str:
    """The beginning of a member, unpacked by a task."""

    def start(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(member) as raw:
                    yield pd.DataFrame({"v": [raw.read(size)]})

    got = spark.read.format("binaryFile").load(path).select("content").mapInPandas(start, "v binary").first()["v"]
    return bytes(got).decode("utf-8-sig", "replace")


def _zipped(spark: SparkSession, path: str, kind: str, member: str, spec: Mapping[str, Any]) -> DataFrame:
    """A member of a zip archive as lines, read by one task per archive."""

    import pandas as pd

    def _packed(texts):
        held, first, size = [], 0, 0
        for x in texts:
            held.append(x)
            size += len(x)
            if size > 4 << 20 or len(held) >= 10_000:
                yield pd.DataFrame({"i": range(first, first + len(held)), "value": held})
                first, held, size = first + len(held), [], 0
        if held:
            yield pd.DataFrame({"i": range(first, first + len(held)), "value": held})

    def lines(batches):
        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(member) as raw:
                    text = io.TextIOWrapper(raw, encoding="utf-8-sig", newline="\n")
                    if kind == ".json":
                        yield pd.DataFrame({"i": [0], "value": [text.read()]})
                        continue
                    if kind == ".csv":
                        yield from _packed(x for k, x in delimited.cut((line.rstrip("\n") for line in text), False, sep, quote))
                        continue
                    yield from _packed(x.rstrip("\r\n") for x in text)

    sep = quote = ""
    if kind == ".csv":
        start = _zip_start(spark, path, member)
        sep, quote, header = _dialect(start, spec)
        names = _named(start, sep, quote, header)
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "i long, value string")
    if kind == ".csv":
        if not names:
            return spark.createDataFrame([], "col_1 string")
        rows = rows.select("i", F.col("value").alias("text"))
        return delimited.parsed(rows.where("i > 0") if header else rows, names, sep, quote)
    if kind in (".jsonl", ".ndjson"):
        return rows.where(F.trim("value") != "").select(_object(F.parse_json("value")).alias("v"))
    if kind == ".json":
        many = F.schema_of_variant("d").startswith("ARRAY")
        doc = rows.select(F.parse_json("value").alias("d"))
        listed = doc.where(many).lateralJoin(spark.tvf.variant_explode(F.col("d").outer())).select(F.col("value").alias("v"))
        return listed.union(doc.where(~many).select("d")).select(_object(F.col("v")).alias("v"))
    raise ValueError(f"{kind} inside zip is not supported")


def _excel(spark: SparkSession, path: str) -> list[tuple[str, DataFrame]]:
    """Sheets of a workbook (needs openpyxl)."""
    try:
        import openpyxl
    except ImportError as e:
        raise ImportError("reading Excel files needs openpyxl") from e
    data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    out = []
    for sheet in openpyxl.load_workbook(io.BytesIO(data), read_only=True, data_only=True).worksheets:
        rows = sheet.iter_rows(values_only=True)
        names = [str(c) if c not in (None, "") else f"col_{i + 1}" for i, c in enumerate(next(rows, ()))]
        kept = [[None if v is None else str(v) for v in r] for r in rows if any(v is not None for v in r)]
        if names:
            out.append((sheet.title, spark.createDataFrame(kept, ", ".join(f"`{n}` string" for n in names))))
    return out
