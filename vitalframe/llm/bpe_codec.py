"""Byte-level BPE encoding and decoding with the tiktoken library.

``encode`` runs tiktoken over a local rank file. Long texts are first cut at
*safe boundaries*: between a character that is not white space and a white
space character. No alternative of the split pattern holds a white space
character after another one, and its look-ahead only looks past white space,
so a cut there leaves every match, and with it every id, as it was. A text
without such places is passed on whole.

Defined results: a null text encodes like an empty one (no ids, empty bytes);
ids that the vocabulary lacks make ``decode`` fail for that row (null).
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: White space for the split pattern is Unicode White_Space; only places seen
#: alike by every reading of it serve as boundaries.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])(?=[ \n])")
LONG_CHARS = 65_536


@functools.lru_cache(maxsize=4)
def load_encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, long_chars: int = LONG_CHARS) -> Iterator[str]:
    """Pieces of about ``long_chars`` characters, cut at safe boundaries."""
    start, n = 0, len(text)
    while n - start > long_chars:
        cut = _SAFE.search(text, start + long_chars)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    # Lone surrogates cannot come out of Spark, whose strings are UTF-8.
    if len(text) <= LONG_CHARS:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text):
        ids += enc.encode_ordinary(piece)
    return ids


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out`` array<int>: the ids of the whole text (empty for null)."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = load_encoding(rank_file, pattern)
        return pa.array([encode_text(enc, t or "") for t in texts.to_pylist()], pa.list_(pa.int32()))

    return df.withColumn(out, ids(F.col(text_col)))


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` binary: the raw bytes of the ids; null where an id is unknown."""

    @F.arrow_udf("binary")
    def raw(ids: pa.Array) -> pa.Array:
        enc = load_encoding(rank_file, pattern)

        def one(x):
            try:
                return enc.decode_bytes(x or [])
            except KeyError:
                return None

        return pa.array([one(x) for x in ids.to_pylist()], pa.binary())

    return df.withColumn(out, raw(F.col(ids_col)))


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass over Arrow batches.

    Returns id, ``n_tokens`` long, ``ids_sha256`` (decimal ids joined by one
    space), ``decoded_sha256`` (of the decoded bytes). Rows are independent, so
    the plan is one scan without a shuffle; ids never leave the worker, which
    bounds its memory by one Arrow batch.
    """
    kept = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = kept.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = load_encoding(rank_file, pattern)
        n, a, b = [], [], []
        for text in batch.column(1).to_pylist():
            ids = encode_text(enc, text or "")
            n.append(len(ids))
            a.append(hashlib.sha256(str(ids)[1:-1].replace(",", "").encode()).hexdigest())
            b.append(hashlib.sha256(enc.decode_bytes(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=schema.names)

    return arrow_map(kept, run, schema)


__all__ = ["decode", "encode", "encode_text", "load_encoding", "round_trip", "safe_pieces"]
