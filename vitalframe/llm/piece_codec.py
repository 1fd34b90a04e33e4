"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of a model goes on over a white space marker (none holds a marker
behind another character), a normalised text falls into chunks, each one or more
markers and the word behind them, that are segmented independently: merges
never cross their borders, and the order of merges inside a chunk does not depend
on what lies outside. So every distinct chunk is segmented once, its ids go to
a flat table, and the ids of a text are joined back by the positions of its chunks
(``ChunkTable``). A model for which that does not hold (see ``chunks_alone``)
has whole texts as its chunks; results are the library's either way.

Each task keeps one table over all its batches and starts anew when it holds
``MOST_CHUNKS``: that bounds memory, and no text is shuffled. A table shared by all
tasks would have to send every text's rarer chunks through two shuffles.

Defined results: a null text encodes like an empty one; equal texts have
equal ids; very long texts and chunks are segmented whole; an empty table
gives no rows; other columns pass (``encode``, ``decode``) or are
ignored (``round_trip``), whatever their names. ``decode`` gives null where an id is
unknown to the model or missing.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_proto

from .common import slices

MARKER = "▁"
MOST_CHUNKS, MOST_IDS = 1 << 18, 1 << 24
_CHUNK = re.compile(f"{MARKER}+[^{MARKER}]*")


def chunks_alone(proto: bytes) -> bool:
    """Whether chunks of a normalised text can be segmented one by one: merges by
    rank (BPE), bytes for unknown characters, a normaliser that only marks white
    space, no piece given by the user, none that crosses into a marker."""
    m = model_proto.ModelProto.FromString(proto)
    norm, plain = m.normalizer_spec, model_proto.ModelProto.SentencePiece
    return (
        m.trainer_spec.model_type == model_proto.TrainerSpec.BPE
        and m.trainer_spec.byte_fallback
        and not (norm.precompiled_charsmap or norm.remove_extra_whitespaces or m.trainer_spec.treat_whitespace_as_suffix)
        and norm.add_dummy_prefix
        and norm.escape_whitespaces
        and all(p.type != plain.USER_DEFINED and not re.search(f"[^{MARKER}]{MARKER}", p.piece) for p in m.pieces)
        and any(p.piece == MARKER for p in m.pieces)
    )


class ChunkTable:
    """Ids of distinct chunks, in one flat array; ``encode_many`` adds what is new."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.alone = chunks_alone(self.model.serialized_model_proto())
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 12, np.int32), 0
        self.start, self.count = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)

    def chunks(self, text: str) -> list[str]:
        if not self.alone:
            return [text]
        return _CHUNK.findall(MARKER + text.replace(" ", MARKER)) if text else []

    def _segment(self, new: list[str]) -> list[list[int]]:
        if not self.alone:
            return self.model.encode(new, num_threads=1)
        # The library puts the first marker back; a marker alone is a piece.
        one = self.model.piece_to_id(MARKER)
        return [ids if len(c) > 1 else [one] for c, ids in zip(new, self.model.encode([c[1:] for c in new], num_threads=1), strict=True)]

    def _add(self, new: list[str]) -> None:
        found = self._segment(new)
        size = np.fromiter(map(len, found), np.int64, len(found))
        first, rows, ids = len(self.place) - len(new), len(self.place), int(size.sum())
        while len(self.start) < rows:
            self.start, self.count = np.resize(self.start, 2 * len(self.start)), np.resize(self.count, 2 * len(self.count))
        if len(self.flat) < self.used + ids:
            self.flat = np.resize(self.flat, max(2 * len(self.flat), self.used + ids))
        self.flat[self.used : self.used + ids] = np.fromiter((i for x in found for i in x), np.int32, ids)
        self.count[first:rows] = size
        self.start[first:rows] = self.used + np.cumsum(size) - size
        self.used += ids

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        if len(self.place) > MOST_CHUNKS or self.used > MOST_IDS:
            self._clear()
        place, new, at, ends = self.place, [], [], []
        for t in texts:
            for c in self.chunks(t or ""):
                i = place.get(c)
                if i is None:
                    i = place[c] = len(place)
                    new.append(c)
                at.append(i)
            ends.append(len(at))
        if new:
            self._add(new)
        where = np.array(at, np.int64)
        count = self.count[where]
        before = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.repeat(self.start[where] - before[:-1], count) + np.arange(before[-1])]
        return np.split(ids, before[ends[:-1]])


@functools.lru_cache(maxsize=2)
def table_of(model_file: str) -> ChunkTable:
    """A worker's table; it stays when the next task comes."""
    return ChunkTable(model_file)


def _framed(table: ChunkTable, texts: list[str | None], begin: bool, end: bool) -> list[np.ndarray]:
    b, e = [table.model.bos_id()] * begin, [table.model.eos_id()] * end
    return [np.concatenate([b, ids, e]).astype(np.int32) for ids in table.encode_many(texts)]


def encode(df: DataFrame, model_file: str, text_col: str = "text", out: str = "ids", begin: bool = True, end: bool = True) -> DataFrame:
    """Add ``out`` array<int>: the ids of the whole text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        table, found = table_of(model_file), []
        for piece in slices(pa.RecordBatch.from_arrays([texts], names=["t"])):
            found += _framed(table, piece.column(0).to_pylist(), begin, end)
        return pa.array(found, pa.list_(pa.int32()))

    return df.withColumn(out, ids(F.col(text_col)))


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` string: the library's decoding; null where it knows an id not."""

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        model = table_of(model_file).model

        def one(x):
            known = x is not None and all(i is not None and 0 <= i < model.get_piece_size() for i in x)
            return model.decode(x) if known else None

        return pa.array([one(x) for x in ids.to_pylist()], pa.string())

    return df.withColumn(out, texts(F.col(ids_col)))


def round_trip(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode with begin and end ids, and decode, in one scan without a shuffle: id,
    ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (of the decoded text in UTF-8)."""
    kept = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = kept.select(id_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_file)
        for batch in batches:
            for piece in slices(batch):
                found = _framed(table, piece.column(1).to_pylist(), True, True)
                a = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
                b = [hashlib.sha256(table.model.decode(x.tolist()).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(a), pa.array(b)], names=schema.names)

    return kept.mapInArrow(run, schema)
