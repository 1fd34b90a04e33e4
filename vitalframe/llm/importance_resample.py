"""Resampling towards a target distribution by hashed n-gram importance weights.

A document's features are its runs of 1 to ``most`` words, hashed by CRC-32 into
buckets. The strings of longer runs are never made: a CRC is linear over GF(2), so
that of ``a b`` is that of ``a`` and a space, moved on by the length of
``b`` (a product with a 32 x 32 bit matrix for that length), plus that of ``b``.
Each distinct word's CRC is worked out once a task; all else are array operations
(``RunHasher``).

1. Bucket counts of the corpus and of the target: a vector a task, summed by
   Spark, one row per bucket on the driver.
2. A bucket's gain is the log ratio of its add-one shares, in thousandths, floored;
   a document's weight is the floored mean over its features.
3. Its score adds Gumbel noise from a hash of its id, so that the highest scores
   are a draw without replacement in proportion to exp(weight / 1000).
4. Ranks: scores are integers in a range of about 120,000 (weight within +-50,000,
   noise between -3,132 and 22,874), so documents per score are a bounded
   table; its running sums give each score's first rank, and a window inside a score
   gives the rest. Rows equal in all columns are counted first and numbered by their
   count, so that no window holds copies.

Defined results: a null or wordless text has no feature, weight 0; a null id counts as
empty text for its noise and comes last in a tie; equal rows have successive ranks;
without target or corpus, shares are of add-one counts alone; an empty table gives no
rows; very long texts are counted whole; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices

BUCKETS, MOST_WORDS, COPIES = 10_000, 1 << 18, 1 << 16
POLYNOMIAL = 0xEDB88320  # CRC-32, bits reflected
#: Bytes of words: digits, lower-case letters, all beyond ASCII; capitals become small.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _apply(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros_like(v)
    for bit in range(32):
        out ^= np.where(v >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@functools.lru_cache(maxsize=40)
def _zeros(power: int) -> np.ndarray:
    """The matrix that moves a CRC on by 2**power zero bits, as 32 columns."""
    if power == 0:
        return np.array([POLYNOMIAL, *(1 << i for i in range(31))], np.uint32)
    half = _zeros(power - 1)
    return _apply(half, half)


@functools.lru_cache(maxsize=4096)
def shift_tables(length: int) -> np.ndarray:
    """The matrix for ``length`` bytes, as four tables by byte of the CRC."""
    matrix = np.uint32(1) << np.arange(32, dtype=np.uint32)
    power = 3
    while length:
        if length & 1:
            matrix = _apply(_zeros(power), matrix)
        length >>= 1
        power += 1
    bits = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(bool)
    return np.stack([np.bitwise_xor.reduce(np.where(bits, matrix[None, 8 * j : 8 * j + 8], np.uint32(0)), axis=1) for j in range(4)])


def shift(crc: np.ndarray, length: int) -> np.ndarray:
    """CRCs moved on by ``length`` bytes: crc(a + b) == shift(crc(a), len(b)) ^ crc(b)."""
    t = shift_tables(length)
    b = np.ascontiguousarray(crc, np.uint32)
    return t[0][b & 255] ^ t[1][b >> 8 & 255] ^ t[2][b >> 16 & 255] ^ t[3][b >> 24]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class RunHasher:
    """CRCs of all runs of 1 to ``most`` words of many texts."""

    def __init__(self, most: int):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.crc, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def hash(self, texts: list[str | None]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Words per text, and for each run length the CRCs and texts of its runs."""
        if len(self.numbers) > MOST_WORDS:
            self._clear()
        known, words, ends = len(self.numbers), [], []
        for t in texts:
            words += (t or "").encode().translate(_BYTES).split()
            ends.append(len(words))
        at = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        new = list(itertools.islice(self.numbers, known, None))
        self.crc = np.append(self.crc, np.fromiter(map(zlib.crc32, new), np.uint32, len(new)))
        self.length = np.append(self.length, np.fromiter(map(len, new), np.int64, len(new)))
        n = np.diff([0, *ends])
        doc = np.repeat(np.arange(len(texts)), n)
        one, size = self.crc[at], self.length[at]
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order])) + 1
        by_size = [p for p in np.split(order, cuts) if len(p)]
        out, run = [(one, doc)], one
        for k in range(2, self.most + 1):
            if len(one) < k:
                out.append((one[:0], doc[:0]))
                continue
            # The run that ends one word earlier, and a space, moved on by the last word.
            spaced = np.concatenate([one[:1], shift(run, 1) ^ np.uint32(zlib.crc32(b" "))])[: len(one)]
            moved = np.empty_like(one)
            for p in by_size:
                moved[p] = shift(spaced[p], int(size[p[0]]))
            run = moved ^ one
            inside = np.zeros(len(one), bool)
            inside[k - 1 :] = doc[k - 1 :] == doc[: len(doc) - k + 1]
            out.append((run[inside], doc[inside]))
        return n, out


def bucket_counts(docs: DataFrame, text_col: str, most: int, buckets: int) -> np.ndarray:
    """Features of all rows by bucket; what reaches the driver is a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = RunHasher(most), np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in slices(batch):
                for crc, _ in hasher.hash(piece.column(0).to_pylist())[1]:
                    counts += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["b", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select(F.col(text_col).cast("string")).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r["b"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of add-one shares, floored, by bucket."""
    s_all, t_all, b = float(corpus.sum()), float(target.sum()), len(corpus)
    one = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
    return np.array([one(s, t) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, id_text: str) -> int:
    """Gumbel noise in thousandths, floored, from the first 32 bits of a digest."""
    h = int(hashlib.sha256(f"{seed}:{id_text}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = 7, most: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_words``, ``n_features``, ``weight``, ``score`` (long) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number per bucket
    kept = docs.select(F.col(id_col), F.col(id_col).cast("string").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    schema = kept.select(id_col).schema
    for c in ("n_words", "n_features", "weight", "score"):
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, value = RunHasher(most), shared.value
        for batch in batches:
            for piece in slices(batch):
                words, runs = hasher.hash(piece.column(2).to_pylist())
                features, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for crc, doc in runs:
                    features += np.bincount(doc, minlength=len(words))
                    # Sums of integers far below 2**53: exact in doubles.
                    total += np.bincount(doc, weights=value[crc % np.uint32(len(value))], minlength=len(words)).astype(np.int64)
                weight = total // np.maximum(features, 1)
                score = weight + np.fromiter((noise(seed, i or "") for i in piece.column(1).to_pylist()), np.int64, len(words))
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(x.astype(np.int64)) for x in (words, features, weight, score))], names=schema.names)

    return kept.mapInArrow(run, schema)


def draw(scored: DataFrame, eligible: Column, num: int, den: int, id_col: str = "doc_id") -> DataFrame:
    """Add ``rank`` long: 1, 2, 3... for the ``num * N // den`` highest scores of the
    ``N`` eligible rows, ties to the smaller id; null for all others."""
    rows = materialize(scored.withColumn("__in", eligible).groupBy(*scored.columns, "__in").agg(F.count("*").alias("__n")), "scored")
    # A row per score: see above for the bound.
    per_score = sorted(rows.where("__in").groupBy("score").agg(F.sum("__n").alias("n")).collect(), reverse=True)
    most, before, first = sum(r["n"] for r in per_score) * num // den, 0, []
    for r in per_score:
        if before >= most:
            break
        first.append((r["score"], before))
        before += r["n"]
    starts = F.broadcast(scored.sparkSession.createDataFrame(first, "score long, __before long"))

    def copies(df: DataFrame, *more: str) -> DataFrame:
        """One row per copy, numbered from 1, in blocks: no array grows with them."""
        blocks = df.select(*scored.columns, *more, "__n", F.explode(F.expr(f"sequence(0L, (__n - 1) div {COPIES})")).alias("__b"))
        return blocks.select(*scored.columns, *more, F.explode(F.expr(f"sequence(__b * {COPIES} + 1, least(__n, (__b + 1) * {COPIES}))")).alias("__k"))

    inside = Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_last(), *(c for c in scored.columns if c not in (id_col, "score")))
    upper = rows.where("__in").join(starts, "score").withColumn("__before", F.col("__before") + F.sum("__n").over(inside) - F.col("__n"))
    place = F.col("__before") + F.col("__k")
    upper = copies(upper, "__before").select(*scored.columns, F.when(place <= most, place).alias("rank"))
    lower = rows.join(starts.withColumn("__in", F.lit(True)), ["score", "__in"], "left_anti")
    return upper.union(copies(lower).select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, num: int = 25, den: int = 100, least_words: int = 20, seed: int = 7, most: int = 2, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and,
    if it is drawn, ``rank``. Rows with fewer than ``least_words`` words are not drawn."""
    gain = gains(bucket_counts(docs, text_col, most, buckets), bucket_counts(target, target_text_col, most, buckets))
    return draw(weigh(docs, gain, seed, most, id_col, text_col), F.col("n_words") >= least_words, num, den, id_col)
