"""Phrase collocations by growing contiguous patterns to the right (PrefixSpan).

Every occurrence of a word is a pointer to the words from there on, inside its
piece of text. The projection of a prefix is the set of the pointers that begin
with it; a pattern grows to the right by the next words of its projection, depth
first, as long as it is frequent.

* A task reads texts once and merges equal pointers (at most ``most`` words) of
  ``FLUSH`` words at a time to one with a count, before anything is shuffled.
* Pointers are dealt by their first two words, and sorted: a task has the
  whole projection of each of its two-word prefixes, a hot one's as no more
  rows than it has distinct continuations a flush, and grows patterns while
  it reads them in order (``Growth``). It holds a batch and one open prefix, whatever a
  projection's size. Only the counts of single words are summed up afterwards.
* Scores need the counts of a phrase's parts, which are frequent themselves: a join
  of the frequent phrases with themselves. Parts that hold at least one in ``HOT``
  of all occurrences (so at most ``HOT`` for each length) are broadcast; what is left
  is joined by merge, and no such part is in many phrases.

Defined results: texts are split into pieces at ``.,;:!?`` and line breaks, and those
into words at spaces and tabs, A-Z lower-cased; null and empty texts have no words;
a null group is ``und``; repeated rows count as often as they come; ties go
by the phrase's bytes; very long texts are read whole; an empty table gives no rows;
other columns are ignored. Arithmetic is on Python's integers, exact at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, meet, slices

FLUSH, HOT = 1 << 20, 1 << 12
NO_GROUP = "und"
_END = b"\xff"  # in no UTF-8 text
_BYTES = bytes(0xFF if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Pointers:
    """Words of many texts of one group, and their merged pointers."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {_END: 0}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        words = text.encode().translate(_BYTES).replace(_END, b" \xff ").split()
        words.append(_END)
        numbers = self.numbers
        self.parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
        self.size += len(words)

    def merged(self, most: int, before: bytes = b"") -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Distinct pointers (of ``most`` > 1 words at most, each followed by a space)
        behind ``before``, and their counts."""
        words = list(self.numbers)
        at = np.concatenate([*self.parts, np.zeros(most, np.int64)])
        alive = np.flatnonzero(at[: len(at) - most + 1])
        # A pointer's number: that of its words up to here, made dense, and the next word.
        code, chain = at[alive], []
        nxt = code
        for k in range(1, most):
            nxt = np.where(nxt != 0, at[alive + k], 0)
            pair, code = np.unique(code * len(words) + nxt, return_inverse=True)
            chain.append((pair // len(words), pair % len(words)))
        count, spaced = np.bincount(code), [b"", *(w + b" " for w in words[1:])]
        for first in range(0, len(count), 1 << 16):
            row, tail = np.arange(first, min(len(count), first + (1 << 16))), []
            for shorter, word in reversed(chain):
                tail.append(word[row])
                row = shorter[row]
            columns = [[before + spaced[i] for i in row.tolist()], *([spaced[i] for i in c.tolist()] for c in reversed(tail))]
            yield list(map(b"".join, zip(*columns, strict=True))), count[first : first + (1 << 16)]


def pointers(docs: DataFrame, text_col: str, group: Column, most: int) -> DataFrame:
    """``p`` string, ``n`` long: the group in hexadecimal, a line break, and the pointer's
    words, each followed by a space. Of pointers in order, those with the same first
    words are neighbours, whatever characters words have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Pointers] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for g, found in held.items():
                for p, n in found.merged(most, g.encode().hex().encode() + b"\n"):
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()).view(pa.string()), pa.array(n.astype(np.int64))], names=["p", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for piece in slices(batch):
                for g, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if text:
                        found = held.setdefault(g, Pointers())
                        size -= found.size
                        found.add(text)
                        size += found.size
                        if size >= FLUSH:
                            yield from flush()
                            size = 0
        yield from flush()

    rows = docs.select(F.coalesce(group.cast("string"), F.lit(NO_GROUP)).alias("g"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "p string, n long")


class Growth:
    """Depth-first growth over pointers in order, batch by batch.

    A two-word prefix whose projection lies inside a batch is grown by recursion
    over ranges of the batch (``_grow``), if it is frequent at all. A projection
    that touches a batch's border is read pointer by pointer: ``open`` holds the words
    of the prefix being read and ``count`` what has been seen of it, so a hot prefix
    may go on over any number of batches."""

    def __init__(self, most: int, least: int):
        self.most, self.least = most, least
        self.open: list[str] = []
        self.count: list[int] = []
        self.word, self.seen = "", 0  # the single word being read
        self.found: list[tuple[str, int, int]] = []  # pointer, words, count

    def _close(self, depth: int) -> None:
        """Close prefixes longer than ``depth``."""
        while len(self.open) > depth:
            n = self.count.pop()
            if n >= self.least and len(self.open) > 1:
                self.found.append((" ".join(self.open) + " ", len(self.open), n))
            self.open.pop()
            if self.open:
                self.count[-1] += n

    def _read(self, pointer: str, n: int) -> None:
        words = pointer.split(" ")[:-1]
        same = 0
        for a, b in zip(words, self.open):  # noqa: B905  either may be longer
            if a != b:
                break
            same += 1
        self._close(same)
        for w in words[same:]:
            self.open.append(w)
            self.count.append(0)
        self.count[-1] += n

    def _grow(self, low: int, high: int, depth: int, total: int) -> None:
        """Rows ``low`` to ``high`` are the projection of a frequent prefix."""
        self.found.append((self.heads[depth][low].as_py(), depth, total))
        if depth == self.most:
            return
        starts = np.concatenate([[low], low + 1 + np.flatnonzero(self.new[depth + 1][low + 1 : high])])
        sums = np.add.reduceat(self.n[low:high], starts - low)
        for at in np.flatnonzero((sums >= self.least) & (self.words[starts] > depth)).tolist():
            self._grow(int(starts[at]), int(starts[at + 1]) if at + 1 < len(starts) else high, depth + 1, int(sums[at]))

    def _single(self, word: str, n: int) -> None:
        if word != self.word:
            self.end_word()
            self.word = word
        self.seen += n

    def end_word(self) -> None:
        if self.seen:
            self.found.append((self.word, 1, self.seen))
        self.word, self.seen = "", 0

    def read(self, p: pa.StringArray, n: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        """Take a batch in; returns the single words that end in it, with what this
        task has seen of each, frequent or not."""
        rows = len(p)
        at = np.frombuffer(p.buffers()[1], np.int32)[p.offset : p.offset + rows + 1].astype(np.int64)
        spaces = np.flatnonzero(np.frombuffer(p.buffers()[2], np.uint8)[: at[-1]] == 32)
        first = np.searchsorted(spaces, at)
        self.n, self.words = n, np.diff(first)
        self.heads, self.new = [None], [None]
        for d in range(1, self.most + 1):
            ends = np.where(self.words >= d, spaces[np.minimum(first[:-1] + d - 1, len(spaces) - 1)] + 1, at[1:])
            # Each pointer cut in two, and the first parts taken.
            cuts = np.append(np.stack([at[:-1], ends], axis=1).ravel(), at[-1]).astype(np.int32)
            both = pa.StringArray.from_buffers(2 * rows, pa.py_buffer(cuts), p.buffers()[2])
            head = both.take(pa.array(np.arange(0, 2 * rows, 2)))
            self.heads.append(head)
            self.new.append(np.append(True, pc.not_equal(head[1:], head[:-1]).to_numpy(zero_copy_only=False)))
        units = np.append(np.flatnonzero(self.new[2]), rows)
        sums = np.add.reduceat(n, units[:-1])
        edge = {0, len(sums) - 1}
        for u in sorted(edge):
            for pointer, k in zip(p[units[u] : units[u + 1]].to_pylist(), n[units[u] : units[u + 1]].tolist(), strict=True):
                self._read(pointer, k)
        for u in np.flatnonzero((sums >= self.least) & (self.words[units[:-1]] > 1)).tolist():
            if u not in edge:
                self._grow(int(units[u]), int(units[u + 1]), 2, int(sums[u]))
        starts = np.flatnonzero(self.new[1])
        seen = np.add.reduceat(n, starts)
        names = self.heads[1].take(pa.array(starts))
        self._single(names[0].as_py(), int(seen[0]))
        if len(starts) > 1:
            self._single(names[-1].as_py(), int(seen[-1]))
        return names[1:-1], seen[1:-1]

    def end(self) -> None:
        self._close(0)
        self.end_word()


def frequent_phrases(docs: DataFrame, text_col: str, group: Column, most: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(``g``, ``p``, ``k`` words, ``f``) of all contiguous phrases of up to ``most`` words
    that occur ``least`` times, and (``g``, ``n``): all words of each group. Written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Growth(most, least)
        names = ["p", "k", "f"]

        def out() -> Iterator[pa.RecordBatch]:
            if state.found:
                p, k, f = zip(*state.found, strict=True)
                state.found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(k, pa.int32()), pa.array(f, pa.int64())], names=names)

        for batch in batches:
            if batch.num_rows:
                words, seen = state.read(batch.column(0), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([words, pa.array(np.ones(len(words), np.int32)), pa.array(seen)], names=names)
                yield from out()
        state.end()
        yield from out()

    dealt = pointers(docs, text_col, group, most).repartition(F.substring_index("p", " ", 2)).sortWithinPartitions("p")
    grown = materialize(dealt.mapInArrow(run, "p string, k int, f long"), "grown")
    single = grown.where("k = 1").groupBy("p").agg(F.sum("f").alias("f"))
    parts = [F.unhex(F.substring_index("p", "\n", 1)).cast("string").alias("g"), F.rtrim(F.substring_index("p", "\n", -1)).alias("p")]
    totals = single.select(parts[0], "f").groupBy("g").agg(F.sum("f").alias("n"))
    every = grown.where("k > 1").union(single.where(F.col("f") >= least).select("p", F.lit(1).alias("k"), "f"))
    return materialize(every.select(*parts, "k", "f"), "frequent"), totals


def _counts_of(rows: DataFrame, part: str, out: str, frequent: DataFrame, hot: DataFrame) -> DataFrame:
    """Add ``out``: the count of the phrase in column ``part`` in its group."""
    named = lambda df: df.select("g", F.col("p").alias(part), F.col("f").alias(out))
    few = F.broadcast(named(hot))
    rest = rows.join(F.broadcast(named(hot).drop(out)), ["g", part], "left_anti")
    return rows.join(few, ["g", part]).unionByName(meet(rest, named(frequent), ["g", part]))


def _score(a: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array([1_000_000 * x * x // (y * z) for x, y, z in zip(a.to_pylist(), left.to_pylist(), right.to_pylist(), strict=True)], pa.int64())


def collocations(docs: DataFrame, most: int = 3, least: int = 10, inside: int = 50, top: int = 2000, text_col: str = "text", group_col: str | None = "lang") -> DataFrame:
    """Phrases of 2 to ``most`` words that occur ``least`` times or more in their group.

    Cut after its first words into parts with counts ``l`` and ``r``, a phrase of
    count ``a`` scores floor(1000000 * a * a / (l * r)); the cut of the least score
    counts, the earliest of several. Phrases are dropped inside a longer one
    with at least ``inside`` per cent of their count. Returns ``g``, ``rank`` (the first
    ``top`` of each group), ``phrase``, ``a``, ``l``, ``r``, ``n`` (the group's
    words) and ``score``."""
    group = F.col(group_col) if group_col else F.lit("")
    frequent, totals = frequent_phrases(docs, text_col, group, most, least)
    words = frequent.where("k = 1").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    # At most HOT phrases of each length can have that many of the occurrences.
    hot = frequent.where(F.col("f") * HOT >= words)
    w = F.split("p", " ")
    join = lambda start, size: F.array_join(F.slice(w, start, size), " ")
    longer = frequent.where("k > 1")
    cuts = longer.select("g", "p", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": join(F.lit(1), F.col("cut")), "right": join(F.col("cut") + 1, F.col("k") - F.col("cut"))})
    counted = _counts_of(_counts_of(cuts, "left", "l", frequent, hot), "right", "r", frequent, hot)
    scored = counted.withColumn("score", F.arrow_udf(_score, "long")("a", "l", "r")).groupBy("g", "p").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("s"))
    # Every phrase inside a longer one, with the longer one's count.
    sizes = F.sequence(F.lit(2), F.col("k") - 1)
    parts = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.col("k") - s + 1), lambda i: join(i, s))))
    around = longer.where("k > 2").select("g", F.explode(parts).alias("p"), "f").groupBy("g", "p").agg(F.max("f").alias("around"))
    kept = meet(scored, around, ["g", "p"], "left").where(F.col("around").isNull() | (F.lit(100) * F.col("around") < F.lit(inside) * F.col("s.a")))
    kept = kept.select("g", F.col("p").alias("phrase"), "s.a", "s.l", "s.r", "s.score")
    order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).join(totals, "g").select("g", "rank", "phrase", "a", "l", "r", "n", "score")


__all__ = ["collocations", "frequent_phrases", "pointers"]
