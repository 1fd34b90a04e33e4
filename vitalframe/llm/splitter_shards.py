"""Sharding by sampled splitters (native: DataFrame operations only).

Law ``bytes``: records are range-partitioned by key between splitters that are
chosen so that shards are nearly equal in size. Splitters come from a
*size-weighted* sample of the keys: a record is drawn with a chance in
proportion to its size (decided by a hash of its key, so reruns agree).
Quantiles of the sample bound the first ranges, whose exact sizes are counted.
Ranges of more than twice their share are subdivided by a denser sample of
their own, until none can be. The range that holds the end of a shard is then
sampled more and more densely, till it is small enough to read, and the key
where the shard ends becomes a splitter. A record's shard is the number of
shard splitters up to its key; its slot is its place in its range, plus the
records of its shard's ranges before. No window sees more than one range.

No shard is more than one record's size over its share. Keys should be unique (a
text hash followed by the id is), so that a hot text can be cut between ids.
Defined results: an empty table gives no rows; a record larger than a shard's
share fills one alone and others may then be empty; records that all have size 0 are
one shard; a null text has size 0
before the constant; a very long one is one record; rows with equal keys (same
text, same id) are interchangeable and stay in one shard; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

RANGE_ROWS, DRAWS, FAN, FEW_ROWS, END_DRAWS, MOST_RANGES = 1_000_000, 16, 32, 8_000, 64.0, 1 << 12


def _range_of(key: Column, bounds: list[str]) -> Column:
    """Number of bounds that are at most ``key``, by two levels of comparison."""
    if not bounds:
        return F.lit(0)
    rows = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]
    heads = F.array(*(F.lit(r[0]) for r in rows))
    fine = F.array(*(F.array(*map(F.lit, r)) for r in rows))
    upper = F.size(F.filter(heads, lambda b: b <= key))
    return F.when(upper == 0, 0).otherwise((upper - 1) * FAN + F.size(F.filter(F.element_at(fine, F.greatest(upper, F.lit(1))), lambda b: b <= key)))


def _draw(key: Column, size: Column, per_byte: Column) -> Column:
    """Whether a record enters the sample: chance size x per_byte."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("splitters"), key), 11)).cast("double") / F.lit(float(1 << 53))
    return u < size * per_byte


def _quantiles(keys: list[str], parts: int) -> list[str]:
    """At most ``parts - 1`` distinct bounds from sorted keys."""
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def _sampled(rows: DataFrame, key: str, size: str, g: Column | None, per_byte: Column, salt: str) -> dict[int, list[str]]:
    """Drawn keys by range, sorted. Expected number: what the callers ask for in
    all, some ten thousands; each record is drawn or not by its own hash."""
    drawn = rows.withColumn("__g", F.lit(0) if g is None else g).where(_draw(F.concat(F.lit(salt), F.col(key)), F.col(size), per_byte))
    out: dict[int, list[str]] = {}
    for r in drawn.select("__g", F.col(key).alias("k")).distinct().collect():
        out.setdefault(r["__g"], []).append(r["k"])
    return {g: sorted(ks) for g, ks in out.items()}


def _sums(rows: DataFrame, key: str, size: str, bounds: list[str]) -> list[tuple[int, int, int]]:
    """(bytes, records, largest record) of every range: one row per range."""
    got = rows.groupBy(_range_of(F.col(key), bounds).alias("g")).agg(F.sum(size).alias("b"), F.count("*").alias("n"), F.max(size).alias("m")).collect()
    by = {r["g"]: (r["b"], r["n"], r["m"]) for r in got}
    return [by.get(g, (0, 0, 0)) for g in range(len(bounds) + 1)]


def _even_ranges(rows: DataFrame, key: str, size: str, total: int, ranges: int) -> tuple[list[str], list[tuple[int, int, int]]]:
    """Bounds of ranges with about ``total / ranges`` bytes each, and their sums."""
    share, at = total / ranges, 0
    bounds = _quantiles(_sampled(rows, key, size, None, F.lit(DRAWS / share), "").get(0, []), ranges)
    alone: set[str] = set()  # lower bounds of ranges that hold one key only
    while True:
        sums = _sums(rows, key, size, bounds)
        low = ["", *bounds]
        over = {g: s for g, s in enumerate(sums) if s[0] > 2 * share and s[1] > 1 and s[0] > 2 * s[2] and low[g] not in alone}
        if not over:
            return bounds, sums
        at += 1
        g = _range_of(F.col(key), bounds)
        drawn = _sampled(rows.where(g.isin(*over)), key, size, g, F.lit(DRAWS * 4.0**at / share), str(at))
        alone |= {low[r] for r in over if set(drawn.get(r, ())) <= {low[r]} and DRAWS * 4.0**at >= 64}
        more = {b for r, keys in drawn.items() for b in _quantiles(keys, -(-int(over[r][0]) // int(max(1, share))) + 1)}
        bounds = sorted(more | set(bounds))


def _shard_ends(rows: DataFrame, key: str, size: str, bounds: list[str], sums: list[tuple[int, int, int]], total: int, shards: int) -> list[str]:
    """The first keys of shards 1, 2, ...: of each, the first record that begins at
    or behind the shard's share of all bytes."""
    ends: dict[int, str] = {}
    # Per shard still open: the keys around its end, and the bytes before them.
    open_: dict[int, tuple[str, str | None, int]] = {}

    def descend(j: int, keys: list[str], sizes: list[int], before: int, low: str, high: str | None) -> None:
        """``keys`` bound ranges of ``sizes`` bytes between ``low`` and ``high``."""
        edges = [low, *keys, high]
        for i, b in enumerate(sizes):
            if (before + b) * shards > j * total or i == len(sizes) - 1:
                open_[j] = (edges[i], edges[i + 1], before)
                return
            before += b

    for j in range(1, shards):
        descend(j, bounds, [s[0] for s in sums], 0, "", None)
    at = 0
    while open_:
        at += 1
        spans = sorted({(lo, hi or "", before) for lo, hi, before in open_.values()})
        span = F.lit(-1)
        for i, (lo, hi, _) in enumerate(spans):  # at most one per shard
            span = F.when((F.col(key) >= lo) & ((F.col(key) < hi) if hi else F.lit(True)), i).otherwise(span)
        near = rows.withColumn("__s", span).where("__s >= 0")
        facts = {r["__s"]: (r["b"], r["n"]) for r in near.groupBy("__s").agg(F.sum(size).alias("b"), F.count("*").alias("n")).collect()}
        few = [i for i in range(len(spans)) if facts.get(i, (0, 0))[1] <= FEW_ROWS]
        small: dict[int, list[tuple[str, int]]] = {}
        if few:  # FEW_ROWS rows a shard at most
            for r in near.where(F.col("__s").isin(*few)).select("__s", F.col(key).alias("k"), F.col(size).alias("b")).collect():
                small.setdefault(r["__s"], []).append((r["k"], r["b"]))
        large = [i for i in range(len(spans)) if i not in few]
        drawn: dict[int, list[str]] = {}
        if large:
            per_byte = F.lit(0.0)
            for i in large:
                per_byte = F.when(F.col("__s") == i, END_DRAWS * 4**at / facts[i][0]).otherwise(per_byte)
            drawn = _sampled(near, key, size, F.col("__s"), per_byte, f"end{at}")
        cuts = sorted({k for i, keys in drawn.items() for k in keys})
        parts = {(r["s"], r["c"]): r["b"] for r in near.where(F.col("__s").isin(*large)).groupBy(F.col("__s").alias("s"), _range_of(F.col(key), cuts).alias("c")).agg(F.sum(size).alias("b")).collect()} if large else {}
        for j, (lo, hi, before) in list(open_.items()):
            i = spans.index((lo, hi or "", before))
            if i in few:
                upto = before
                for k, b in sorted(small.get(i, [])):
                    if upto * shards >= j * total:
                        ends[j] = k
                        break
                    upto += b
                else:
                    ends[j] = hi if hi is not None else "\uffff"  # nothing is left: an empty shard
                del open_[j]
                continue
            keys = [k for k in drawn.get(i, []) if k > lo]
            sizes = [parts.get((i, bisect.bisect_right(cuts, k)), 0) for k in [lo, *keys]]
            if not keys:
                if END_DRAWS * 4**at / facts[i][0] > 1:  # all drawn: equal keys alone
                    ends[j] = lo if before * shards >= j * total else (hi if hi is not None else "\uffff")
                    del open_[j]
                continue
            descend(j, keys, sizes, before, lo, hi)
    return [ends[j] for j in range(1, shards)]


def shard_by_splitters(records: DataFrame, size: str, key: str, shards: int) -> DataFrame:
    """Add ``shard`` int and ``slot`` long (gapless from 0 in each shard).

    ``records`` needs a long column ``size`` and a string column ``key``; keep
    it narrow, as it is written once to the shared folder.
    """
    rows = materialize(records, "shard-records")
    whole = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    total = whole["b"]
    if not whole["n"]:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    if not total:  # nothing to balance: one shard, its ranges of equal counts
        return shard_by_splitters(rows.withColumn("__one", F.lit(1).cast("long")), "__one", key, 1).drop("__one")
    ranges = min(MOST_RANGES, max(4 * shards, -(-whole["n"] // RANGE_ROWS)))
    bounds, sums = _even_ranges(rows, key, size, total, ranges)
    ends = _shard_ends(rows, key, size, bounds, sums, total, shards)
    # Shard splitters bound ranges too, so that a range lies in one shard.
    bounds = sorted({*bounds, *ends} - {""})
    counts = [n for _, n, _ in _sums(rows, key, size, bounds)]
    # Before a range: the records of its shard's earlier ranges.
    starts = [0] * len(counts)
    for g in range(1, len(counts)):
        starts[g] = 0 if bounds[g - 1] in ends else starts[g - 1] + counts[g - 1]
    before = F.element_at(F.array(*map(F.lit, starts)), F.col("__g") + 1).cast("long")  # a number per range
    inside = Window.partitionBy("__g").orderBy(key)
    shard = F.size(F.filter(F.array(*map(F.lit, ends)), lambda b: b <= F.col(key))) if ends else F.lit(0)
    placed = rows.withColumn("__g", _range_of(F.col(key), bounds).cast("int")).withColumn("slot", before + F.row_number().over(inside) - 1)
    return placed.withColumn("shard", shard.cast("int")).drop("__g")


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard documents by size: id, size (UTF-8 bytes plus 8), text_crc32, shard, slot.
    The key is the text's md5 followed by the id."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordered = F.lpad(F.hex(F.col(id_col).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    records = docs.select(
        F.col(id_col), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.concat(F.md5(text), F.coalesce(ordered, F.lit(""))).alias("__key")
    )
    return shard_by_splitters(records, "size", "__key", shards).drop("__key")
