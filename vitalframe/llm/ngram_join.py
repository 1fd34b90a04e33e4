"""Grouped prefix join on word n-gram sets, and the components of its links.

Two documents link when ``den * |A & B| >= num * |A | B|`` for their sets of
distinct n-word shingles. Steps:

1. A first pass counts shingles in a fixed number of hash buckets. Shingles are
   ordered by (bucket count, hash), so that what many documents share comes
   last. Any order is exact; this one keeps common passages out of prefixes.
2. Each document becomes its set's class (equal sets share one), its size, and
   its prefix, the first ``size - ceil(t * size) + 1`` shingles. Linked sets share
   a prefix shingle. Classes with the same prefix and size form a *group*, and
   only groups are posted under their prefix shingles.
3. Group pairs under a shingle pass a size and a position filter. Under a rare
   shingle all pairs are taken. Under a hot one, each group is paired with the
   most central group only (the one whose prefix has it first): a star, linear in
   the group count. Groups are expanded to classes and verified on full sets.
4. The star's links are contracted to components. Only what could still join
   two components is paired next, in salted blocks: hot shingles whose groups are
   all in one component need no more. Of paired groups only first classes have
   met the other's; where their components differ, the rest is verified as well.
   This makes the links' components exact.

Shingles are 64-bit hashes of their words; classes and groups are named by 128 bits. Defined
results: null or wordless text has an empty set, links with nothing and is its
own component; with fewer than n words the whole sequence is the one shingle;
equal rows are copies of one class; component_id is the least id, nulls aside.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, meet, slices
from .graph import components

BUCKET_BITS, RARE, BLOCK, BLOOM_MAX = 18, 8, 2_000, 1 << 27
PIECE = 1 << 18
_ONE = np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = _ONE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, lower-cased in A-Z, in order."""
    data = (text or "").encode().lower()
    out, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:  # cut behind white space
            end = next((i + 1 for i in range(at + PIECE, len(data)) if _SPACE[data[i]]), len(data))
        b = np.frombuffer(data, np.uint8, end - at, at)
        word = ~_SPACE[b]
        edge = np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(max(PIECE + 64, 1 << (len(b) - 1).bit_length()) if len(b) > PIECE + 64 else PIECE + 64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * up[: len(b)])])
        out.append(_mix((total[stop] - total[start]) * down[start] + (stop - start).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64)."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, np.uint64(k))
    for i in range(k):
        h = _mix(h * _BASE + w[i : len(w) - k + 1 + i])
    return np.unique(h)


def _need(size: Column, num: int, den: int) -> Column:
    """ceil(num * size / den)."""
    return F.floor((size * num + (den - 1)) / F.lit(den)).cast("long")


def _bucket_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Shingles per hash bucket over all documents; 2**BUCKET_BITS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for batch in batches:
            for piece in slices(batch):
                sets = [shingle_set(t, n) for t in piece.column(0).to_pylist()]
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    got = texts.mapInArrow(count, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[got["b"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def _classes(docs: DataFrame, n: int, num: int, den: int, freq: Broadcast) -> DataFrame:
    """One row per document: id, n, class, group and prefix shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = freq.value
        for batch in batches:
            for piece in slices(batch):
                size, cls, gid, prefix = [], [], [], []
                for t in piece.column(1).to_pylist():
                    s = shingle_set(t, n)
                    size.append(len(s))
                    if not len(s):
                        cls.append(None)
                        gid.append(None)
                        prefix.append(None)
                        continue
                    order = np.lexsort((s, f[(s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]))
                    p = s[order[: len(s) + num * -len(s) // den + 1]]
                    cls.append(hashlib.md5(s.tobytes()).digest())
                    gid.append(hashlib.md5(p.tobytes() + len(s).to_bytes(8, "big")).digest())
                    prefix.append(p.view(np.int64))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(size, pa.int32()), pa.array(cls, pa.binary()), pa.array(gid, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))], names=["id", "n", "cls", "gid", "prefix"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, n int, cls binary, gid binary, prefix array<long>")


def _may_link(num: int, den: int) -> Column:
    """Size and position filter for postings a and b under their first common shingle."""
    both = F.col("a.n") + F.col("b.n")
    required = F.floor((both * num + (num + den - 1)) / F.lit(num + den))
    rest = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (F.col("a.n") * den >= F.col("b.n") * num) & (F.col("b.n") * den >= F.col("a.n") * num) & (rest >= required)


def _enough_in_common(pairs: DataFrame, hot: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose overlap can still suffice: common rare prefix shingles (all
    counted), at most the hot ones that both have, and what may lie behind the
    prefix that ends first."""
    k = hot.groupBy("gid").agg(F.count("*").alias("k"))
    met = meet(meet(pairs, k.select(F.col("gid").alias("ga"), F.col("k").alias("ka")), "ga", "left"), k.select(F.col("gid").alias("gb"), F.col("k").alias("kb")), "gb", "left").na.fill(0)
    behind = F.greatest(_need(F.col("na"), num, den), _need(F.col("nb"), num, den)) - 1
    required = F.floor(((F.col("na") + F.col("nb")) * num + (num + den - 1)) / F.lit(num + den))
    return met.where(F.col("c") + F.least("ka", "kb") + behind >= required)


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> tuple[DataFrame, Broadcast]:
    """``wanted(cls, id)`` -> ``(cls, s)``: full sets, from a second look at the
    texts. A Bloom filter of bounded size picks the rows; a full one lets more
    rows through, which the later joins on the class drop."""
    key = F.concat(F.col("cls"), F.encode(F.coalesce(F.col("id").cast("string"), F.lit("")), "utf-8"))
    m = 1 << 16
    count = wanted.count()
    while m < min(BLOOM_MAX, 24 * count):
        m *= 2
    h = F.xxhash64(key)
    bit = F.explode(F.array(h.bitwiseAND(F.lit(m - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(m - 1))))
    words = wanted.select(bit.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("x")).toPandas()
    bloom = np.zeros(m >> 6, np.int64)  # at most BLOOM_MAX bits
    bloom[words["w"].to_numpy(dtype=np.int64)] = words["x"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bloom.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        has = lambda p: int(bits[p >> 6]) >> (p & 63) & 1
        for batch in batches:
            for piece in slices(batch):
                cls, out = [], []
                for i, t in zip(piece.column(0).cast(pa.string()).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    s = shingle_set(t, n)
                    if not len(s):
                        continue
                    c = hashlib.md5(s.tobytes()).digest()
                    h = xxhash.xxh64_intdigest(c + (i or "").encode(), seed=42)
                    if has(h & (m - 1)) and has((h >> 32) & (m - 1)):
                        cls.append(c)
                        out.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=["cls", "s"])

    # A class may come more than once (equal rows); links are then found twice.
    return docs.mapInArrow(run, "cls binary, s array<long>"), shared


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of ``pairs(u, v)`` of classes whose full sets link. Only texts of
    classes that occur in the pairs are turned into sets again."""
    named = pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct()
    found, bloom = _sets_of(docs, meet(named, members.select("cls", "id"), "cls"), n)
    sets = materialize(found, "ngram-sets")
    bloom.destroy()

    @F.arrow_udf("boolean")
    def links(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        av, bv, ao, bo = a.values.to_numpy(), b.values.to_numpy(), a.offsets.to_numpy(), b.offsets.to_numpy()
        for i in range(len(a)):
            x, y = av[ao[i] : ao[i + 1]], bv[bo[i] : bo[i + 1]]
            both = np.concatenate([x, y])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(den * common >= num * (len(both) - common))
        return pa.array(out, pa.bool_())

    full = meet(meet(pairs, sets.select(F.col("cls").alias("u"), F.col("s").alias("x")), "u"), sets.select(F.col("cls").alias("v"), F.col("s").alias("y")), "v")
    return full.where(links("x", "y")).select("u", "v")


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``df``: id, ``n_shingles`` long and ``component_id``."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    freq = df.sparkSession.sparkContext.broadcast(_bucket_counts(docs.select("text"), n))
    rows = materialize(_classes(docs, n, num, den, freq), "ngram-classes")
    freq.destroy()
    members = rows.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.first("gid").alias("gid"))
    members = materialize(members, "ngram-members")
    # The size goes in front of the prefix, so that both uses below share one shuffle.
    groups = rows.where("n > 0").select("gid", F.concat(F.array(F.col("n").cast("long")), F.col("prefix")).alias("np")).groupBy("gid").agg(F.first("np").alias("np"))
    size = F.element_at("np", 1)
    posted = groups.select("gid", size.alias("n"), F.posexplode(F.slice("np", 2, F.size("np"))).alias("pos", "token"))
    # Size and position share one number on their way through the shuffle.
    posted = posted.select("token", "gid", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("np"))
    seen = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = meet(posted, seen, "token").select("token", "gid", "df", F.shiftright("np", 32).cast("int").alias("n"), F.col("np").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))
    posted = materialize(met, "ngram-postings")

    hot = posted.where(F.col("df") > RARE)
    a, b = posted.where(F.col("df") <= RARE).alias("a"), posted.where(F.col("df") <= RARE).alias("b")
    may = _may_link(num, den)
    both = (F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"))
    rare = meet(a, b, (F.col("a.token") == F.col("b.token")) & (F.col("a.gid") < F.col("b.gid"))).select(*both, may.alias("may"))
    rare = materialize(rare.groupBy("ga", "gb", "na", "nb").agg(F.count("*").alias("c"), F.max("may").alias("may")), "ngram-rare")
    # A token's postings are dealt over as many salts as their number asks for.
    blocks = F.ceil(F.col("df") / BLOCK).cast("int")
    salted = hot.withColumn("salt", F.pmod(F.xxhash64("gid"), blocks).cast("int"))
    centre = hot.groupBy("token", "df").agg(F.min(F.struct("pos", "n", "gid")).alias("c"))
    centre = centre.select("token", "c.*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("salt"))
    star = meet(salted.alias("a"), centre.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt"))).where((F.col("a.gid") != F.col("b.gid")) & may).select(*both)
    turned = F.col("ga") > F.col("gb")
    pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    star = star.select(pick("ga", "gb", "ga"), pick("gb", "ga", "gb"), pick("na", "nb", "na"), pick("nb", "na", "nb"), F.lit(0).cast("long").alias("c"), F.lit(True).alias("may")).distinct()
    found = rare.union(star).groupBy("ga", "gb", "na", "nb").agg(F.max("c").alias("c"), F.max("may").alias("may")).where("may")
    gid_pairs = materialize(_enough_in_common(found, hot, num, den).select("ga", "gb"), "ngram-group-pairs")

    # Groups of several classes: a star of their own, and their first class stands for them.
    heads = members.groupBy("gid").agg(F.min("cls").alias("head"), F.count("*").alias("k"))
    inner = meet(members, heads.where("k > 1"), "gid").where("cls != head").select(F.col("head").alias("u"), F.col("cls").alias("v"))
    named = meet(meet(gid_pairs, heads.select(F.col("gid").alias("ga"), F.col("head").alias("ha")), "ga"), heads.select(F.col("gid").alias("gb"), F.col("head").alias("hb")), "gb")
    left = meet(named, members.select(F.col("gid").alias("gb"), F.col("cls").alias("c")), "gb").select(F.col("ha").alias("u"), F.col("c").alias("v"))
    right = meet(named, members.select(F.col("gid").alias("ga"), F.col("cls").alias("c")), "ga").select(F.col("hb").alias("u"), F.col("c").alias("v"))
    ordered = lambda x: x.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct()
    first = materialize(ordered(inner.union(left).union(right)), "ngram-pairs")

    links = materialize(_verified(first, members, docs, n, num, den), "ngram-links")
    found = components(links)

    # What could still join two components.
    comp = meet(members, found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "gid", F.coalesce("root", "cls").alias("comp"))
    comp = materialize(comp, "ngram-components")
    of_group = comp.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    open_ = meet(hot, of_group, "gid")
    mixed = open_.groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo != hi").select("token")
    open_ = materialize(meet(open_, mixed, "token", "left_semi"), "ngram-open")
    a = open_.withColumn("salt", F.pmod(F.xxhash64("gid"), blocks).cast("int")).alias("a")
    b = open_.withColumn("salt", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("b")
    apart = (F.col("a.lo") != F.col("b.lo")) | (F.col("a.hi") != F.col("b.hi")) | (F.col("a.lo") != F.col("a.hi"))
    more = meet(a, b, (F.col("a.token") == F.col("b.token")) & (F.col("a.salt") == F.col("b.salt"))).where((F.col("a.gid") < F.col("b.gid")) & may & apart)
    more = meet(more.select(*both).distinct(), rare.select("ga", "gb", "c"), ["ga", "gb"], "left").na.fill(0, ["c"])
    more = _enough_in_common(more, hot, num, den).select("ga", "gb")
    several = comp.groupBy("gid").agg(F.count("*").alias("k"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("k > 1")
    # Heads have met every class of a paired group: what is left is between two groups of several classes.
    of_pair = lambda g, x: several.select(F.col("gid").alias(g), F.col("lo").alias(f"lo{x}"), F.col("hi").alias(f"hi{x}"))
    split = meet(meet(gid_pairs, of_pair("ga", "a"), "ga"), of_pair("gb", "b"), "gb").where("loa != lob or hia != hib or loa != hia").select("ga", "gb")
    more = more.union(several.where("lo != hi").select("gid", "gid")).union(split).distinct()
    side = lambda g, c, k: comp.select(F.col("gid").alias(g), F.col("cls").alias(c), F.col("comp").alias(k))
    second = meet(meet(more, side("ga", "u", "cu"), "ga"), side("gb", "v", "cv"), "gb").where("cu != cv").select("u", "v")
    second = materialize(meet(ordered(second), first, ["u", "v"], "left_anti"), "ngram-pairs")
    if not second.isEmpty():
        extra = materialize(_verified(second, members, docs, n, num, den), "ngram-links")
        if not extra.isEmpty():
            found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).where("u != v").union(extra))

    # The least id of a component comes from its classes; rows are joined once, by class.
    placed = meet(members.select("cls", "id"), found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "id", F.coalesce("root", "cls").alias("comp"))
    least = placed.groupBy("comp").agg(F.min("id").alias("least"))
    named = meet(placed, least, "comp").select("cls", "least")
    out = meet(rows.select("id", "n", "cls"), named, "cls", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))
