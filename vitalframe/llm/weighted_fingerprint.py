"""Document fingerprints by consistent weighted sampling (native).

A text is a weighted set: its terms (words of the lower-cased text) with their
counts. For sample j each term draws r ~ Gamma(2,1), c ~ Gamma(2,1) and
b ~ U(0,1) from hashes of (term, j) alone; with t = floor(ln w / r + b) and
ln a = ln c - r (t - b) - r, the sample is the (term, t) of least a. Two texts
agree in a sample with a chance equal to their generalised Jaccard similarity
sum(min w) / sum(max w). ``SAMPLES`` samples make the fingerprint; its likeness
is the share of equal samples.

Plan: (ln a, name of (term, t)) are packed into one long, so a sample is a
plain ``min`` inside code generation. Documents are shuffled once, by *cells* of
the id, so that neighbours meet; aggregation by (cell, row, term) and then by
(cell, row) needs no further shuffle. Quantiles of the id by rows bound the cells;
an id that alone fills several cells is cut by the text's md5. Beyond ``RANGES`` cells
a range of ids is cut evenly, and beyond ``MAX_CELLS`` cells of ``CELL_BYTES`` they grow
(200 MB at 100 TB).

Terms are the words of the lower-cased text; characters of scripts without spaces
are terms of their own. Order of words plays no part.

Defined results: a null text counts as empty; texts without terms have equal,
empty fingerprints and likeness 1 among themselves, 0 to others; an empty table
gives no rows; one document is its own next; a very long text is taken whole; a
null id sorts below all others, equal ids by the text's md5; extra columns are
ignored. The id must be a whole number.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES, CELL_BYTES, RANGES, MAX_CELLS, FAN = 32, 4 << 20, 1 << 14, 1 << 19, 64
#: Where the scripts below lie, at most. A range is quick to test, a script is not.
MAY_BE_UNSPACED = r"[\x{0E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"
UNSPACED = rf"[{MAY_BE_UNSPACED}&&[\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}\p{{IsThai}}\p{{IsLao}}\p{{IsKhmer}}\p{{IsMyanmar}}]]"
LEAST = -(1 << 63)


def sample_key(term: Column, log_weight: Column, j: int) -> Column:
    """Sample j of one weighted term: a long that orders by a and ends in 32
    bits that name (term, t)."""
    h, g = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    unit = lambda x, shift: (F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << 25) - 1)) + F.lit(0.5)) / F.lit(float(1 << 25))
    r = -F.log(unit(h, 0) * unit(h, 25))
    c = -F.log(unit(g, 0) * unit(g, 25))
    b = (F.shiftrightunsigned(h, 50) * (1 << 14) + F.shiftrightunsigned(g, 50)) / F.lit(float(1 << 28))
    t = F.floor(log_weight / r + b)
    log_a = F.log(c) - r * (t - b) - r
    rank = F.floor((F.greatest(F.lit(-127.0), F.least(F.lit(127.0), log_a)) + 128) * F.lit(float(1 << 23)))
    return F.shiftleft(rank, 32).bitwiseOR(term.bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF)))


def terms_of(text: Column) -> Column:
    """Terms of a text as an array (with repeats)."""
    low = F.lower(text)
    apart = F.when((F.octet_length(low) > F.char_length(low)) & low.rlike(UNSPACED), F.regexp_replace(low, f"({UNSPACED})", " $1 ")).otherwise(low)
    return F.filter(F.split(apart, r"[ \t-\r]+"), lambda w: w != "")


def _signatures(exploded: DataFrame, keys: list[str], samples: int) -> DataFrame:
    """From one row per term occurrence (long ``term``) to arrays of samples."""
    counted = exploded.groupBy(*keys, "term").agg(F.log(F.count("*").cast("double")).alias("lw"))
    least = counted.groupBy(*keys).agg(*(F.min(sample_key(F.col("term"), F.col("lw"), j)).alias(f"m{j}") for j in range(samples)))
    return least.select(*keys, F.array(*(F.col(f"m{j}").bitwiseAND(F.lit(0xFFFFFFFF)) for j in range(samples))).alias("sig"))


def fingerprint(df: DataFrame, key: str, text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``key`` (unique per row) and ``sig`` array<long>; rows without terms have
    a null ``sig``."""
    terms = df.select(F.col(key), F.explode(terms_of(F.coalesce(F.col(text_col), F.lit("")))).alias("w")).select(key, F.xxhash64("w").alias("term"))
    return df.select(key).join(_signatures(terms, [key], samples), key, "left")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples; both null: 1, one null: 0."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.lit(float(samples)))


def signature_text(sig: Column) -> Column:
    """Eight hexadecimal digits per sample; empty for a null signature."""
    return F.coalesce(F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), ""), F.lit(""))


def _cell_of(key: Column, bounds: list[int]) -> Column:
    if not bounds:
        return F.lit(0)
    rows = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]
    upper = F.size(F.filter(F.array(*(F.lit(r[0]) for r in rows)), lambda b: b <= key))
    fine = F.array(*(F.array(*map(F.lit, r)) for r in rows))
    return F.when(upper == 0, 0).otherwise((upper - 1) * FAN + F.size(F.filter(F.element_at(fine, F.greatest(upper, F.lit(1))), lambda b: b <= key)))


def _cells(place: Column, text: Column, cut: list[int], fine: int, top: int) -> Column:
    """Cell numbers, rising with (id, md5). A value that comes several times among
    the quantiles fills as many cells, by md5; other ranges are cut in ``fine``."""
    times = Counter(cut)
    bounds = sorted(times)
    hot = {v: n for v, n in times.items() if n > 1}
    wide = [(hot.get(v, 0), fine) for v in [None, *bounds]]  # cells of the bound itself, and behind it
    base = [0]
    for a, b in wide:
        base.append(base[-1] + a + b)
    edges = [LEAST, *bounds, top + 1]
    r = _cell_of(place, bounds)
    at = lambda xs, kind="bigint": F.element_at(F.array(*(F.lit(x) for x in xs)).cast(f"array<{kind}>"), r + 1)
    inside = F.lit(0).cast("bigint")
    if fine > 1:
        lo, hi = at(edges[:-1], "double"), at(edges[1:], "double")
        inside = F.least(F.lit(fine - 1), F.greatest(F.lit(0), F.floor((place.cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * fine))).cast("bigint")
    if not hot:
        return at(base[:-1]) + inside
    n = at([a for a, _ in wide])
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return at(base[:-1]) + F.when((n > 0) & (place == at(edges[:-1])), F.floor(share * n)).otherwise(n + inside)


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text (the last third
    replaced by the start of the next document in descending id, after the last
    the first), with likeness to the edited text and to the next document.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A null id sorts below all others; equal ids are
    ordered by the text's md5.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("o"), text.alias("t"))
    place = F.coalesce("o", F.lit(LEAST))
    whole = rows.agg(F.sum(F.octet_length("t")).alias("b"), F.max(place).alias("top")).first()
    cells = min(MAX_CELLS, max(1, -(-(whole["b"] or 0) // CELL_BYTES)))
    ranges = min(RANGES, cells)
    # At most RANGES numbers.
    cut = rows.agg(F.percentile_approx(place, [i / ranges for i in range(1, ranges)], F.lit(20 * ranges)).alias("q")).first()["q"] if ranges > 1 else []
    rows = rows.withColumn("cell", _cells(place, F.col("t"), cut or [], -(-cells // ranges), whole["top"] or 0).cast("int"))
    tops = sorted(rows.groupBy("cell").agg(F.max(F.struct(F.col("o"), F.md5("t").alias("m"))).alias("x")).collect(), key=lambda r: r["cell"])  # one row per cell
    # The highest row of a cell is also needed, as a guest, at the end of the next
    # cell up; that of the top cell at the end of the lowest one.
    guest_of = [(tops[i]["cell"], tops[i]["x"]["o"], tops[i]["x"]["m"], tops[(i + 1) % len(tops)]["cell"]) for i in range(len(tops))]
    guests = F.broadcast(spark.createDataFrame(guest_of, "of int, top long, m string, to int"))  # one row per cell
    own = F.struct(F.col("cell").alias("cell"), F.lit(0).alias("guest"))
    both = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("cell"), F.lit(1).alias("guest"))))
    # The two uses below need the same columns, so that they share one shuffle.
    dealt = rows.join(guests, (F.col("cell") == F.col("of")) & F.col("o").eqNullSafe(F.col("top")) & (F.md5("t") == F.col("m")), "left").select("o", "t", F.explode(both).alias("x")).select("x.cell", "x.guest", "o", "t").where("cell is not null")
    if tops and tops[-1]["cell"] < 2 * RANGES:
        dealt = dealt.repartitionById(tops[-1]["cell"] + 1, F.col("cell"))  # one task per cell, as cells are even
    order = Window.partitionBy("cell").orderBy("guest", F.desc("o"), F.desc(F.md5("t")))
    near = dealt.select("cell", "guest", "o", "t", F.row_number().over(order).alias("rid"), F.lead("t").over(order).alias("next"))
    n = F.length("t")
    k = F.floor(n / 3).cast("int")
    edited = F.when(F.col("guest") == 1, F.lit("")).otherwise(F.concat(F.substring(F.col("t"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k)))
    near = near.select("cell", "rid", "guest", "o", "t", edited.alias("e"))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("t").alias("x")), F.struct(F.lit(1).alias("kind"), F.col("e").alias("x"))))
    terms = near.select("cell", "rid", kinds.alias("y")).select("cell", "rid", "y.kind", F.explode(terms_of(F.col("y.x"))).alias("w"))
    sigs = _signatures(terms.select("cell", "rid", "kind", F.xxhash64("w").alias("term")), ["cell", "rid", "kind"], samples)
    pair = sigs.groupBy("cell", "rid").agg(F.max(F.when(F.col("kind") == 0, F.col("sig"))).alias("s"), F.max(F.when(F.col("kind") == 1, F.col("sig"))).alias("es"))
    facts = near.select("cell", "rid", "guest", "o", F.length("t").cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"))
    met = facts.join(pair, ["cell", "rid"], "left")
    met = met.withColumn("ns", F.lead("s").over(Window.partitionBy("cell").orderBy("rid"))).where("guest = 0")
    return met.select(
        F.col("o").alias(id_col),
        "n_chars",
        "edited_sha256",
        signature_text(F.col("s")).alias("fingerprint"),
        signature_text(F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("es"), samples).alias("near_edited"),
        likeness(F.col("s"), F.col("ns"), samples).alias("near_next"),
    )
