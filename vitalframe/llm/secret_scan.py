"""Secret scans (native: DataFrame operations only).

Base spans: three kinds of regular expressions. Added spans (kind ``random``):
runs of encoding characters that are random strings and no ordinary text. For
each candidate the encoding is inferred from its characters (digits, hex,
base32, alphanumeric, base64; padding and group marks aside), and a battery is
run on it: chi-squared uniformity over that alphabet, the number of runs above
and below the middle, and lag-one serial correlation.

* Null: the string is ordinary text. How often each character occurs is counted
  over all documents; that gives mean and variance of chi-squared for a text of
  just this length in this alphabet, and with them the p-value of a string that
  is as even as the candidate. A Benjamini-Hochberg step in each band of lengths
  picks the discoveries: of the strings reported, at most a share ``q`` is
  expected to be ordinary text. p-values of distinct strings are counted in bins
  of their logarithm, so the step needs some thousand counts and no global sort.
* A discovery must also pass as random: Fisher's joint p-value of the three
  tests, under randomness, is ``LEAST_RANDOM`` or more. That leaves out strings
  that are even but ordered (alphabets, counters, repeats).

Positions are code points, end exclusive: ``split`` and ``regexp_extract_all``
walk the same matches, so lengths of gaps and matches add up to positions.
Defined results: null text counts as empty; no spans give an empty string and
its hash; an added span that overlaps a base span is left out; equal texts get
equal spans; an empty table gives no rows. A very long text with many matches is
worked in blocks of ``BLOCK`` matches. Extra columns are ignored unless kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kinds and their expressions.
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # greedy AKIA[A-Z0-9]+ of 16 or more
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"  # greedy [0-9a-f]+ of 32 or more
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (  # the first whose characters suffice, once marks of groups and padding are taken out
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", DIGITS + LOWER[:6]),
    (r"^[0-9A-F]+$", DIGITS + UPPER[:6]),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z]+$", UPPER),
    (r"^[A-Z2-7]+$", UPPER + DIGITS[2:8]),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Z]+$", DIGITS + UPPER),
    (r"^[A-Za-z]+$", UPPER + LOWER),
    (r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS),
    (r"^[0-9A-Za-z+/]+$", UPPER + LOWER + DIGITS + "+/"),
)
FALSE_DISCOVERY, LEAST_RANDOM, LENGTH_BANDS, LEAST_LENGTH = 0.05, 0.01, (16, 20, 24, 32, 48, 64, 128), 16
BINS_PER_UNIT, MAX_BIN, BLOCK = 20, 4000, 512

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _scan(xs: Column, op, zero: int) -> Column:
    """Running ``op`` over an array<int>, in blocks: the work for n elements is
    n x BLOCK + (n / BLOCK)^2, not n^2."""
    grow = lambda acc, x: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(zero)), x)))
    none = F.array().cast("array<int>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda c: F.slice(xs, c * BLOCK + 1, BLOCK))
    inner = F.transform(chunks, lambda ch: F.aggregate(ch, none, grow))
    offsets = lambda done: F.aggregate(F.transform(done, lambda ch: F.element_at(ch, -1)), F.array(F.lit(zero)), grow)
    joined = F.transform(F.array(F.struct(inner.alias("i"))), lambda s: F.flatten(F.zip_with(s["i"], F.slice(offsets(s["i"]), 1, F.size(s["i"])), lambda ch, o: F.transform(ch, lambda x: op(o, x)))))
    return F.when(F.size(xs) > 0, joined[0]).otherwise(none)


def _spans(text: Column, pattern: str, kind: int, ok=None, group: int | None = None) -> Column:
    """(start, kind, end) of the matches, with those dropped that fail ``ok``."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits

    def place(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["hits"])), x["hits"], lambda g, h: F.length(g) + F.length(h))
        ends = _scan(steps, lambda a, b: a + b, 0)
        zipped = F.arrays_zip(ends.alias("end"), x["hits"].alias("hit"), x["parts"].alias("part"))
        kept = F.filter(zipped, lambda y: ok(y["part"])) if ok else zipped
        return F.transform(kept, lambda y: F.struct((y["end"] - F.length(y["hit"])).alias("start"), F.lit(kind).alias("kind"), y["end"].alias("end")))

    return F.transform(F.array(F.struct(gaps.alias("gaps"), hits.alias("hits"), parts.alias("parts"))), place)[0].cast(_SPAN)


def _tail(z: Column) -> Column:
    """P(N > z) for any z (Abramowitz and Stegun 26.2.17)."""
    return F.transform(F.array(z.cast("double")), _tail_of)[0]


def _tail_of(z: Column) -> Column:
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    # Fixed values of the approximation.
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.greatest(F.when(z >= 0, upper).otherwise(1 - upper), F.lit(1e-300))


def encoding_of(s: Column) -> Column:
    """Number of the inferred encoding."""
    out = F.when(s.rlike(ENCODINGS[0][0]), 0)
    for i, (pattern, _) in enumerate(ENCODINGS[1:], 1):
        out = out.when(s.rlike(pattern), i)
    return out.otherwise(len(ENCODINGS) - 1)


def bare(s: Column) -> Column:
    """A candidate without padding and marks between groups."""
    return F.regexp_replace(s, "[-_=]", "")


def character_counts(df: DataFrame, text: Column) -> dict[str, int]:
    """Occurrences of each encoding character over all texts: one row."""
    n = lambda c: F.sum(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    chars = UPPER + LOWER + DIGITS + "+/"
    got = df.agg(*(n(c).cast("long").alias(f"c{i}") for i, c in enumerate(chars))).first()
    return {c: got[f"c{i}"] or 0 for i, c in enumerate(chars)}


def text_moments(counts: dict[str, int]) -> list[tuple[float, float]]:
    """Per encoding: sums of squares and cubes of the shares that its characters
    have in ordinary text (each counted once more than it occurs). In an encoding
    of one case a letter counts in both: text may stand in capitals."""
    out = []
    for _, alphabet in ENCODINGS:
        fold = not (set(UPPER) & set(alphabet) and set(LOWER) & set(alphabet))
        n = [sum(counts[x] for x in ({c.lower(), c.upper()} if fold else {c})) + 1 for c in alphabet]
        out.append((sum((x / sum(n)) ** 2 for x in n), sum((x / sum(n)) ** 3 for x in n)))
    return out


def battery(s: Column, moments: Sequence[tuple[float, float]]) -> Column:
    """For a bare string: ``text``, the p-value of being that even if it were
    ordinary text, and ``random``, the joint p-value of the three tests under
    randomness (small: structured)."""
    alphabets = F.array(*(F.lit(a) for _, a in ENCODINGS))
    twos, threes = F.array(*(F.lit(m[0]) for m in moments)), F.array(*(F.lit(m[1]) for m in moments))
    named = F.array(F.struct(s.alias("s"), (encoding_of(s) + 1).alias("e"), F.split(s, "").alias("c")))
    typed = F.transform(named, lambda x: F.struct(x["s"].alias("s"), x["c"].alias("c"), F.element_at(alphabets, x["e"]).alias("a"), F.element_at(twos, x["e"]).alias("s2"), F.element_at(threes, x["e"]).alias("s3")))
    facts = F.transform(
        typed,
        lambda x: F.struct(
            x["s2"].alias("s2"), x["s3"].alias("s3"), F.length(x["a"]).cast("double").alias("a"), F.length(x["s"]).cast("double").alias("n"), F.transform(x["c"], lambda c: F.position(c, x["a"]) - 1).alias("v"),
            F.aggregate(F.array_distinct(x["c"]), F.lit(0.0), lambda acc, c: acc + F.pow(F.length(x["s"]) - F.length(F.replace(x["s"], c, F.lit(""))), F.lit(2.0))).alias("squares"),
        ),
    )
    return F.transform(facts, _judge)[0]


def _judge(x: Column) -> Column:
    n, a, v = x["n"], x["a"], x["v"]
    chi = a / n * x["squares"] - n
    # Ordinary text: moments of chi-squared for a multinomial that isn't even.
    s2, s3 = x["s2"], x["s3"]
    mean = a * (1 - s2 + n * s2) - n
    spread = a / n * F.sqrt(F.greatest(F.lit(1e-9), 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)))
    text_p = _tail((mean - chi) / spread)
    df = a - 1
    w = 2 / (9 * df)
    chi_z = (F.cbrt(F.greatest(F.lit(0.0), chi) / df) - (1 - w)) / F.sqrt(w)
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
    runs = 1 + F.aggregate(pairs, F.lit(0), lambda acc, y: acc + F.when((y["p"] >= a / 2) != (y["q"] >= a / 2), 1).otherwise(0))
    runs_z = (runs - (n + 1) / 2) / (F.sqrt(n - 1) / 2)
    mid = (a - 1) / 2
    serial = F.aggregate(pairs, F.lit(0.0), lambda acc, y: acc + (y["p"] - mid) * (y["q"] - mid))
    serial_z = serial / ((a * a - 1) / 12) / F.sqrt(n - 1)
    # Too even counts as structured as well (an alphabet in order, say).
    both = lambda z: F.log(F.least(F.lit(1.0), 2 * _tail(F.abs(z))))
    h = -(both(chi_z) + both(runs_z) + both(serial_z))  # half of Fisher's chi-squared with six degrees of freedom
    return F.struct(text_p.alias("text"), F.greatest(F.exp(-h) * (1 + h + h * h / 2), F.lit(1e-300)).alias("random"))


def _band(n: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(LENGTH_BANDS):
        out = F.when(n >= least, i).otherwise(out)
    return out


def scan(df: DataFrame, text_col: str = "text", q: float = FALSE_DISCOVERY, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then ``base`` and ``added``: sorted arrays of
    (start, kind, end) with kind an index of ``KINDS``; ``n_tested`` candidates
    (in base spans too) and how many of them are discoveries, ``n_random``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    named = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | low.contains("api")
    none = F.array().cast(_SPAN)
    t = F.col("__t")
    base = F.array_sort(
        F.concat(
            F.when(F.col("__named"), _spans(t, ASSIGN, 0, lambda g: F.length(g) >= 8, 2)).otherwise(none),
            F.when(t.contains("AKIA"), _spans(t, ACCESS, 1)).otherwise(none),
            F.when(t.rlike(HEX), _spans(t, HEX, 2)).otherwise(none),
        )
    )
    placed = F.when(t.rlike(CANDIDATE), _spans(t, CANDIDATE, 3, lambda s: F.length(bare(s)) >= LEAST_LENGTH)).otherwise(none)
    moments = text_moments(character_counts(df, text))
    found = df.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), text.alias("__t"), named.alias("__named"))
    found = found.select(*(f"__k{i}" for i in range(len(keep))), "__t", base.alias("base"), placed.alias("at"))
    piece = lambda s: bare(F.substring(F.col("__t"), s["start"] + 1, s["end"] - s["start"]))
    judged = F.transform("at", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(piece(s)).alias("n"), battery(piece(s), moments).alias("p")))
    tested = F.transform(judged, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _band(s["n"]).alias("band"), F.least(F.lit(MAX_BIN), F.floor(-F.log(s["p"]["text"]) * BINS_PER_UNIT).cast("int")).alias("bin"), (s["p"]["random"] >= LEAST_RANDOM).alias("random"), F.xxhash64(piece(s)).alias("h")))
    # Benjamini-Hochberg per band on counts of distinct strings (copies are one
    # test): one row per band and bin. The texts are scanned again for the result,
    # which is cheaper than keeping them.
    counts = found.select(F.explode(tested).alias("x")).select("x.band", "x.bin", "x.h").distinct().groupBy("band", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("bin"))
    ranked = counts.select("band", "bin", F.sum("n").over(down).alias("k"), F.sum("n").over(Window.partitionBy("band")).alias("m"))
    cut = ranked.where(F.exp(-F.col("bin") / BINS_PER_UNIT) <= q * F.col("k") / F.col("m")).groupBy("band").agg(F.min("bin").alias("cut")).collect()  # one row per band
    least = {r["band"]: r["cut"] for r in cut}
    limit = F.array(*(F.lit(least.get(b, MAX_BIN + 1)) for b in range(len(LENGTH_BANDS))))
    rows = found.withColumn("tested", tested)
    secret = F.filter("tested", lambda s: s["random"] & (s["bin"] >= F.element_at(limit, s["band"] + 1)))
    rows = rows.withColumn("secret", secret)
    free = F.filter("secret", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    added = F.transform(free, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    return rows.select(*(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)), "base", F.array_sort(added).alias("added"), F.size("tested").cast("long").alias("n_tested"), F.size("secret").cast("long").alias("n_random"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each of the sorted spans replaced by ``mark`` (overlaps once)."""

    def done(x: Column) -> Column:
        ends = _scan(F.transform(x["s"], lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
        before = F.slice(F.concat(F.array(F.lit(0)), ends), 1, F.size(ends))
        place = F.filter(F.arrays_zip(x["s"].alias("s"), before.alias("at"), ends.alias("end")), lambda y: y["s"]["start"] >= y["at"])
        pieces = F.transform(place, lambda y: F.concat(F.substring(text, y["at"] + 1, y["s"]["start"] - y["at"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(ends) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(F.transform(F.array(F.struct(spans.alias("s"))), done)[0])
