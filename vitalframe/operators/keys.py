"""Keys of several fields, of any size.

Sketches of distinct tuples look at many sets in one pass and shuffle next to
nothing; exact counts decide. First a key is climbed to, by the field that tells
most rows apart, and whatever it can spare is taken off. Near the end sketches are
too coarse: then the rows that are still told apart from no other are set aside
(rows alone under some fields stay alone under more) and only those go on. The
size of that key bounds a search by levels for smaller ones, in which a set is
passed over where the product of the counts of its parts falls short.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Sketches have 4,096 registers: a standard error of 1.6 %, of which six are allowed for.
REGISTERS, MARGIN = 12, 0.1
BATCH = 32
#: Sets a level may look at, and may sketch.
LOOKED_AT, SKETCHED = 65_536, 512
SALTS = 16

Set = tuple[str, ...]


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _digest(fields: Iterable[str]) -> Column:
    """A hash passes nulls over: which parts are null goes in as well."""
    return F.xxhash64(*(part for f in fields for part in (_col(f), _col(f).isNull())))


def sketched(df: DataFrame, sets: Sequence[Set]) -> dict[Set, int]:
    """About how many distinct tuples each set of fields has; nulls are values."""
    out: dict[Set, int] = {}
    for i in range(0, len(sets), BATCH):
        part = sets[i : i + BATCH]
        got = df.agg(*(F.hll_sketch_estimate(F.hll_sketch_agg(_digest(s), F.lit(REGISTERS))).alias(f"s{j}") for j, s in enumerate(part))).first()
        out |= dict(zip(part, got))
    return out


def counted(df: DataFrame, fields: Sequence[str]) -> tuple[int, int]:
    """Distinct tuples, and those of a single row; exact, nulls are values."""
    per = df.groupBy(*map(_col, fields)).agg(F.count("*").alias("__n"))
    return tuple(per.agg(F.count("*"), F.count_if(F.col("__n") == 1)).first())


def repeated_rows(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows that share their values of ``fields`` with another row. Values of a
    single row drop out before the join; hot ones are dealt to ``SALTS`` tasks by the
    rest of the row."""
    again = df.groupBy(*map(_col, fields)).agg(F.count("*").alias("__n")).where("__n > 1")
    again = again.select(*(_col(f).alias(f"__{i}") for i, f in enumerate(fields)), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    salted = df.withColumn("__at", F.pmod(_digest(df.columns), F.lit(SALTS)).cast("int"))
    same = F.col("__at") == F.col("__salt")
    for i, f in enumerate(fields):
        same &= _col(f).eqNullSafe(F.col(f"__{i}"))
    return salted.join(again, same, "left_semi").drop("__at")


def _climb(df: DataFrame, fields: Sequence[str], need: float) -> list[str] | None:
    chosen: list[str] = []
    left, alone, rest = list(fields), 0, df
    while left:
        told = sketched(rest, [(*chosen, f) for f in left])
        best = max(left, key=lambda f: (told[(*chosen, f)], -left.index(f)))
        about = told[(*chosen, best)]
        chosen.append(best)
        left.remove(best)
        if alone + about * (1 + MARGIN) < need:
            continue
        distinct, single = counted(rest, chosen)
        if alone + distinct >= need:
            return chosen
        if single and left:
            rest, alone = settle(repeated_rows(rest, chosen)), alone + single
    return None


def _shrink(df: DataFrame, key: list[str], need: float) -> list[str]:
    """Take off what the key can spare, the least telling first."""
    spare = list(reversed(key))
    while spare and len(key) > 1:
        told = sketched(df, [tuple(f for f in key if f != s) for s in spare])
        spare = [s for s in spare if told[tuple(f for f in key if f != s)] * (1 + MARGIN) >= need]
        if not spare:
            break
        s = spare.pop(0)
        smaller = [f for f in key if f != s]
        if counted(df, smaller)[0] >= need:
            key = smaller
    return key


def find_key(df: DataFrame, fields: Sequence[str], least: float = 1.0, distinct: Mapping[str, int] | None = None) -> list[str] | None:
    """The smallest set of ``fields`` whose distinct tuples are at least ``least`` of the
    rows; of those of one size, the first in the order of ``fields``. Nulls are values.
    None where no set is one, or the table is empty. ``distinct`` gives what is known of
    single fields, so that they need no pass.

    A level with more than ``LOOKED_AT`` sets, or ``SKETCHED`` that may be keys, ends the search
    for smaller ones: the key found by climbing is returned, from which no field can be
    taken, though another may be smaller. All counts that decide are exact; a set is
    passed over by its sketch where that lies ``MARGIN`` below what is needed."""
    fields = list(dict.fromkeys(fields))
    if not fields:
        return None
    df = df.select(*(_col(f) for f in fields))
    rows = df.count()
    if not rows:
        return None
    need = least * rows
    singles = {(f,): int(distinct[f]) for f in fields if distinct and f in distinct}
    singles |= sketched(df, [(f,) for f in fields if (f,) not in singles])
    for f in fields:
        if singles[f,] * (1 + MARGIN) >= need and counted(df, [f])[0] >= need:
            return [f]
    fields = [f for f in fields if singles[f,] > 1]
    if not fields or sketched(df, [tuple(fields)])[tuple(fields)] * (1 + MARGIN) < need:
        return None
    climbed = _climb(df, fields, need)
    if climbed is None:
        return None
    best = tuple(f for f in fields if f in set(_shrink(df, climbed, need)))
    return list(_smaller(df, fields, need, {s: n * (1 + MARGIN) for s, n in singles.items()}, best) or best)


def _smaller(df: DataFrame, fields: Sequence[str], need: float, most: dict[Set, float], best: Set) -> Set | None:
    """A key that goes before ``best``: fewer fields, or as many that come first.
    ``most`` bounds the distinct tuples of the sets seen so far."""
    for size in range(2, len(best) + 1):
        if math.comb(len(fields), size) > LOOKED_AT:
            return None
        sets = list(itertools.takewhile(lambda s: s != best, itertools.combinations(fields, size)))
        for s in sets:
            most[s] = min(most.get(s[:i] + s[i + 1 :], math.inf) * most[s[i],] for i in range(size))
        maybe = [s for s in sets if most[s] >= need]
        if len(maybe) > SKETCHED:
            return None
        told = sketched(df, maybe)
        for s in maybe:
            most[s] = min(most[s], told[s] * (1 + MARGIN))
        for s in maybe:
            if most[s] >= need and counted(df, s)[0] >= need:
                return s
    return None
