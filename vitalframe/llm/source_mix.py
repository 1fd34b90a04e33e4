"""Mixing overlapping sources to target weights by min-cost flow.

A text may occur in several sources, and a row may itself belong to several.
Texts are aggregated by *membership pattern*: the set of all sources in which
the text occurs. The rows of a pattern that belong to the same sources form a
*cell*. A flow network decides how many words each cell gives:

* start -> pattern: the words of the pattern's distinct texts, again and again at
  a rising cost (first copy, second, third and fourth, next four, ...), so that
  repeats are convex in cost, in whatever source they come;
* pattern -> cell: at most ``copies`` times the cell's words;
* cell -> quota of each of its sources -> end: the source's target.

The flow is a cheapest maximum one, on exact integers. Then documents are picked
per cell in a seeded order until the routed words are reached. Shared cells come
first; what their whole documents leave of a target, the cell of the source's
own texts takes, so rounding doesn't add up.

Scale: texts are grouped by digest, in narrow rows. One row per cell reaches the
driver; patterns beyond the ``MAX_PATTERNS`` largest are split into their rows'
own sources (no row or word is lost, only their repeats are priced apart).
Picking needs a running sum per cell; a hot one is cut into parts of about
``CELL_ROWS`` documents, whose sums are added up first, so no window sees a whole
cell. What comes out is one place in the seeded order per cell: whole texts are
joined with small tables only, unless more than ``BROADCAST_TEXTS`` texts are shared.

Defined results: a null text has size 0 and counts as empty; a null source is a
source of its own, last in order; no documents, no rows; rows that agree in id
and text are taken together; a very long text is one document, and its source
misses its target by at most half of it. Columns that clash are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, meet

MAX_PATTERNS, CELL_ROWS, BROADCAST_TEXTS = 20_000, 5_000, 200_000
WEIGHTS, SHARE, MAX_COPIES = (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null: 0."""
    # A word ends where its last character is followed by white space or nothing.
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^ \t-\r]+", "w")
    return F.length(F.regexp_replace(squeezed, r"[ \t-\r]+", "")).cast("long")


def quotas(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, most: float = MAX_COPIES) -> list[float]:
    """Targets in proportion to ``weights`` that sum to ``share`` of all sizes;
    none is above ``most`` times its size, and the excess goes to the others."""
    whole, open_ = share * sum(sizes), set(range(len(sizes)))
    capped: set[int] = set()
    while open_:
        left = whole - most * sum(sizes[i] for i in capped)
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left / weight * weights[i] > most * sizes[i]}
        if not over:
            return [float(most * s) if i in capped else left / weight * weights[i] for i, s in enumerate(sizes)]
        capped |= over
        open_ -= over
    return [float(most * s) for s in sizes]


class _Network:
    """Arcs come in pairs: arc ``e`` and its reverse ``e ^ 1``."""

    def __init__(self, n: int):
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.cap: list[int] = []

    def add(self, a: int, b: int, cap: int) -> int:
        e = len(self.to)
        self.out[a].append(e)
        self.out[b].append(e + 1)
        self.to += [b, a]
        self.cap += [cap, 0]
        return e

    def fill(self, s: int, t: int) -> None:
        """Push what still fits from ``s`` to ``t``: shortest paths, layer by layer."""
        out, to, cap = self.out, self.to, self.cap
        while True:
            layer = [-1] * len(out)
            layer[s], queue = 0, [s]
            for v in queue:
                for e in out[v]:
                    if cap[e] > 0 and layer[to[e]] < 0:
                        layer[to[e]] = layer[v] + 1
                        queue.append(to[e])
            if layer[t] < 0:
                return
            at, path, v = [0] * len(out), [], s
            while True:
                if v == t:
                    push = min(cap[e] for e in path)
                    for e in path:
                        cap[e] -= push
                        cap[e ^ 1] += push
                    first = next(i for i, e in enumerate(path) if not cap[e])
                    v = to[path[first] ^ 1]
                    del path[first:]
                    continue
                while at[v] < len(out[v]):
                    e = out[v][at[v]]
                    if cap[e] > 0 and layer[to[e]] == layer[v] + 1:
                        break
                    at[v] += 1
                else:
                    if v == s:
                        break
                    e = path.pop()
                    v = to[e ^ 1]
                    at[v] += 1
                    continue
                path.append(e)
                v = to[e]


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], s: int, t: int) -> list[int]:
    """Flow per arc (from, to, capacity, cost) of a cheapest maximum flow. Only arcs
    out of ``s`` may cost: what flows out of them is then a base of a polymatroid,
    so opening them by rising cost, and filling each time, is optimal."""
    if any(w and a != s for a, _, _, w in arcs):
        raise ValueError("only arcs from the start may have a cost")
    net, ids = _Network(n), []
    for a, b, c, w in arcs:
        ids.append(net.add(a, b, 0 if a == s else c))
    by_cost: dict[int, list[int]] = defaultdict(list)
    for i, (a, _, _, w) in enumerate(arcs):
        if a == s:
            by_cost[w].append(i)
    for w in sorted(by_cost):
        for i in by_cost[w]:
            net.cap[ids[i]] = arcs[i][2]
        net.fill(s, t)
    return [net.cap[e ^ 1] for e in ids]


def route(patterns: Sequence[int], cells: Sequence[tuple[int, Sequence[int], int]], targets: Sequence[int], copies: int = MAX_COPIES) -> list[int]:
    """Words that each cell gives. ``patterns``: words of the distinct texts;
    ``cells``: (pattern, sources, words of the rows)."""
    k, m = len(patterns), len(cells)
    s, t = k + m + len(targets), k + m + len(targets) + 1
    room = [0] * k
    for p, _, size in cells:
        room[p] += copies * size
    arcs: list[tuple[int, int, int, int]] = []
    for p, once in enumerate(patterns):
        left, level, width = room[p], 1, 1
        while left > 0 and once > 0:
            arcs.append((s, p, min(left, width * once), level))
            left -= width * once
            width, level = (1 if level == 1 else 2 * width), level + 1
    first = len(arcs)
    arcs += [(p, k + i, copies * size, 0) for i, (p, _, size) in enumerate(cells)]
    arcs += [(k + i, k + m + j, copies * size, 0) for i, (_, own, size) in enumerate(cells) for j in own]
    arcs += [(k + m + j, t, target, 0) for j, target in enumerate(targets)]
    return min_cost_flow(t + 1, arcs, s, t)[first : first + m]


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sources: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    copies: int = MAX_COPIES,
    seed: str = "mix-1",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per row: id, ``size``, ``source_size`` and ``target`` (summed over the
    row's sources), ``taken`` (size times copies) and ``copies``; also the
    columns named in ``keep``. ``sources`` is an array<string> column, by
    default the one source in ``source``; weights repeat over the sources in
    code-point order, null last."""
    spark = df.sparkSession
    member = F.array(F.col("source").cast("string")) if sources is None else sources
    # A null becomes a lone prefix, so that it is a key like any other and sorts last.
    own = F.array_sort(F.array_distinct(F.transform(member, lambda x: F.when(x.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), x)))))
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    order = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest))
    facts = df.select(F.col(id_col).alias("__id"), *(F.col(c).alias(f"__k_{c}") for c in keep), word_count(F.col(text_col)).alias("size"), own.alias("own"), F.unhex(digest).alias("h"), order.alias("o"))
    rows = materialize(facts.select("h", "own", "size", "o"), "mix-rows")  # narrow: no texts
    groups = rows.groupBy("h", "own").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    texts = groups.groupBy("h").agg(F.max("size").alias("size"), F.collect_list(F.struct("own", "n")).alias("owns"))  # a row's sources: few
    pattern = F.array_sort(F.array_distinct(F.flatten(F.transform("owns", lambda x: x["own"]))))
    texts = materialize(texts.select("h", "size", "owns", pattern.alias("p")), "mix-texts")
    known = texts.groupBy("p").agg(F.sum("size").alias("once"))
    found = {tuple(r["p"]): r["once"] for r in known.orderBy(F.desc("once"), "p").limit(MAX_PATTERNS).collect()}
    shared = texts.where(F.size("owns") > 1).select("h", "p")
    if len(found) == MAX_PATTERNS:  # the rest is split into its rows' own sources
        kept = F.broadcast(spark.createDataFrame([(list(p),) for p in found], "p array<string>"))
        texts = texts.join(kept.withColumn("in", F.lit(True)), "p", "left").select("h", "size", "owns", F.when(F.col("in"), F.col("p")).alias("p"))
        shared = shared.join(kept, "p", "left_semi").select("h", "p")
    split = texts.select("p", "size", F.explode("owns").alias("x")).select(F.coalesce("p", "x.own").alias("p"), "x.own", "size", "x.n")
    got = split.groupBy("p", "own").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n"), F.sum("size").alias("once")).collect()  # one row per cell
    got = sorted(got, key=lambda r: (list(r["p"]), list(r["own"])))
    names = sorted({s for r in got for s in r["own"]})  # "0..." sorts before "1": null is last
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in got:
        for s in r["own"]:
            sizes[at[s]] += r["size"]
    targets = quotas(sizes, [weights[i % len(weights)] for i in range(len(names))], share, copies) if names else []
    patterns = sorted({tuple(r["p"]) for r in got})
    number = {p: i for i, p in enumerate(patterns)}
    alone: dict[tuple, int] = defaultdict(int)
    for r in got:
        if r["p"] == r["own"]:
            alone[tuple(r["p"])] = r["once"]
    words = route([found.get(p, alone[p]) for p in patterns], [(number[tuple(r["p"])], [at[s] for s in r["own"]], r["size"]) for r in got], [round(x) for x in targets], copies)

    def plan_of(chosen: list[int]) -> DataFrame:
        plan = [
            (list(got[i]["p"]), list(got[i]["own"]), sum(sizes[at[s]] for s in got[i]["own"]), float(sum(targets[at[s]] for s in got[i]["own"])), *(divmod(words[i], got[i]["size"]) if got[i]["size"] else (0, 0)), max(1, -(-got[i]["n"] // CELL_ROWS)))
            for i in chosen
        ]
        # One row per cell: a few for each of MAX_PATTERNS patterns.
        return F.broadcast(spark.createDataFrame(plan, "p array<string>, own array<string>, source_size long, target double, full long, rest long, cells long").coalesce(1))

    labelled = materialize(meet(rows, shared, "h", "left").select(F.coalesce("p", "own").alias("p"), "own", "size", "o"), "mix-labelled")
    others = [i for i, r in enumerate(got) if r["p"] != r["own"]]
    singles = [i for i, r in enumerate(got) if r["p"] == r["own"]]
    cuts = spark.createDataFrame([], "p array<string>, own array<string>, below string")
    if others:
        plan = plan_of(others)
        cuts = materialize(_thresholds(labelled, plan), "mix-cuts")
        taken = {tuple(r["own"]): r["w"] for r in _pick(labelled.join(plan, ["p", "own"]), cuts).groupBy("own").agg(F.sum(F.col("size") * F.col("copies")).alias("w")).collect()}  # one row per source
        for i in singles:
            if len(r := got[i]["own"]) == 1:
                words[i] = max(0, min(copies * got[i]["size"], round(targets[at[r[0]]]) - taken.get(tuple(r), 0)))
    if singles:
        cuts = cuts.unionByName(materialize(_thresholds(labelled, plan_of(singles)), "mix-cuts"))
    plan = plan_of([*others, *singles])
    lookup = F.broadcast(shared) if shared.count() <= BROADCAST_TEXTS else None
    placed = (facts.join(lookup, "h", "left") if lookup is not None else meet(facts, shared, "h", "left")).withColumn("p", F.coalesce("p", "own"))
    picked = _pick(placed.join(plan, ["p", "own"]), cuts)
    return picked.select(
        F.col("__id").alias(id_col), *(F.col(f"__k_{c}").alias(c) for c in keep), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def _pick(planned: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``copies``: one more below the cell's place in the order; no place: for
    all or, with no rest, none. ``cuts`` has one row per cell."""
    cut = F.broadcast(cuts)
    extra = (F.col("rest") > 0) & (F.col("below").isNull() | (F.col("o") < F.col("below")))
    return planned.join(cut, ["p", "own"], "left").withColumn("copies", F.col("full") + F.when(extra, 1).otherwise(0))


def _thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``p, own, below``: per cell, the first place in the seeded order whose
    document is not needed. A document is needed if its middle lies below what is
    left to take. Parts of the order are summed first; only the part where the
    sum is reached is looked at row by row."""
    key = ["p", "own"]
    part = F.floor(F.conv(F.substring("o", 1, 8), 16, 10).cast("long") * F.col("cells") / F.lit(float(1 << 32)))
    placed = rows.join(plan, key).where("rest > 0").select(*key, "size", "o", "rest", part.alias("part"))
    by_part = placed.groupBy(*key, "part").agg(F.sum("size").alias("part_size"), F.max("rest").alias("rest"))
    upto = F.sum("part_size").over(Window.partitionBy(*key).orderBy("part"))
    last = by_part.select(*key, "part", (upto - F.col("part_size")).alias("before"), upto.alias("after"), "rest")
    open_ = last.where("after >= rest").groupBy(*key).agg(F.min_by(F.struct("part", "before"), "part").alias("c")).select(*key, "c.*")
    near = placed.join(F.broadcast(open_), [*key, "part"])  # one part per cell
    run = Window.partitionBy(*key).orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0))
    rest = near.select(*key, "o", "part", (2 * start + F.col("size") < 2 * F.col("rest")).alias("needed"))
    first = rest.where(~F.col("needed")).groupBy(*key).agg(F.min("o").alias("below"))
    # All of that part is needed: the order goes on in the next one, whose first document isn't.
    after = open_.join(first, key, "left").where("below is null").select(*key, F.col("part").alias("c0"))
    following = placed.join(F.broadcast(after), key).where(F.col("part") > F.col("c0")).groupBy(*key).agg(F.min("o").alias("below"))
    return first.unionByName(following)
