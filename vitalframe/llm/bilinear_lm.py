"""Language-model scores: a log-bilinear neural model with noise-contrastive
estimation in numpy, and add-one unigram scores.

Tokens: words of the text lower-cased in A-Z, then one end of text. Words of more
than ``TOP_BYTES`` bytes are named by their digest.

* Counts: all training documents; each task passes on partial counts, Spark sums.
* Classes: the ``WORDS`` most frequent tokens, the end, and for all other words one
  of ``CLUSTERS`` classes by the ending of the word.
* Model: the last two tokens' vectors, each through its own matrix, add up to a
  prediction, compared with an output vector and a bias per class. Training is
  noise-contrastive: unigram noise, shared by a minibatch, so that a step is a
  few matrix products. Training documents are dealt by a hash into blocks of about
  ``BLOCK_TOKENS`` tokens, in hash order, whatever the table's partitions are. Each
  block trains from one common start, ``STEPS`` steps at least, and parameters are
  averaged by tokens, for each round. Blocks grow in number with the input.
* Scores are normalised: a batched matrix product gives the log of the sum
  over all classes for every pair of context tokens, once. A word outside the
  vocabulary takes its class's probability times its add-one share in there.

Counts of the ``TOP`` most frequent tokens go to the executors, a bounded table; the
many rare ones are joined by token. What reaches the driver: ``TOP`` counts, a few
sums of parameters, a few numbers.

Defined results: a null text is an empty one, which is one end token. With no
training documents, base_score is 0 per token and the model is uniform. Equal texts
get equal scores; an empty table gives no rows; a very long text trains and scores
whole; extra columns are ignored. Scores agree over layouts of the table up to the
rounding of sums.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, meet, slices

WORDS, CLUSTERS, DIM, NOISE, ROUNDS, RATE, BATCH, SEED = 1022, 256, 24, 96, 2, 0.15, 8192, 7
BLOCK_TOKENS, STEPS, SUMS = 1 << 22, 160, 16
CACHED = 1024  # rows against the noise words at a time, so that they stay in the cache
TOP, TOP_BYTES, ENDING, FLUSH = 131_072, 64, 3, 400_000
END = 0  # class numbers; words start at 1, clusters follow
END_TOKEN = ""  # no word is empty


def tokens(text: str | None) -> list[bytes]:
    """Words in order, without the end. No word holds a space, a digest's name does."""
    words = (text or "").encode().lower().split()
    if max(map(len, words), default=0) > TOP_BYTES:
        words = [w if len(w) <= TOP_BYTES else b" " + hashlib.md5(w).hexdigest().encode() for w in words]
    return words


def cluster(word: bytes) -> int:
    return zlib.crc32(word[-ENDING:]) % CLUSTERS


def cluster_column(token: Column) -> Column:
    """``cluster`` as an expression."""
    return F.crc32(F.substring(F.encode(token, "utf-8"), -ENDING, ENDING)) % CLUSTERS


def count_tokens(train: DataFrame, text_col: str) -> DataFrame:
    """``token`` string, ``n`` long over all rows of ``train``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])
        for batch in batches:
            for piece in slices(batch):
                for t in piece.column(0).to_pylist():
                    seen.update(tokens(t))
                    seen[b""] += 1
                    if len(seen) > FLUSH:
                        yield out()
                        seen.clear()
        if seen:
            yield out()

    return train.select(text_col).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Counts of frequent tokens by rank; the first ``words`` are classes.
    ``clusters``: per cluster, the count and the number of types of all words."""

    def __init__(self, top: list[tuple[str, int]], total: int, types: int, clusters: dict[int, tuple[int, int]], words: int = WORDS):
        ranked = sorted(((t, n) for t, n in top if t != END_TOKEN), key=lambda x: (-x[1], x[0]))
        ends = dict(top).get(END_TOKEN, 0)
        self.rank = {t.encode(): i for i, (t, _) in enumerate(ranked)}
        self.count = np.array([n for _, n in ranked], np.int64)
        self.words = min(words, len(ranked))
        self.first = self.words + 1  # class of cluster 0
        self.size = self.first + CLUSTERS
        self.total, self.types, self.ends = total, types, ends
        tokens_in, types_in = np.zeros(CLUSTERS, np.int64), np.zeros(CLUSTERS, np.int64)
        for k, (n, v) in clusters.items():
            tokens_in[k], types_in[k] = n, v
        self.class_of = np.zeros(len(ranked), np.int16)  # by rank
        for i, (t, n) in enumerate(ranked):
            k = cluster(t.encode())
            if i < self.words:
                self.class_of[i] = i + 1
                tokens_in[k] -= n
                types_in[k] -= 1
            else:
                self.class_of[i] = self.first + k
        freq = np.concatenate([[max(1, ends)], np.maximum(1, self.count[: self.words]), np.maximum(1, tokens_in)]).astype(float)
        self.noise = freq / freq.sum()
        self.base_norm = math.log10(total + 1 * (types + 1))
        # Share of a word in its cluster: add-one, with one more for all unknown words.
        self.cluster_norm = np.log10(np.maximum(0, tokens_in) + np.maximum(0, types_in) + 1.0)
        self.log_count = np.log10(self.count + 1.0)

    def ranks(self, text: str | None) -> tuple[np.ndarray, list[bytes]]:
        """Rank of each word, -1 if not among the frequent ones; the words."""
        words = tokens(text)
        return np.fromiter(map(self.rank.get, words, repeat(-1)), np.int64, len(words)), words

    def classes(self, ranks: np.ndarray, words: list[bytes]) -> np.ndarray:
        """Class of each token, the end included."""
        out = np.zeros(len(ranks) + 1, np.int16)
        known = ranks >= 0
        out[:-1][known] = self.class_of[ranks[known]]
        rare = np.flatnonzero(~known)
        if len(rare):
            out[rare] = [self.first + cluster(words[i]) for i in rare.tolist()]
        return out  # END is class 0


class Bilinear:
    """Parameters of the model; ``flat`` holds them all."""

    def __init__(self, size: int, dim: int = DIM):
        self.size, self.dim = size, dim
        self.shapes = {"r": (size, dim), "c1": (dim, dim), "c2": (dim, dim), "q": (size, dim), "b": (size,)}
        self.flat = np.zeros(sum(math.prod(s) for s in self.shapes.values()), np.float32)
        self._first: np.ndarray | None = None  # contexts against classes, for scoring
        self._views()

    def _views(self) -> None:
        at, self.p = 0, {}
        for k, s in self.shapes.items():
            self.p[k] = self.flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)

    def start(self, noise: np.ndarray, seed: int = SEED) -> Bilinear:
        rng = np.random.default_rng(seed)
        for k in ("r", "q"):
            self.p[k][:] = rng.normal(0, 0.3 if k == "r" else 0.05, self.shapes[k])
        self.p["c1"][:], self.p["c2"][:] = np.eye(self.dim), 0.5 * np.eye(self.dim)
        self.p["b"][:] = np.log(noise)
        return self

    def load(self, flat: np.ndarray) -> Bilinear:
        self.flat[:] = flat
        return self

    def __getstate__(self):
        return self.size, self.dim, self.flat

    def __setstate__(self, state):
        self.__init__(state[0], state[1])
        self.flat[:] = state[2]

    def train(self, batch: np.ndarray, squares: np.ndarray, noise: np.ndarray, rng: np.random.Generator, rate: float = RATE, k: int = NOISE) -> None:
        """One noise-contrastive step (Adagrad) on rows (c2, c1, target)."""
        p, d, n = self.p, self.dim, len(batch)
        c2, c1, w = np.ascontiguousarray(batch.T)
        drawn = np.searchsorted(np.cumsum(noise), rng.random(k)).clip(max=self.size - 1)
        log_noise = (np.log(noise) + math.log(k)).astype(np.float32)
        # Products with a matrix are made once a class, not once a row. A last column
        # of ones (of biases) lets the products below add the biases and their slopes.
        h, out = np.ones((n, d + 1), np.float32), np.column_stack([p["q"], p["b"] - log_noise])
        np.add((p["r"] @ p["c1"]).take(c1, 0), (p["r"] @ p["c2"]).take(c2, 0), out=h[:, :d])
        qw, qn = out.take(w, 0), out[drawn]
        up = -_sigmoid(-np.einsum("ij,ij->i", h, qw))  # slope of the loss
        qw *= up[:, None]
        dh, dn = qw, np.zeros((k, d + 1), np.float32)
        for at in range(0, n, CACHED):
            part = h[at : at + CACHED]
            down = _sigmoid(part @ qn.T)
            dh[at : at + CACHED] += down @ qn
            dn += down.T @ part
        h *= up[:, None]
        dq, by_c1, by_c2 = _sum_rows(h, w, self.size), _sum_rows(dh, c1, self.size)[:, :d], _sum_rows(dh, c2, self.size)[:, :d]
        np.add.at(dq, drawn, dn)
        grad = Bilinear(self.size, d)
        g = grad.p
        g["c1"][:], g["c2"][:] = p["r"].T @ by_c1, p["r"].T @ by_c2
        g["r"][:] = by_c1 @ p["c1"].T + by_c2 @ p["c2"].T
        g["q"][:], g["b"][:] = dq[:, :d], dq[:, d]
        grad.flat /= np.float32(n)
        squares += grad.flat**2
        self.flat -= np.float32(rate) * grad.flat / (np.sqrt(squares) + 1e-5)

    def log_sums(self, chunk: int = 16) -> np.ndarray:
        """log of the sum over classes for every (c2, c1): (size, size) float32."""
        first, second, q, b = self.p["r"] @ self.p["c1"], self.p["r"] @ self.p["c2"], self.p["q"].T, self.p["b"]
        # exp(x + y) = exp(x) exp(y): contexts add up, so products of exponentials do.
        out = np.empty((self.size, self.size), np.float32)
        left = first @ q + b
        top = left.max(axis=1, keepdims=True)
        e1 = np.exp(left - top)
        right = second @ q
        peak = right.max(axis=1, keepdims=True)
        e2 = np.exp(right - peak)
        for at in range(0, self.size, chunk * 64):
            out[at : at + chunk * 64] = np.log(np.maximum(e2[at : at + chunk * 64] @ e1.T, 1e-37)) + peak[at : at + chunk * 64] + top.T
        return out

    def log_probs(self, classes: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Natural log probability of each class after the two before it."""
        if self._first is None:
            self._first = (self.p["r"] @ self.p["c1"]) @ self.p["q"].T + self.p["b"]
            self._second = (self.p["r"] @ self.p["c2"]) @ self.p["q"].T
        c = np.concatenate([[END, END], classes]).astype(np.int64)
        c2, c1, w = c[:-2] * self.size, c[1:-1], c[2:]
        out = self._first.take(c1 * self.size + w)
        out += self._second.take(c2 + w)
        out -= sums.take(c2 + c1)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.negative(x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _sum_rows(rows: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows by the number in ``at``: (size, columns)."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    to = at[order]
    first = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1])
    out[to[first]] = np.add.reduceat(rows.take(order, 0), first, axis=0)
    return out


def _train_block(model: Bilinear, noise: np.ndarray, docs: list[np.ndarray], seed: list[int]) -> tuple[Bilinear, int]:
    """Train on a block's documents in the order given; returns the tokens seen."""
    m = Bilinear(model.size, model.dim).load(model.flat)
    rng, squares = np.random.default_rng(seed), np.full(len(m.flat), 1e-4, np.float32)
    lead = np.array([END, END], np.int16)
    rows = np.concatenate([np.stack([c[:-2], c[1:-1], c[2:]], 1) for c in (np.concatenate([lead, d]) for d in docs)])
    steps = max(STEPS, -(-len(rows) // BATCH))
    per_pass = -(-len(rows) // BATCH)
    for step in range(steps):
        at = step % per_pass * BATCH
        m.train(rows[at : at + BATCH], squares, noise, rng)  # 16 bits: sorted by radix
    return m, len(rows)


def _learner(begin: Broadcast, noise: np.ndarray, turn: int):
    """The function of one block: its model's parameters times its tokens. Without
    hints, as Spark would judge by them."""

    def learn(block):
        order = np.argsort(block.column("place").to_numpy(), kind="stable")
        texts = block.column("x").to_pylist()
        number = block.column("block")[0].as_py()
        m, seen = _train_block(begin.value, noise, [np.frombuffer(texts[i], np.int16) for i in order.tolist()], [SEED, turn, number])
        return pa.table({"slot": pa.array([number % SUMS]), "w": pa.array([float(seen)]), "x": pa.array([(m.flat.astype(np.float64) * seen).tobytes()], pa.binary())})

    return learn


def fit(train: DataFrame, voc: Vocabulary, rounds: int = ROUNDS) -> Bilinear:
    """Average of the blocks' models, weighted by tokens, after each round.
    ``train``: id, text."""
    spark = train.sparkSession
    model = Bilinear(voc.size).start(voc.noise)
    if not voc.total:
        return model
    shared_voc = spark.sparkContext.broadcast(voc)
    place = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    blocks = max(1, round(voc.total / BLOCK_TOKENS))
    dealt = train.select(F.pmod(place, F.lit(blocks)).alias("block"), place.alias("place"), "text")

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared_voc.value
        for batch in batches:
            for piece in slices(batch):
                x = [v.classes(*v.ranks(t)).tobytes() for t in piece.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(x, pa.binary())], names=["block", "place", "x"])

    # Two bytes a token: what both rounds read instead of the texts.
    classed = materialize(dealt.mapInArrow(classify, "block long, place long, x binary"), "lm-classes")
    noise = voc.noise
    for turn in range(rounds):
        begin = spark.sparkContext.broadcast(model)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, x = 0.0, None
            for batch in batches:
                for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    w, x = w + a, np.frombuffer(b) if x is None else x + np.frombuffer(b)
            if x is not None:
                yield pa.RecordBatch.from_arrays([pa.array([w]), pa.array([x.tobytes()], pa.binary())], names=["w", "x"])

        trained = classed.groupBy("block").applyInArrow(_learner(begin, noise, turn), "slot long, w double, x binary")
        got = trained.repartition(SUMS, "slot").mapInArrow(add, "w double, x binary").collect()  # SUMS rows
        begin.destroy()
        flat = sum(np.frombuffer(r["x"]) for r in got) / sum(r["w"] for r in got)
        model = Bilinear(voc.size).load(flat.astype(np.float32))
    shared_voc.destroy()
    return model


def frequent(counts: DataFrame, most: int = TOP) -> list[tuple[str, int]]:
    """The tokens above a count that at most ``most`` tokens exceed."""
    short = counts
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = sorted(short.groupBy(level.alias("l")).agg(F.count("*").alias("k"), F.min("n").alias("n")).collect(), key=lambda r: -r["l"])  # about a thousand rows at most
    least, k = None, 0
    for r in sizes:
        k += r["k"]
        if k > most:
            break
        least = r["n"]
    top = [] if least is None else [(r["token"], r["n"]) for r in short.where(F.col("n") >= least).collect()]
    if not any(t == END_TOKEN for t, _ in top):
        top += [(r["token"], r["n"]) for r in counts.where(F.col("token") == END_TOKEN).collect()]
    return top


def score(df: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``training`` boolean, n_tokens, n_known, train_tokens,
    base_score, score (log10), as the module describes."""
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text_col).alias("text"))
    train = docs.where("training").select("id", "text")
    counts = materialize(count_tokens(train, "text"), "lm-counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    by_cluster = counts.where(F.col("token") != END_TOKEN).groupBy(cluster_column(F.col("token")).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # CLUSTERS rows
    voc = Vocabulary(frequent(counts), whole["n"], whole["v"], {r["k"]: (r["n"], r["v"]) for r in by_cluster})
    model = fit(train, voc)
    sums = model.log_sums()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((voc, model, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m, z = shared.value
        part, row = TaskContext.get().partitionId(), 0
        names = ["rid", "id", "training", "n_tokens", "n_known", "base", "score", "token", "tf"]
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                rid, head, rare_key, rare, rare_n = [], [], [], [], []
                for t in piece.column(2).to_pylist():
                    key = part << 33 | row
                    row += 1
                    ranks, words = v.ranks(t)
                    found = ranks[ranks >= 0]
                    base = float(v.log_count[found].sum()) - v.base_norm * len(found)
                    base += math.log10(v.ends + 1) - v.base_norm
                    classes = v.classes(ranks, words)
                    s = float(m.log_probs(classes, z).sum(dtype=np.float64)) / math.log(10)
                    outside = found[found >= v.words]
                    s += float(v.log_count[outside].sum()) - float(v.cluster_norm[v.class_of[outside] - v.first].sum())
                    rid.append(key)
                    head.append((len(words) + 1, len(found) + (v.ends > 0), base, s))
                    if len(found) < len(words):
                        few = Counter(words[i] for i in np.flatnonzero(ranks < 0).tolist())
                        rare_key += [key] * len(few)
                        rare += few.keys()
                        rare_n += few.values()
                k = len(rid)
                cols = list(zip(*head, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), piece.column(0), piece.column(1), *(pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(cols)), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=names)
                if rare:
                    k = len(rare)
                    yield pa.RecordBatch.from_arrays([pa.array(rare_key, pa.int64()), pa.nulls(k, piece.column(0).type), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(rare, pa.binary()).cast(pa.string()), pa.array(rare_n, pa.int64())], names=names)

    id_type = docs.schema["id"].dataType.simpleString()
    # Written once, so that row numbers stay what they are.
    rows = materialize(docs.mapInArrow(run, f"rid long, id {id_type}, training boolean, n_tokens long, n_known long, base double, score double, token string, tf long"), "lm-rows")
    rare = meet(rows.where("token is not null").select("rid", "token", "tf"), counts, "token", "left")
    norm = F.element_at(F.array(*(F.lit(float(x)) for x in voc.cluster_norm)), (cluster_column(F.col("token")) + 1).cast("int"))
    log_c = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0))
    rare = rare.groupBy("rid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("k"),
        F.sum(F.col("tf") * (log_c - voc.base_norm)).alias("rare_base"),
        F.sum(F.col("tf") * (log_c - norm)).alias("rare_score"),
    )
    out = meet(rows.where("token is null"), rare, "rid", "left")
    return out.select(
        F.col("id").alias(id_col),
        "training",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(int(whole["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
