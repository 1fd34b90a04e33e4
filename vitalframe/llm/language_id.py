"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fit: every training row (all of them, no sample) adds its n-gram counts to its
label's row of a (labels, buckets) matrix; tasks pass on the cells they have, Spark
sums them. Labels are limited to ``MAX_LABELS`` (an error beyond) and cells to
``MAX_CELLS`` (33 MB): that bounds a task, the driver and the broadcast.

Score: the log-probability matrix goes to the executors. A batch of texts is a
sparse count matrix, multiplied label by label in numpy. ``score`` is the
posterior of the predicted label.

Defined results: a null text, an empty one or one without any letter gives
``und`` with score 0. Rows with a null label or text are not learned from. Equal
posteriors: the label that sorts first wins. With nothing to learn from, every
text is ``und``. Very long texts are counted and scored in pieces, whole. Equal
rows get equal answers; extra columns pass through, but for those that have the
output's names, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

UNDETERMINED = "und"
ORDERS, BUCKETS, ALPHA, MAX_LABELS, MAX_CELLS = (1, 2, 3), 1 << 15, 0.5, 1024, 1 << 22
PIECE = 1 << 17
_LETTER, _DIGIT = regex.compile(r"\p{L}"), regex.compile(r"\p{Nd}")


def ngram_buckets(text: str, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Bucket numbers of all character n-grams of the lower-cased text, framed
    by one space, in pieces of bounded size that together hold each n-gram once."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    for n in orders:
        for at in range(0, max(0, len(code) - n + 1), PIECE):
            part = code[at : at + PIECE + n - 1]
            h = np.full(len(part) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h % np.uint64(buckets)).astype(np.int64)


class LanguageModel:
    """Labels in sorted order, log priors, and a (labels, buckets) matrix; of each label's
    training n-grams, the mean and the spread of their log-probabilities."""

    def __init__(self, labels: list[str], log_prior: np.ndarray, log_prob: np.ndarray, orders: tuple[int, ...], level: np.ndarray, spread: np.ndarray):
        self.labels, self.log_prior, self.log_prob, self.orders, self.level, self.spread = labels, log_prior, log_prob, orders, level, spread

    def predict_many(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Labels and posteriors of a batch. Its n-grams are the rows of one sparse
        matrix (bucket numbers and row starts), multiplied by each label's row of
        the model; a piece holds at most ``PIECE`` n-grams of any number of texts."""
        buckets = self.log_prob.shape[1]
        total = np.tile(self.log_prior, (len(texts), 1))
        held: list[np.ndarray] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            if held:
                cols = np.concatenate(held)
                starts = np.cumsum([0, *(len(x) for x in held[:-1])])
                for k in range(len(self.labels)):
                    np.add.at(total[:, k], owner, np.add.reduceat(self.log_prob[k].take(cols), starts))
            held.clear()
            owner.clear()

        judged = np.array([bool(t and self.labels and _LETTER.search(t)) for t in texts], bool)
        for i in np.flatnonzero(judged):
            for b in ngram_buckets(texts[i], self.orders, buckets):
                if len(b):
                    held.append(b)
                    owner.append(i)
                    size += len(b)
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        out: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if judged.any():
            best = total.argmax(axis=1)
            top = total[np.arange(len(texts)), best]
            sure = 1.0 / np.exp(total - top[:, None]).sum(axis=1)
            for i in np.flatnonzero(judged).tolist():
                out[i] = (self.labels[best[i]], float(sure[i]))
        return out

    def fitness(self, text: str, label: str) -> float:
        """How well a text reads as its label: its mean log-probability an n-gram, as
        standard deviations of one n-gram from the mean over the label's training
        texts. It does not fall with a text's length, as a likelihood does, nor rise
        with it, as a posterior. Words with digits (numbers, keys, addresses) are in no
        language and are left out, but for texts that have no other letters."""
        words = " ".join(w for w in text.split() if not _DIGIT.search(w))
        k = self.labels.index(label)
        row, total, size = self.log_prob[k], 0.0, 0
        for b in ngram_buckets(words if _LETTER.search(words) else text, self.orders, len(row)):
            total += float(row.take(b).sum())
            size += len(b)
        away = total / max(1, size) - self.level[k]
        return float(away / self.spread[k]) if self.spread[k] > 0 else min(0.0, float(np.sign(round(away, 9))))


def fit(train: DataFrame, text_col: str = "text", label_col: str = "lang", orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS, alpha: float = ALPHA) -> LanguageModel:
    """Learn from all rows of ``train`` whose label and text are not null. The
    matrix has at most ``MAX_CELLS`` cells: with many labels, fewer buckets."""
    rows = train.select(F.col(text_col).alias("t"), F.col(label_col).cast("string").alias("l")).where("t is not null and l is not null")
    # One row per label, and an error beyond the bound.
    prior_of = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).limit(MAX_LABELS + 1).collect()}
    if len(prior_of) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    labels = sorted(prior_of)
    while labels and len(labels) * buckets > MAX_CELLS:
        buckets >>= 1
    at = {label: i for i, label in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(len(at) * buckets, np.int64)
        for batch in batches:
            for piece in slices(batch):
                for t, label in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    first = at[label] * buckets
                    for b in ngram_buckets(t, orders, buckets):
                        cells[first : first + buckets] += np.bincount(b, minlength=buckets)
        used = np.flatnonzero(cells)
        for i in range(0, len(used), 1 << 16):
            part = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], names=["c", "n"])

    counts = np.full(len(labels) * buckets, float(alpha))
    if labels:
        got = rows.mapInArrow(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas()  # a row per cell: MAX_CELLS at most
        counts[got["c"].to_numpy(dtype=np.int64)] += got["n"].to_numpy(dtype=np.int64)
    counts = counts.reshape(len(labels), buckets)
    prior = np.array([prior_of[x] for x in labels], float)
    log_prob = np.log(counts / counts.sum(axis=1, keepdims=True))
    seen = counts - alpha
    share = seen / np.maximum(1.0, seen.sum(axis=1, keepdims=True))
    level = (share * log_prob).sum(axis=1)
    spread = np.sqrt((share * (log_prob - level[:, None]) ** 2).sum(axis=1))
    return LanguageModel(labels, np.log(prior / max(1.0, prior.sum())), log_prob, orders, level, spread)


def predict(df: DataFrame, model: LanguageModel, text_col: str = "text", label_out: str = "lang_pred", score_out: str = "score", fit_out: str | None = None) -> DataFrame:
    """Add the predicted label and its posterior to every row of ``df``, and with
    ``fit_out`` how well the text reads as that label (``fitness``; null for ``und``);
    columns that have these names already are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # labels x buckets: bounded
    added = [T.StructField(label_out, T.StringType()), T.StructField(score_out, T.DoubleType())]
    added += [T.StructField(fit_out, T.DoubleType())] if fit_out else []
    df = df.drop(*(f.name for f in added))
    schema = T.StructType([*df.schema.fields, *added])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text_col)
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column(at).to_pylist()
                found = shared.value.predict_many(texts)
                new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                if fit_out:
                    fits = [None if x == UNDETERMINED else shared.value.fitness(t, x) for t, (x, _) in zip(texts, found, strict=True)]
                    new.append(pa.array(fits, pa.float64()))
                yield pa.RecordBatch.from_arrays([*piece.columns, *new], names=names)

    return df.mapInArrow(run, schema)
