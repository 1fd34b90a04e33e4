"""The pipeline's stages against brute force, on awkward rows."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline as C
from vitalframe.llm import bpe_codec

from .data import clashing, documents, empty, rows
from .test_table_ops import base_spans, brute_components


@pytest.fixture
def at(spark, tmp_path):
    def put(df, name="documents"):
        path = f"{tmp_path}/{name}.parquet"
        df.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return put


def as_rows(df):
    return [tuple(r[c] for c in C.COLUMNS) for r in df.collect()]


def test_order_and_names():
    assert [n for n, _ in C.STAGES] == ["language_id", "ngram_join", "secret_scan", "source_mix", "bpe_codec"]


@pytest.mark.parametrize("make", [documents, clashing])
def test_stages(spark, at, make):
    docs = at(make(spark))
    kept = at(C.STAGES[0][1](spark, docs, ""), "a")
    letters = [r for r in rows() if any(ch.isalpha() for ch in r[1] or "")]
    assert set(as_rows(kept)) <= {tuple(r) for r in letters} and len(as_rows(kept)) >= 0.8 * len(letters)

    left = at(C.STAGES[1][1](spark, kept, ""), "b")
    before, after = as_rows(kept), as_rows(left)
    assert set(after) <= set(before)
    groups = brute_components([(i, r[1]) for i, r in enumerate(before)], 5, 80, 100)
    assert len(after) == len({c for _, _, c in groups})
    ids = {}
    for (i, _, c) in groups:
        ids.setdefault(c, []).append(before[i])
    for members in ids.values():
        have = [m for m in members if m in after]
        assert have and min(m[0] if m[0] is not None else 1 << 62 for m in members) == (have[0][0] if have[0][0] is not None else 1 << 62)

    clean = at(C.STAGES[2][1](spark, left, ""), "c")
    text = {(r[0], hashlib.md5(r[1].encode()).hexdigest()): r for r in after}
    assert len(as_rows(clean)) == len(after)
    for r in as_rows(clean):
        assert base_spans(r[1]) == "" and r[4] == len(r[1])
    texts = {r[1] for r in as_rows(clean)}
    suspect = lambda t: base_spans(t) or any(re.search("[0-9]", m) for m in re.findall(r"[A-Za-z0-9+/_-]{20,}", t))
    assert all(r[1] in texts for r in text.values() if not suspect(r[1]))

    mixed = at(C.STAGES[3][1](spark, clean, ""), "d")
    n = Counter(as_rows(mixed))
    source = Counter(as_rows(clean))
    assert set(n) <= set(source) and all(n[k] <= 2 * source[k] for k in n)

    enc = bpe_codec.load_encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    last = C.STAGES[4][1](spark, mixed, "").collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in last) == Counter((r[0], len(enc.encode_ordinary(r[1]))) for r in as_rows(mixed))


@pytest.mark.parametrize("labelled", [True, False])
def test_language_stage_drops_junk_alone(spark, at, labelled):
    """Junk of several kinds, learned from along with the rest where it is labelled."""
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    consonants, hexes = "bcdfghjklmnpqrstvwxz", "0123456789abcdef"
    junk = [word(consonants, n) for n in [20, 200] * 15] + [" ".join(word(consonants, rng.randint(3, 8)) for _ in range(30)) for _ in range(20)]
    junk += ["a" + word(hexes, 63) for _ in range(10)] + [" ".join(word("αβγδεζηθικλμν", 5) for _ in range(30)) for _ in range(10)]
    clean = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*C.COLUMNS)
    planted = spark.createDataFrame([(-1 - i, t, "en" if labelled else None, "a", len(t)) for i, t in enumerate(junk)], clean.schema)
    docs = at(clean.union(planted))
    kept = [r["doc_id"] for r in C.STAGES[0][1](spark, docs, "").collect()]
    lettered = [r["doc_id"] for r in clean.where("text rlike '[A-Za-z]'").collect()]
    assert sorted(i for i in kept if i >= 0) == sorted(lettered)
    assert not [junk[-1 - i] for i in kept if i < 0]


def test_run_equals_stages_and_repeats(spark, at, tmp_path):
    at(documents(spark))
    one = Counter(map(tuple, C.run(spark, str(tmp_path)).collect()))
    assert one and one == Counter(map(tuple, C.run(spark, str(tmp_path)).collect()))


def test_arrow_batches_are_bounded(spark, at):
    spark.conf.unset(C.BATCH_CONF)
    docs = at(spark.range(0, 3000, 1, 1).selectExpr("id doc_id", "repeat(md5(string(id)), 320) text", "'en' lang", "'a' source", "10240L n_chars"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes], "rows": [b.num_rows]}) for b in batches)
    C.STAGES[-1][1](spark, docs, "")
    got = docs.mapInArrow(sizes, "n long, rows long").collect()
    assert sum(r["rows"] for r in got) == 3000 and max(r["n"] for r in got) < 2 * C.BATCH_BYTES
    spark.conf.set(C.BATCH_CONF, "1m")  # what is lower stays
    C.STAGES[-1][1](spark, docs, "")
    assert spark.conf.get(C.BATCH_CONF) in ("1m", "1048576b")
    spark.conf.unset(C.BATCH_CONF)


def test_empty(spark, at, tmp_path):
    at(empty(spark))
    assert C.run(spark, str(tmp_path)).count() == 0
