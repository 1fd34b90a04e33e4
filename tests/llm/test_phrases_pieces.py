"""Phrase mining, SentencePiece codec, importance resampling: brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from vitalframe.llm import importance_resample, phrase_growth, piece_codec, queries

from .data import clashing, documents, empty, rows

MODEL = public_tokenizers.path(queries.PIECE_FILE)


def _saved(spark, tmp_path, docs, benchmark=("the cat sat on the mat", None, "one two three")):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# ---------------------------------------------------------------- phrases


def mine(texts, most, least, inside, top):
    """(group, rank, phrase, a, l, r, n, score) of (group, text) rows."""
    counts, total = defaultdict(Counter), Counter()
    for g, t in texts:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", _lower(t)):
            w = re.findall(r"[^ \t]+", piece)
            total[g] += len(w)
            for k in range(1, most + 1):
                counts[g].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for g, f in counts.items():
        cand = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        kept = []
        for p, a in cand.items():
            around = [n for q, n in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * n >= inside * a for n in around):
                continue
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(g, i + 1, p.decode(), -a, x, y, total[g], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def _plain(df):
    return sorted(tuple(r) for r in df.collect())


def _random_texts(n, seed):
    rnd = random.Random(seed)
    words = ["a", "B", "b", "a\x01", "\x01", "a a", "größe", "日本", "x y", "e", "end.", "c,", "d\n", "\t", "  ", "!"]
    return [("en", "de", "und", None)[rnd.randrange(4)] for _ in range(n)], [" ".join(rnd.choices(words, k=rnd.randrange(60))) for _ in range(n)]


def test_phrases_of_random_texts(spark):
    langs, texts = _random_texts(150, 1)
    docs = spark.createDataFrame(list(zip(langs, texts, strict=True)), "lang string, text string").repartition(5)
    for most, least, inside, top in ((3, 10, 50, 2000), (4, 3, 70, 40), (2, 1, 50, 10**6)):
        got = phrase_growth.collocations(docs, most, least, inside, top).select("g", "rank", "phrase", "a", "l", "r", "n", "score")
        assert _plain(got) == mine([(g or "und", t) for g, t in zip(langs, texts, strict=True)], most, least, inside, top)


def test_phrases_flushed_often_and_without_hot_parts(spark, monkeypatch):
    """Pointers merged a few words at a time; all parts found by merge join."""
    monkeypatch.setattr(phrase_growth, "FLUSH", 50)
    monkeypatch.setattr(phrase_growth, "HOT", 1)
    langs, texts = _random_texts(80, 2)
    pairs = list(zip(langs, texts, strict=True))
    counts = Counter()
    for g, t in pairs:
        held = phrase_growth.Pointers()
        held.add(t)
        for p, n in held.merged(3):
            counts.update(dict(zip([(g, x) for x in p], n.tolist(), strict=True)))
    assert sum(counts.values()) == sum(len(re.findall(r"[^ \t.,;:!?\n\x0b\x0c\r]+", t)) for _, t in pairs)
    docs, size = spark.createDataFrame(pairs, "lang string, text string").repartition(3), "spark.sql.execution.arrow.maxRecordsPerBatch"
    for rows_a_batch in ("2", "7", "10000"):  # projections that go on over many batches
        spark.conf.set(size, rows_a_batch)
        got = _plain(phrase_growth.collocations(docs, 4, 5))
        spark.conf.unset(size)
        assert got == mine([(g or "und", t) for g, t in pairs], 4, 5, 50, 2000)


def test_phrase_query_on_awkward_documents(spark, tmp_path):
    """Nulls, long texts, repeats, clashing columns; repeated rows count."""
    docs = clashing(spark)
    for _ in range(3):
        docs = docs.union(docs)
    got = queries.op11_phrase_growth(spark, _saved(spark, tmp_path, docs))
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert _plain(got) == mine([(r[2] or "und", r[1]) for r in rows() * 8], 3, 10, 50, 2000)


def test_phrases_of_an_empty_table(spark, tmp_path):
    assert queries.op11_phrase_growth(spark, _saved(spark, tmp_path, empty(spark))).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_000
    row = spark.createDataFrame([(big, big + 1, big + 2)], "a long, l long, r long")
    got = row.select(F.arrow_udf(phrase_growth._score, "long")("a", "l", "r")).first()[0]
    assert got == 1_000_000 * big * big // ((big + 1) * (big + 2))


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_chunks_can_stand_alone(model):
    assert piece_codec.chunks_alone(model.serialized_model_proto())


def test_ids_of_random_texts(model):
    rnd = random.Random(3)
    table = piece_codec.ChunkTable(MODEL)
    bits = [" ", "  ", "   ", "▁", "▁▁", "a", "the", "The", "ing", "é", "é", "\n", "\t", "日本", "🙂", "\x00", "<s>", "</s>", "<unk>", "<0x41>", "1234", "...", " ", "​"]
    texts = ["".join(rnd.choices(bits, k=rnd.randrange(30))) for _ in range(4000)] + [None, "", " ", "  ", "▁", "x ", " x"]
    for at in range(0, len(texts), 700):
        for t, ids in zip(texts[at : at + 700], table.encode_many(texts[at : at + 700]), strict=True):
            assert ids.tolist() == model.encode(t or "")


def test_table_starts_anew_and_segments_once(model, monkeypatch):
    table, seen = piece_codec.ChunkTable(MODEL), []
    segment = table._segment
    monkeypatch.setattr(table, "_segment", lambda new: seen.extend(new) or segment(new))
    texts = ["the cat and the dog", "the dog and the cat the"]
    assert [x.tolist() for x in table.encode_many(texts)] == [model.encode(t) for t in texts]
    assert len(seen) == len(set(seen)) == 4
    table.encode_many(texts)
    assert len(seen) == 4
    monkeypatch.setattr(piece_codec, "MOST_CHUNKS", 2)
    assert [x.tolist() for x in table.encode_many(texts)] == [model.encode(t) for t in texts] and len(seen) == 8


def test_whole_texts_where_chunks_depend_on_each_other(model, monkeypatch):
    monkeypatch.setattr(piece_codec, "chunks_alone", lambda proto: False)
    texts = ["the  cat ", "", None, "▁ x"]
    assert [x.tolist() for x in piece_codec.ChunkTable(MODEL).encode_many(texts)] == [model.encode(t or "") for t in texts]


def _digest(model, t):
    ids = model.encode(t or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_piece_query_on_awkward_documents(spark, model, tmp_path):
    got = queries.op12_piece_codec(spark, _saved(spark, tmp_path, clashing(spark)))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((r[0], *_digest(model, r[1])) for r in rows()), key=key)


def test_piece_query_on_the_given_documents(spark, model):
    at = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op12_piece_codec(spark, at).collect()} == {d: _digest(model, t) for d, t in texts.items()}


def test_encode_and_decode_columns(spark, model):
    done = piece_codec.decode(piece_codec.encode(clashing(spark), MODEL), MODEL).select("text", "ids", "decoded", "size").collect()
    for r in done:
        ids = model.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == model.decode(ids) and r["size"] == "clash"
    odd = spark.createDataFrame([([1, 99_999],), ([-1],), (None,), ([],), ([1, None],)], "ids array<int>")
    assert [r["decoded"] for r in piece_codec.decode(odd, MODEL).collect()] == [None, None, None, "", None]
    assert piece_codec.round_trip(empty(spark), MODEL).collect() == []


# ---------------------------------------------------------------- resampling


def test_crc_algebra():
    rnd = random.Random(4)
    for _ in range(200):
        a, b = rnd.randbytes(rnd.randrange(40)), rnd.randbytes(rnd.choice([0, 1, 2, 7, 8, 300, 70_000]))
        got = importance_resample.shift(np.array([zlib.crc32(a)], np.uint32), len(b))[0] ^ np.uint32(zlib.crc32(b))
        assert int(got) == zlib.crc32(a + b)


def _runs(text, most):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    return w, [" ".join(w[i : i + k]).encode() for k in range(1, most + 1) for i in range(len(w) - k + 1)]


def test_runs_of_random_texts(monkeypatch):
    rnd = random.Random(5)
    hasher = importance_resample.RunHasher(4)
    for most_words in (1 << 18, 3):
        monkeypatch.setattr(importance_resample, "MOST_WORDS", most_words)
        for _ in range(20):
            texts = ["".join(rnd.choices("aZ0 é-日_.\n", k=rnd.randrange(25))) for _ in range(30)] + [None, "x" * 70_000 + " y z"]
            n, found = hasher.hash(texts)
            got = [Counter() for _ in texts]
            for crc, doc in found:
                for c, d in zip(crc.tolist(), doc.tolist(), strict=True):
                    got[d][c] += 1
            for i, t in enumerate(texts):
                words, runs = _runs(t, 4)
                assert n[i] == len(words) and got[i] == Counter(map(zlib.crc32, runs))


def reckon(docs, target, num=25, den=100, least=20, seed=7, most=2, buckets=10_000):
    """Sorted (id, n_features, weight, score, rank) of (id, text) rows."""
    count = lambda texts: Counter(zlib.crc32(x) % buckets for t in texts for x in _runs(t, most)[1])
    s, t = count(x for _, x in docs), count(target)
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    out = []
    for i, text in docs:
        words, runs = _runs(text, most)
        weight = sum(gain(zlib.crc32(x) % buckets) for x in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    able = sorted((-r[3], r[0] is None, r[0] or 0, r[4], r[1], r[2], k) for k, r in enumerate(out) if r[4] >= least)
    rank = {x[-1]: i + 1 for i, x in enumerate(able[: num * len(able) // den])}
    return sorted(((*r[:4], rank.get(k)) for k, r in enumerate(out)), key=repr)


def test_resampling_of_random_documents(spark):
    rnd = random.Random(6)
    words = ["the", "Cat", "sat", "mat", "one", "two", "ñu", "x1", "--"]
    docs = [(rnd.randrange(60), " ".join(rnd.choices(words, k=rnd.randrange(40)))) for _ in range(150)]
    docs += docs[:40]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([("the cat sat",), (None,)], "text string")
    for num, least, most, buckets in ((25, 20, 2, 10_000), (100, 0, 3, 50), (0, 5, 1, 7)):
        got = importance_resample.resample(df, target, num, 100, least, 7, most, buckets).select("doc_id", "n_features", "weight", "score", "rank")
        # Rows equal in id and score may change places.
        assert sorted(map(tuple, got.collect()), key=repr) == reckon(docs, ["the cat sat", None], num, 100, least, 7, most, buckets)


def test_copies_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(importance_resample, "COPIES", 7)
    scored = spark.createDataFrame([(1, 30, 5)] * 50 + [(2, 30, 5)] * 3 + [(3, 30, 4), (4, 1, 9)], "doc_id long, n_words long, score long")
    got = [tuple(r) for r in importance_resample.draw(scored, F.col("n_words") >= 20, 1, 1).collect()]
    assert sorted(r[3] for r in got if r[0] == 1) == list(range(1, 51)) and sorted(r[3] for r in got if r[0] == 2) == [51, 52, 53]
    assert [r[3] for r in got if r[0] == 3] == [54] and [r[3] for r in got if r[0] == 4] == [None] and len(got) == 55


def test_resample_query_on_awkward_documents(spark, tmp_path):
    got = queries.op13_importance_resample(spark, _saved(spark, tmp_path, clashing(spark)))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == reckon([(r[0], r[1]) for r in rows()], ["the cat sat on the mat", None, "one two three"])


def test_resample_without_documents_or_target(spark, tmp_path):
    assert queries.op13_importance_resample(spark, _saved(spark, tmp_path, empty(spark))).collect() == []
    none = spark.createDataFrame([], "text string")
    got = importance_resample.resample(documents(spark), none).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == reckon([(r[0], r[1]) for r in rows()], [])
