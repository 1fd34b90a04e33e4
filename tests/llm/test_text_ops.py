"""BPE codec, token counts, language ID, language model: against brute force."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import tokenizers

from vitalframe.llm import bilinear_lm, bpe_codec, language_id, queries, token_counts
from vitalframe.llm.common import crc_mod

from .data import LONG, TEXTS, clashing, documents, empty, rows

RANKS, FILE = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding() -> tiktoken.Encoding:
    return bpe_codec.load_encoding(RANKS, P.PATTERN)


def test_safe_pieces_keep_ids(encoding):
    for t in TEXTS:
        for size in (1, 7, 50):
            pieces = list(bpe_codec.safe_pieces(t or "", size))
            assert "".join(pieces) == (t or "")
            if len(t or "") < 5000 or size == 50:
                assert sum((encoding.encode_ordinary(p) for p in pieces), []) == encoding.encode_ordinary(t or "")


def test_codec_round_trip(spark, encoding):
    def want(i, t):
        ids = encoding.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    for df in (documents(spark), clashing(spark)):
        assert Counter(map(tuple, bpe_codec.round_trip(df, RANKS, P.PATTERN).collect())) == Counter(want(r[0], r[1]) for r in rows())
    assert bpe_codec.round_trip(empty(spark), RANKS, P.PATTERN).count() == 0
    two = bpe_codec.decode(bpe_codec.encode(documents(spark), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in two.collect())
    bad = spark.createDataFrame([([1, 2],), ([60_000],), (None,)], "ids array<int>")
    assert [r["decoded"] is None for r in bpe_codec.decode(bad, RANKS, P.PATTERN).collect()] == [False, True, False]


def test_prefix_counts_are_exact():
    c, lib = token_counts.load_counter(FILE), tokenizers.Tokenizer.from_file(FILE)
    for t in TEXTS:
        if t is not None and len(t) < 500:
            got = token_counts.prefix_counts(c.table(t)).tolist()
            assert got == [len(lib.encode(t[:i], add_special_tokens=False).ids) for i in range(len(t) + 1)]
    t = LONG[44_000:46_000]
    assert token_counts.total(c.table(t)) == len(lib.encode(t, add_special_tokens=False).ids)
    table = c.table("the cat sat on the mat")
    counts = token_counts.prefix_counts(table)
    for budget in range(7):
        k = token_counts.longest_within(table, budget)
        assert counts[k] <= budget and (k == len(counts) - 1 or (counts[k + 1 :] > budget).all())


def test_counts_with_controls_and_space():
    """Control characters beside white space, against the library, prefix by prefix."""
    import random

    c, lib = token_counts.load_counter(FILE), tokenizers.Tokenizer.from_file(FILE)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rnd = random.Random(3)
    pieces = ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2003", "\u180e", "\u200b", " ", "  ", "\n", "\t", "\r\n", "a", "word", "9", "'s", "'", "é", "日本", "<|endoftext|>", "."]
    assert token_counts.total(c.table("a\n\n\x1c\n\nb")) == n("a\n\n\x1c\n\nb")
    for k in range(1500):
        t = "".join(rnd.choices(pieces, k=rnd.randint(1, 9)))
        assert token_counts.total(c.table(t)) == n(t), repr(t)
        if k % 10 == 0:
            assert token_counts.prefix_counts(c.table(t)).tolist() == [n(t[:i]) for i in range(len(t) + 1)], repr(t)


def test_border_check_against_merging():
    """Two tokens stay apart just where merging their joined bytes gives them back."""
    import random

    c, rnd = token_counts.load_counter(FILE), random.Random(11)
    assert all(c._merged(c.bytes_of[t]) == [c.bytes_of[t]] for t in rnd.sample(range(1, len(c.bytes_of)), 2000) if c._last_merge(t)[0] > -2)
    pairs = [(rnd.randrange(1, len(c.bytes_of)), rnd.randrange(1, len(c.bytes_of))) for _ in range(5000)]
    for whole in rnd.sample(c.bytes_of[1:], 5000):  # borders inside tokens, most of which merge
        pairs += [(c.ids.get(whole[:k], 0), c.ids.get(whole[k:], 0)) for k in range(1, len(whole))]
    pairs += [(t, t) for t in rnd.sample(range(1, len(c.bytes_of)), 500)]
    pairs = [(a, b) for a, b in pairs if a and b and min(c._last_merge(a)[0], c._last_merge(b)[0]) > -2]
    apart = [c._stay_apart(a, b) for a, b in pairs]
    assert apart == [c._merged(c.bytes_of[a] + c.bytes_of[b]) == [c.bytes_of[a], c.bytes_of[b]] for a, b in pairs]
    assert 500 < sum(apart) < len(apart) - 500


def test_token_query(spark):
    lib = tokenizers.Tokenizer.from_file(FILE)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op8_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(text)
    for r in got:
        n = len(lib.encode(text[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 512)
        assert (r["fits_512"] < len(text[r["doc_id"]])) == r["over_limit"]


def test_token_count_rows(spark):
    lib = tokenizers.Tokenizer.from_file(FILE)
    want = Counter((r[0], len((r[1] or "").encode()), len(lib.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows())
    for df in (documents(spark), clashing(spark)):
        got = token_counts.count_tokens(df, FILE, budgets=[5])
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.count_tokens(empty(spark), FILE).count() == 0
    kept = token_counts.with_prefix_tables(documents(spark), FILE).select("text", token_counts.token_count(queries.F.col("prefix_table")).alias("n"), token_counts.truncate_to_budget(queries.F.col("prefix_table"), 3).alias("k"))
    for r in kept.collect():
        assert r["k"] <= len(r["text"] or "") and (r["n"] > 3 or r["k"] == len(r["text"] or ""))


def test_language_rows(spark):
    for df in (documents(spark), clashing(spark)):
        model = language_id.fit(df.where(crc_mod("doc_id", 3) != 1))
        got = language_id.predict(df, model).collect()
        assert len(got) == len(rows()) and {r["lang_pred"] for r in got} <= {"en", "es", "de", "und"}
        for r in got:
            assert 0 <= r["score"] <= 1
            letters = any(ch.isalpha() for ch in r["text"] or "")
            assert (r["lang_pred"] == "und") == (not letters)
    assert language_id.predict(empty(spark), model).count() == 0
    none = language_id.fit(empty(spark))
    assert {r["lang_pred"] for r in language_id.predict(documents(spark), none).collect()} == {"und"}


def test_language_model_against_brute_force(spark):
    """Posteriors from n-gram counts made one by one."""
    df = documents(spark)
    model = language_id.fit(df)
    counts, docs = {}, Counter()
    for _, t, lang, *_ in rows():
        if t is not None and lang is not None:
            docs[lang] += 1
            s = f" {t.lower()} "
            for n in language_id.ORDERS:
                for k in range(len(s) - n + 1):
                    b = _bucket(s[k : k + n])
                    counts.setdefault(lang, Counter())[b] += 1
    assert model.labels == sorted(docs)
    for j, lang in enumerate(model.labels):
        total = sum(counts[lang].values()) + language_id.ALPHA * language_id.BUCKETS
        for b in list(counts[lang])[:200]:
            assert math.isclose(model.log_prob[j, b], math.log((counts[lang][b] + language_id.ALPHA) / total), rel_tol=1e-9)


def test_posteriors_against_brute_force(spark, monkeypatch):
    """Scores of a batch, cut into small pieces, against sums made one by one."""
    model = language_id.fit(documents(spark))
    texts = [t for t in [*TEXTS, "日本", "ein Wort", "12", None] if t is None or len(t) < 3000]
    for piece in (1 << 17, 7):
        monkeypatch.setattr(language_id, "PIECE", piece)
        for t, (label, score) in zip(texts, model.predict_many(texts), strict=True):
            if not any(ch.isalpha() for ch in t or ""):
                assert (label, score) == ("und", 0.0)
                continue
            s = f" {t.lower()} "
            logs = model.log_prior + sum(model.log_prob[:, _bucket(s[k : k + n])] for n in language_id.ORDERS for k in range(len(s) - n + 1))
            want = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
            assert label == model.labels[int(logs.argmax())] and math.isclose(score, want.max(), rel_tol=1e-6)


def test_fitness_against_brute_force(spark):
    """Levels, spreads and fitness from n-grams taken one by one."""
    model = language_id.fit(documents(spark))
    logs = {x: [] for x in model.labels}
    grams = lambda t: [_bucket(s[k : k + n]) for s in [f" {t.lower()} "] for n in language_id.ORDERS for k in range(len(s) - n + 1)]
    for _, t, lang, *_ in rows():
        if t is not None and lang is not None:
            logs[lang] += model.log_prob[model.labels.index(lang)][grams(t)].tolist()
    for t in ("ein Wort", "xq zv", "el perro 12a de\t7 la casa", "a1"):
        bare = " ".join(w for w in t.split() if not any(c.isdigit() for c in w)) or t
        for j, lang in enumerate(model.labels):
            want = (model.log_prob[j][grams(bare)].mean() - np.mean(logs[lang])) / np.std(logs[lang])
            assert math.isclose(model.fitness(t, lang), want, rel_tol=1e-6, abs_tol=1e-6)
    got = language_id.predict(clashing(spark), model, fit_out="extra").collect()
    assert len(got) == len(rows()) and all((r["extra"] is None) == (r["lang_pred"] == "und") for r in got)


def test_many_labels_take_fewer_buckets(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_CELLS", 1 << 16)
    model = language_id.fit(documents(spark))
    assert model.log_prob.size <= 1 << 16 and {x for x, _ in model.predict_many(["el perro de la casa"])} <= {"en", "es", "de"}
    monkeypatch.setattr(language_id, "MAX_LABELS", 2)
    with pytest.raises(ValueError):
        language_id.fit(documents(spark))


def _bucket(gram: str) -> int:
    m = (1 << 64) - 1
    h = len(gram)
    for ch in gram:
        h = (h ^ ord(ch)) * 0x9E3779B97F4A7C15 & m
        h ^= h >> 29
    return h % language_id.BUCKETS


def test_held_out_accuracy(spark):
    got = queries.op10_language_id(spark, "/root/testdata/sf0.01").toPandas()
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.95


def test_language_model_scores(spark):
    learn = [r for r in rows() if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for r in learn for w in words(r[1]))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows():
        w = words(r[1])
        want[r[0], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    for df in (documents(spark), clashing(spark)):
        got = bilinear_lm.score(df, crc_mod("doc_id", 7) != 2).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert bilinear_lm.score(empty(spark), crc_mod("doc_id", 7) != 2).count() == 0
    nothing = bilinear_lm.score(documents(spark), queries.F.lit(False)).collect()
    assert {r["train_tokens"] for r in nothing} == {0} and all(r["base_score"] == 0 for r in nothing)


def test_rare_tokens_join_gives_the_same(spark, monkeypatch):
    """Few tokens among the broadcast ones: the join must supply the others."""
    whole = {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in bilinear_lm.score(documents(spark), crc_mod("doc_id", 7) != 2).collect()}
    real = bilinear_lm.frequent
    monkeypatch.setattr(bilinear_lm, "frequent", lambda counts, most=3: real(counts, most))
    assert whole == {(r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in bilinear_lm.score(documents(spark), crc_mod("doc_id", 7) != 2).collect()}


def test_scores_do_not_depend_on_the_layout(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [{r["doc_id"]: r for r in bilinear_lm.score(df.repartition(n), crc_mod("doc_id", 7) != 2).collect()} for n in (1, 16)]
    for i, r in got[0].items():
        assert math.isclose(r["score"], got[1][i]["score"], rel_tol=1e-5)
    held = [r for r in got[0].values() if not r["training"]]
    n = sum(r["n_tokens"] for r in held)
    assert sum(r["score"] for r in held) / n > sum(r["base_score"] for r in held) / n + 0.1
    assert sum(r["score"] > r["base_score"] for r in held) > 0.9 * len(held)


def test_scores_against_brute_force(spark, monkeypatch):
    """Every token's probability, normalised over all words there are, one by one."""
    monkeypatch.setattr(bilinear_lm, "WORDS", 12)
    kept = {}
    real = bilinear_lm.fit
    monkeypatch.setattr(bilinear_lm, "fit", lambda train, voc: kept.setdefault("m", (real(train, voc), voc))[0])
    monkeypatch.setattr(bilinear_lm.Vocabulary.__init__, "__defaults__", (12,))
    got = {(r["doc_id"], r["n_tokens"]): r["score"] for r in bilinear_lm.score(documents(spark), crc_mod("doc_id", 7) != 2).collect()}
    m, voc = kept["m"]
    learn = [r for r in rows() if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    c = Counter(w for r in learn for w in bilinear_lm.tokens(r[1]))
    classed = {w for w, i in voc.rank.items() if i < voc.words}
    assert voc.words == 12
    for r in rows():
        if r[1] is not None and len(r[1]) > 2000:
            continue
        seq = [*bilinear_lm.tokens(r[1]), b""]
        cls = lambda w: 0 if w == b"" else voc.rank[w] + 1 if w in classed else voc.first + bilinear_lm.cluster(w)
        c1 = c2 = 0
        total = 0.0
        for w in seq:
            logits = m.p["q"].astype(float) @ (m.p["r"][c1] @ m.p["c1"] + m.p["r"][c2] @ m.p["c2"]) + m.p["b"]
            total += (logits[cls(w)] - np.log(np.exp(logits).sum())) / math.log(10)
            if w != b"" and w not in classed:
                k = bilinear_lm.cluster(w)
                own = [x for x in c if x not in classed and bilinear_lm.cluster(x) == k]
                total += math.log10((c[w] + 1) / (sum(c[x] for x in own) + len(own) + 1))
            c1, c2 = cls(w), c1
        assert math.isclose(total, got[r[0], len(seq)], rel_tol=1e-3, abs_tol=1e-3)


def test_log_sums_normalise():
    voc = bilinear_lm.Vocabulary([("a", 9), ("b", 5), ("c", 2), ("", 4)], 30, 9, {})
    m = bilinear_lm.Bilinear(voc.size).start(voc.noise)
    z = m.log_sums()
    for c2 in range(voc.size):
        for c1 in range(voc.size):
            h = m.p["r"][c1] @ m.p["c1"] + m.p["r"][c2] @ m.p["c2"]
            assert math.isclose(float(np.log(np.exp(m.p["q"] @ h + m.p["b"]).sum())), float(z[c2, c1]), rel_tol=1e-4, abs_tol=1e-4)


def test_training_is_not_cut():
    """Steps of 8,192 tokens against 96 noise words, two rounds over all training tokens."""
    assert (bilinear_lm.NOISE, bilinear_lm.BATCH, bilinear_lm.ROUNDS) == (96, 8192, 2)
    voc = bilinear_lm.Vocabulary([*((f"w{i}", 100) for i in range(300)), ("", 1)], 30_001, 301, {})
    m = bilinear_lm.Bilinear(voc.size).start(voc.noise)
    drawn, at = [], np.zeros((bilinear_lm.BATCH, 3), np.int64)

    class Rng:
        def random(self, k):
            drawn.append(k)
            return np.random.default_rng(1).random(k)

    m.train(at, np.full(len(m.flat), 1e-4, np.float32), voc.noise, Rng())
    assert drawn == [96]


def test_a_training_step_is_the_plain_formula_in_cached_pieces():
    """The gradient in doubles, row by row; and no table of all rows by all noise words."""
    rng, noise = np.random.default_rng(3), 1 / np.arange(1, 1280)
    noise /= noise.sum()
    batch = rng.choice(1279, (8192, 3), p=noise).astype(np.int16)
    m = bilinear_lm.Bilinear(1279).start(noise)
    old, p = m.flat.astype(float), {k: v.astype(float) for k, v in m.p.items()}
    squares = np.full(len(m.flat), 1e-4, np.float32)
    tracemalloc.start()
    m.train(batch, squares, noise, np.random.default_rng(5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    c2, c1, w = batch.T.astype(int)
    drawn = np.searchsorted(np.cumsum(noise), np.random.default_rng(5).random(96)).clip(max=1278)
    h, bias = p["r"][c1] @ p["c1"] + p["r"][c2] @ p["c2"], p["b"] - np.log(96 * noise)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    up, down = -sigmoid(-((h * p["q"][w]).sum(1) + bias[w])), sigmoid(h @ p["q"][drawn].T + bias[drawn])
    dh = up[:, None] * p["q"][w] + down @ p["q"][drawn]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    np.add.at(g["r"], c1, dh @ p["c1"].T)
    np.add.at(g["r"], c2, dh @ p["c2"].T)
    g["c1"], g["c2"] = p["r"][c1].T @ dh, p["r"][c2].T @ dh
    np.add.at(g["q"], w, up[:, None] * h)
    np.add.at(g["q"], drawn, down.T @ h)
    np.add.at(g["b"], w, up)
    np.add.at(g["b"], drawn, down.sum(0))
    flat = np.concatenate([g[k].reshape(-1) for k in p]) / len(batch)
    np.testing.assert_allclose(m.flat, old - bilinear_lm.RATE * flat / (np.sqrt(1e-4 + flat**2) + 1e-5), atol=1e-5)
    assert most < 2 * 8192 * 96 * 4


def test_training_beats_unigrams():
    """On a text with strong order, the trained model predicts better."""
    words = ["a", "b", "c", "d", "e", "f"]
    text = " ".join(words * 400)
    voc = bilinear_lm.Vocabulary([*((w, 400) for w in words), ("", 1)], 2401, 7, {})
    m = bilinear_lm.Bilinear(voc.size).start(voc.noise)
    c = np.concatenate([[0, 0], voc.classes(*voc.ranks(text))])
    data = np.stack([c[:-2], c[1:-1], c[2:]], 1)
    before = m.log_probs(c[2:].astype(int), m.log_sums()).mean()
    sq, rng = np.full(len(m.flat), 1e-4, np.float32), np.random.default_rng(1)
    for _ in range(200):
        m.train(data, sq, voc.noise, rng)
    m._first = None
    assert m.log_probs(c[2:].astype(int), m.log_sums()).mean() > before + 0.7
