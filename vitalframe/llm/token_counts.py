"""Token counts: a prefix dynamic program over byte-level BPE.

For every prefix of a text (in code points) the operator stores the exact
number of tokens that the library would give for that prefix alone. Truncation
and budget questions are then answered from the table, without encoding again.

Method. A byte sequence has one BPE encoding, and a token sequence is an
encoding exactly when each pair of neighbours is one (the merges of the two
tokens' bytes give the two tokens back). So the encoding of a prefix of a
pre-token is that of a shorter prefix followed by one token, found by trying
the tokens that end there and checking the pair. This fills counts for all
prefixes in one sweep. Pre-tokens join into *units* (white space with what
follows it, or a contraction) whose counts depend on the unit alone; a table
of signed differences per unit is kept in a bounded cache, and a text's table
is the concatenation of its units' differences.

Table: binary, one signed difference per code point, little endian, width in
the first byte (1, 2 or 4). Null text: treated as empty, table of no entries.
Special strings of the tokenizer inside a text are one token, as in the library.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

# The byte-level pre-token pattern of the vocabulary file's format.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# A unit: what must be looked at together so that counts don't depend on the rest.
_UNIT = regex.compile(r"(?:\s*[^\S ])?'(?:s|t|re|ve|m|ll|d)|\s*(?:\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+)|\s+")
#: White space as the patterns see it: not what ``str.isspace`` holds (U+001C to U+001F).
_SPACES = regex.compile(r"\s*")
CACHE_UNITS, CACHE_UNIT_CHARS = 300_000, 48


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix token counts for one ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are handled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with word or strip rules are not handled")
        to_byte = _byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = i
        special = {t["content"] for t in spec["added_tokens"]}
        tokens = sorted(raw(t) for t in model["vocab"] if t not in special)
        number = {t: i + 1 for i, t in enumerate(tokens)}  # 0: no token before
        # By bytes: the token's number, 0 for what is only the end of a longer token.
        self.ids = {t[k:]: 0 for t in tokens for k in range(1, len(t))} | number
        self.bytes_of = [b"", *tokens]
        self.pair_rank = {number[a] << 32 | number[b]: i for (a, b), i in self.rank.items()}
        self._made: list[tuple[int, int, int] | None] = [None] * len(self.bytes_of)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self._pairs: dict[int, bool] = {}
        self._units: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _merged(self, piece: bytes, least: int = 1) -> list[bytes]:
        """BPE of a short byte string, merge by merge, until ``least`` parts are left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 60), i))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _pair_ok(self, key: int, left: int, token: int, first: bool) -> bool:
        """Whether the two tokens' bytes encode to them (left 0: none before)."""
        if len(self._pairs) > 2_000_000:
            self._pairs.clear()
        known = self._pairs[key] = self._last_merge(token)[0] > -2 and (first or self._stay_apart(left, token))
        return known

    def _last_merge(self, token: int) -> tuple[int, int, int]:
        """Rank and the two tokens of the merge that completes a token. Rank -1: a
        single byte; -2: its bytes encode otherwise."""
        made = self._made[token]
        if made is None:
            piece = self.bytes_of[token]
            made = (-1, 0, 0)
            if len(piece) > 1:
                parts = self._merged(piece, 2)
                rank = self.rank.get(tuple(parts), -2)
                made = (rank, self.ids[parts[0]], self.ids[parts[1]]) if rank >= 0 else (-2, 0, 0)
            self._made[token] = made
        return made

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens. The merges of both are
        undone, latest first (of equal ones the right one, as merging goes from the
        left); what then meets at the border must not merge before the one undone."""
        until = 1 << 60
        while self.pair_rank.get(left << 32 | right, until) >= until:
            (rank_l, _, end), (rank_r, begin, _) = self._last_merge(left), self._last_merge(right)
            if rank_l < 0 and rank_r < 0:
                return True
            if rank_l > rank_r:
                until, left = rank_l, end
            else:
                until, right = rank_r + 1, begin
        return False

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of ``piece[:i]`` for i from 0 to its length."""
        n, ids, pairs = len(piece), self.ids, self._pairs
        last, count = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - 1, -1, -1):
                token = ids.get(piece[j:i])
                if not token:
                    if token is None:  # no token ends like this
                        raise ValueError("the vocabulary doesn't cover these bytes")
                    continue
                key = last[j] << 32 | token
                ok = pairs.get(key)
                if ok is None:
                    ok = self._pair_ok(key, last[j], token, j == 0)
                if ok:
                    last[i], count[i] = token, count[j] + 1
                    break
            else:
                raise ValueError("the vocabulary doesn't cover these bytes")
        return count

    def _unit_counts(self, unit: str) -> list[int]:
        """Tokens of ``unit[:k]`` for k from 1 to its length."""
        space = _SPACES.match(unit).end()
        body = unit[space:]
        if not space and body.isascii() and body[0] != "'":
            return self.piece_counts(body.encode())[1:]
        if space == 1 and unit[0] == " " and body.isascii() and body:
            return self.piece_counts(unit.encode())[1:]
        out: list[int] = []
        if space:  # a run of white space so far is one pre-token
            counts = self.piece_counts(unit[:space].encode())
            out += [counts[e] for e in _ends(unit[:space])]
        if not body:
            return out
        if body[0] == "'" and body[1:2].isalpha():  # a contraction: pre-tokens change with each letter
            for k in range(space + 1, len(unit) + 1):
                out.append(sum(self.piece_counts(p.encode())[-1] for p in _PRETOKEN.findall(unit[:k])))
            return out
        head = unit[:space]
        if head.endswith(" "):
            before, lead = [head[:-1]] if space > 1 else [], " "
        else:
            before, lead = ([head[:-1]] if space > 1 else []) + ([head[-1]] if space else []), ""
        base = sum(self.piece_counts(p.encode())[-1] for p in before)
        counts = self.piece_counts((lead + body).encode())
        return out + [base + counts[e] for e in _ends(lead + body)[len(lead) :]]

    def _unit_table(self, unit: str) -> bytes | None:
        """Differences as signed bytes; None if one of them needs more."""
        known = self._older.get(unit)
        if known is None:
            at, out = 0, bytearray()
            for c in self._unit_counts(unit):
                if not -128 <= c - at <= 127:
                    return None
                out.append((c - at) & 255)
                at = c
            known = bytes(out)
        if len(unit) <= CACHE_UNIT_CHARS:
            if len(self._units) >= CACHE_UNITS:  # what was used lately stays
                self._older, self._units = self._units, {}
            self._units[unit] = known
        return known

    def steps(self, text: str) -> np.ndarray:
        """Signed differences of the prefix counts, one per code point."""
        parts: list[np.ndarray] = []
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                parts.append(self._plain(text[at : m.start()]))
            # Short of its end a special string is ordinary text; complete, it is one
            # token, and what stands before it is a text of its own. As that can
            # change the white space just before it, count the tail unit again.
            parts.append(self._special_steps(text[at : m.start()], m[0]))
            at = m.end()
        if at < len(text) or not parts:
            parts.append(self._plain(text[at:]))
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    def _special_steps(self, before: str, special: str) -> np.ndarray:
        tail = before
        units = _UNIT.findall(before[-4096:]) if before else []
        if units and len(units) > 1:
            tail = units[-1]
        whole = lambda s: sum(self.piece_counts(p.encode())[-1] for p in _PRETOKEN.findall(s))
        base = whole(tail)
        counts = [whole(tail + special[:k]) - base for k in range(1, len(special))] + [1]
        return np.diff(np.array([0, *counts], dtype=np.int64))

    def _plain(self, text: str) -> np.ndarray:
        known, table = self._units.get, self._unit_table
        parts = [known(u) or table(u) for u in _UNIT.findall(text)]
        if None in parts:
            return np.concatenate([np.diff(np.array([0, *self._unit_counts(u)], dtype=np.int64)) if p is None else np.frombuffer(p, np.int8) for u, p in zip(_UNIT.findall(text), parts, strict=True)])
        return np.frombuffer(b"".join(parts), np.int8)

    def table(self, text: str | None) -> bytes:
        """The stored form of a text's prefix counts."""
        steps = self.steps(text or "")
        width = 1 if steps.dtype == np.int8 or steps.size == 0 or (steps.min() >= -128 and steps.max() <= 127) else 4
        return bytes([width]) + steps.astype(f"<i{width}").tobytes()


def _ends(s: str) -> list[int]:
    """Byte offsets of the ends of the code points of ``s``."""
    if s.isascii():
        return list(range(1, len(s) + 1))
    return np.cumsum([len(c.encode()) for c in s]).tolist()


@functools.lru_cache(maxsize=2)
def load_counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(table: bytes) -> np.ndarray:
    """Counts for prefixes of 0, 1, ... code points from a stored table."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, f"<i{table[0]}", offset=1), dtype=np.int64)])


def total(table: bytes) -> int:
    """Tokens of the whole text."""
    return int(np.frombuffer(table, f"<i{table[0]}", offset=1).sum(dtype=np.int64))


def longest_within(table: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(table) <= budget)[-1])


def with_prefix_tables(df: DataFrame, tokenizer_file: str, text_col: str = "text", out: str = "prefix_table") -> DataFrame:
    """Add the table of exact prefix counts (binary; one entry per code point)."""

    @F.arrow_udf("binary")
    def tables(texts: pa.Array) -> pa.Array:
        c = load_counter(tokenizer_file)
        return pa.array([c.table(t) for t in texts.to_pylist()], pa.binary())

    return df.withColumn(out, tables(F.col(text_col)))


def _answers(fn, returns, kind):
    @F.arrow_udf(returns)
    def ask(tables: pa.Array) -> pa.Array:
        return pa.array([None if t is None else fn(t) for t in tables.to_pylist()], kind)

    return ask


def token_count(table: Column) -> Column:
    """Tokens of the whole text, from its table."""
    return _answers(total, "long", pa.int64())(table)


def truncate_to_budget(table: Column, budget: int) -> Column:
    """Code points of the longest prefix within ``budget`` tokens."""
    return _answers(lambda t: longest_within(t, budget), "long", pa.int64())(table)


def store_counts(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Build the tables of all texts once and keep them in the shared folder:
    id, ``n_bytes``, ``n_chars``, ``prefix_table``. No shuffle. Questions go to
    what is stored (``answer``), not to the texts.

    Defined results: a null text counts as empty (no bytes, no tokens); an empty
    table gives no rows; equal rows get equal tables; other columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = df.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), F.length(text).cast("long").alias("n_chars"), text.alias("__text"))
    schema = kept.drop("__text").schema.add("prefix_table", "binary")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = load_counter(tokenizer_file)
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([c.table(t) for t in batch.column(3).to_pylist()], pa.binary())], names=schema.names)

    return materialize(arrow_map(kept, run, schema), "token-tables")


def answer(stored: DataFrame, budgets: Iterable[int] = (512,)) -> DataFrame:
    """Stored tables without the tables: the other columns, ``n_tokens`` and per
    budget ``keep_<b>``, the code points of the longest prefix that fits."""
    budgets = list(budgets)
    rest = [c for c in stored.columns if c != "prefix_table"]
    schema = stored.select(*rest).schema.add("n_tokens", "long")
    for b in budgets:
        schema = schema.add(f"keep_{b}", "long")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in batch.column(len(rest)).to_pylist():
            n = total(t)
            rows.append((n, *(longest_within(t, b) for b in budgets)))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *(pa.array(x, pa.int64()) for x in zip(*rows, strict=True))], names=schema.names)

    return arrow_map(stored.select(*rest, "prefix_table"), run, schema)


def count_tokens(df: DataFrame, tokenizer_file: str, budgets: Iterable[int] = (512,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_chars``, ``n_tokens`` and ``keep_<b>`` per budget,
    from tables that are stored first."""
    return answer(store_counts(df, tokenizer_file, id_col, text_col), budgets)
