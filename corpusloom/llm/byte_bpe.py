"""Operator 7: byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash (hash and displace) over the vocabulary: it resolves a whole pre-token that is itself
a vocabulary entry. Tier two merges the bytes of a miss with a heap over a linked list. Texts first divide into
blank-then-nonblank chunks, whose pre-tokens never reach into the next chunk; the identifiers of chunks and pre-tokens
stay in bounded tables for a task.

Defined results: null and empty texts have no identifiers and decode to no bytes; every row gives one row; input columns
that clash with output names are replaced; an empty table gives an empty table; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import ship, table

from .merge_queue import Made, merge_spans

#: Unicode White_Space, which \s stands for in the vocabulary's pattern.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
KEPT_CHUNKS, KEPT_TOKENS = 150_000, 150_000
#: Marks that are a pre-token of their own after a word at a chunk's end.
ENDS = frozenset(".,;:!?")
WORD = (1 << 64) - 1
_CODECS: dict = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """bytes -> rank of a rank file: base64 and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash of byte strings: a bucket's displacement sends its keys to slots of their own."""

    MIX, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.buckets = self.n // 4 + 1
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        self.slots: list[bytes | None] = [None] * self.n
        h = self.hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.n, dtype=bool)
        sizes = np.diff(bounds)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                continue
            start = 0
            while True:
                tries = np.arange(start, start + 256, dtype=np.uint64)
                at = self.place(h[own][None, :], tries[:, None])
                s = np.sort(at, axis=1)
                good = free[at].all(axis=1) & (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    d = int(np.argmax(good))
                    break
                start += 256
            self.shift[b] = start + d
            free[at[d]] = False
            for k, slot in zip(own, at[d]):
                self.slots[slot] = keys[k]
        rest = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):
            slot = int(next(rest))
            self.shift[b] = -slot - 1
            self.slots[slot] = keys[order[bounds[b]]]
        self.ready()

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        import xxhash

        return np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)

    def place(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = (h ^ ((d + np.uint64(1)) * self.MIX)) * self.SPREAD
        return ((x >> np.uint64(33)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key that is in the table, else -1."""
        return np.array([self.slot(k) for k in keys], dtype=np.int64)

    def slot(self, key: bytes) -> int:
        h = self.digest(key)
        d = self.shifts[h % self.buckets]
        slot = -d - 1 if d < 0 else (((h ^ (d + 1) * self.mix & WORD) * self.spread & WORD) >> 33) % self.n
        return slot if self.slots[slot] == key else -1

    def ready(self) -> None:
        """What ``slot`` reads: Python numbers, which single look-ups are faster with."""
        import xxhash

        self.digest, self.shifts = xxhash.xxh3_64_intdigest, self.shift.tolist()
        self.mix, self.spread = int(self.MIX), int(self.SPREAD)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("n", "buckets", "shift", "slots")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.ready()


class ByteCodec:
    """Encodes and decodes with one rank table; built on the driver, one copy for each worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.table = PerfectHash(list(ranks))
        self.slot_id = [ranks[k] if k is not None else -1 for k in self.table.slots]
        self.pattern = pattern
        self._ready()

    def _ready(self) -> None:
        import regex

        self.chunks = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
        self.pieces = regex.compile(self.pattern.replace("[^\\s", "[^" + BLANK).replace("\\S", f"[^{BLANK}]").replace("\\s", f"[{BLANK}]"))
        #: Ranks of two bytes by the first and the second.
        self.pairs = [[self.ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.forget()

    def forget(self) -> None:
        """Empty the tables of chunks and tokens."""
        self.kept = Made(KEPT_CHUNKS, self.of_chunk)
        self.tokens = Made(KEPT_TOKENS, self.of_token)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ranks", "table", "slot_id", "pattern")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def of_token(self, token: str) -> bytes:
        """The identifiers, packed: tier one for entries of the vocabulary, tier two for the rest."""
        raw = token.encode()
        slot = self.table.slot(raw)
        if slot >= 0:
            return self.slot_id[slot].to_bytes(4, "little")
        ranks = self.ranks
        ends, _ = merge_spans(raw, ranks, self.pairs)
        return array("I", [ranks[raw[i:e]] for i, e in enumerate(ends) if e]).tobytes()

    def of_chunk(self, chunk: str) -> bytes:
        """Of the pattern's matches; a word, after a space or not, and a word with one mark need no pattern."""
        tokens = self.tokens
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            return tokens[chunk]
        if chunk[-1] in ENDS and word[:-1].isalpha():
            return tokens[chunk[:-1]] + tokens[chunk[-1]]
        return b"".join([tokens[t] for t in self.pieces.findall(chunk)])

    def encode(self, text: str | None) -> bytes:
        """Identifiers as little-endian unsigned 32-bit integers, end to end."""
        if not text:
            return b""
        chunks = (m.group() for m in self.chunks.finditer(text)) if len(text) > 1_000_000 else self.chunks.findall(text)
        return b"".join(map(self.kept.__getitem__, chunks))


def decode_ids(packed: bytes | None, words: dict[int, bytes]) -> bytes:
    if not packed:
        return b""
    return b"".join(map(words.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def _codec(df: DataFrame, ranks_path: str, pattern: str):
    """A broadcast codec; its size is the vocabulary's, whatever the corpus."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = ByteCodec(load_ranks(ranks_path), pattern)
    return df.sparkSession.sparkContext.broadcast(_CODECS[key])


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ids (binary: little-endian unsigned 32-bit integers) and n_tokens of ``text_col``.

    decoded: also with decoded, the bytes that the identifiers stand for, in the same pass over the rows.
    """
    ship(df.sparkSession)
    codec = _codec(df, ranks_path, pattern)
    words = {v: k for k, v in load_ranks(ranks_path).items()} if decoded else {}
    words = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("struct<ids:binary,data:binary>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c, w = codec.value, words.value
        for part in texts:
            ids = [c.encode(t) for t in part]
            yield pd.DataFrame({"ids": ids, "data": [decode_ids(i, w) if decoded else None for i in ids]}, dtype=object)
        # Workers outlive their tasks; their tables don't, so that other stages have the memory.
        c.forget()

    own = ("ids", "n_tokens", *(["decoded"] if decoded else []))
    out = df.select(F.struct(F.lit(0).alias("__"), *[c for c in df.columns if c not in own]).alias("__doc"), run(F.col(text_col)).alias("__e"))
    return out.select(
        *[F.col("__doc")[c].alias(c) for c in df.columns if c not in own],
        F.col("__e.ids").alias("ids"),
        (F.octet_length("__e.ids") / 4).cast("long").alias("n_tokens"),
        *([F.col("__e.data").alias("decoded")] if decoded else []),
    )


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with decoded (binary: the bytes of the identifiers in ``ids_col``; null gives none)."""
    ship(df.sparkSession)
    words = df.sparkSession.sparkContext.broadcast({v: k for k, v in load_ranks(ranks_path).items()})

    @F.pandas_udf("binary")
    def data(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = words.value
        for part in ids:
            yield pd.Series([decode_ids(i, w) for i in part], dtype=object)

    packed = df.select(F.struct(F.lit(0).alias("__"), *[c for c in df.columns if c != "decoded"]).alias("__doc"), data(F.col(ids_col)).alias("__data"))
    return packed.select(*[F.col("__doc")[c].alias(c) for c in df.columns if c != "decoded"], F.col("__data").alias("decoded"))


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of an encoded and decoded table."""
    return df.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def encode_documents(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return digests(encode(docs.select("doc_id", "text"), path, pattern, decoded=True).drop("text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
SQL: dict[str, str] = {}
