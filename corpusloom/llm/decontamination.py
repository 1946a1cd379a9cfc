"""Operator 2: benchmark decontamination with a generalised suffix automaton over words.

Test items, lower-cased (A-Z) and cut into words, go into one automaton. Each document's words stream through it; the
length of the longest item passage that ends at each word tells whether a window (``window`` consecutive item words, or
a whole shorter item) ends there. ``match_items`` reports hits, ``decontaminate`` removes hit spans and drops documents
whose hit share exceeds a limit.

The automaton is built on the driver from at most about SHARD_BYTES of item text and broadcast. More item text goes into
more automata, by a hash of the item: documents pass one at a time, without a shuffle, and are written with the hits so far
before the next is made, so that neither the driver nor a worker ever holds more than one (an item longer than that is an
automaton of its own size).

Defined results: null and empty texts have no words and no hits; an item without words has no window; items that repeat
or share an item_id count once for each item_id; an item with a null item_id marks words but isn't listed; empty tables
give no hits; input columns that clash with output names are replaced; every document row gives one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, ship, table

WINDOW = 10
SHARD_BYTES = 8_000_000
MAX_COVERAGE = 0.5
#: Bytes that end words become spaces, A-Z become a-z; all bytes from 0x80 up belong to words.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of each window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = []
        for item, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((item, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in coded)])
        self._mark(coded)

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(edges)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of q for the strings that also follow p."""
        clone = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.len[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._split(p, c, q)
        return new

    def _mark(self, coded) -> None:
        """Which state stands for the window that ends in each state, and which items hold it."""
        n, w = len(self.len), self.window
        self.owner = [-1] * n
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        order = sorted(range(n), key=self.len.__getitem__)
        for v in order:
            if self.len[v] >= w:
                self.owner[v] = v if self.len[self.link[v]] < w else self.owner[self.link[v]]
        for item, ids in coded:
            v = 0
            for i, c in enumerate(ids):
                v = self.next[v][c]
                if i + 1 >= w:
                    self.items.setdefault(self.owner[v], set()).add(item)
            if len(ids) < w:
                self.short.setdefault(v, []).append((len(ids), item))
        self.above = [-1] * n  # the nearest state on the way to the root, itself included, where a short item ends
        for v in order:
            self.above[v] = v if v in self.short else self.above[self.link[v]] if self.link[v] >= 0 else -1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Merged [from, to) word spans inside window occurrences, and the items that have one."""
        spans: list[list[int]] = []
        found: set = set()
        n = len(words)
        if n < self.shortest or not self.vocab:
            return [], found
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), dtype=np.int64, count=n)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        step, link, length, w = self.next, self.link, self.len, self.window
        # A window lies within a run of words that items have.
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a < self.shortest:
                continue
            v = m = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                while v and c not in step[v]:
                    v = link[v]
                    m = length[v]
                if c in step[v]:
                    v = step[v][c]
                    m += 1
                reach = 0
                if m >= w:
                    reach = w
                    found |= self.items[self.owner[v]]
                u = self.above[v]
                while u >= 0:
                    for k, item in self.short[u]:
                        if k <= m:
                            found.add(item)
                            reach = max(reach, k)
                    u = self.above[link[u]] if link[u] >= 0 else -1
                if reach:
                    start = i + 1 - reach
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        spans[-1][1] = i + 1
                    else:
                        spans.append([start, i + 1])
        return [tuple(s) for s in spans], found


def _union(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(s) for s in out]


MATCH = "n:long,s:array<struct<a:int,b:int>>,i:array<string>"


def _pass(docs: DataFrame, automaton: SuffixAutomaton, text_col: str, cover: float | None) -> tuple[DataFrame, Broadcast]:
    """``docs`` with __m, the hits of ``automaton`` added to those in __m, and the broadcast.

    cover: also with the text that is left without hit spans, where their share is at most that; in the same pass, so that a
    task needs one Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    @F.pandas_udf(f"struct<{MATCH},t:string>")
    def match(parts: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        a = shared.value
        for texts, before in parts:
            rows = []
            for t, s, i in zip(texts, before["s"], before["i"]):
                words = words_of(t)
                spans, found = a.hits(words)
                if s is not None and len(s):
                    spans, found = _union([*spans, *((x["a"], x["b"]) for x in s)]), found | set(i)
                cut = cut_spans(t, spans) if cover is not None and spans and sum(y - x for x, y in spans) <= len(words) * cover else None
                rows.append((len(words), [{"a": x, "b": y} for x, y in spans], sorted(x for x in found if x is not None), cut))
            yield pd.DataFrame(rows, columns=["n", "s", "i", "t"])

    # A condition on the hits must not be pushed below, where it would match every text a second time in a second worker.
    return docs.withColumn("__m", match.asNondeterministic()(F.col(text_col), F.col("__m"))), shared


def _matched(docs: DataFrame, items: DataFrame, text_col: str, item_col: str, item_text_col: str, window: int, cover: float | None = None) -> DataFrame:
    ship(docs.sparkSession)
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    if shards > 1:
        rows = materialize(rows.withColumn("k", F.pmod(F.xxhash64("t"), F.lit(shards))), "items")
    out = docs.withColumn("__m", F.lit(None).cast(f"struct<{MATCH},t:string>"))
    for k in range(shards):
        own = rows if shards == 1 else rows.where(F.col("k") == k).select("i", "t")
        automaton = SuffixAutomaton([(r.i, words_of(r.t)) for r in own.distinct().toLocalIterator()], window)
        out, shared = _pass(out, automaton, text_col, cover if k == shards - 1 else None)
        if k < shards - 1:
            out = materialize(out, "matched")
            shared.destroy()
    return out


def match_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_hit, hit_spans (word positions [first, last)) and hit_items (item ids as sorted strings)."""
    own = ("n_words", "n_hit", "hit_spans", "hit_items")
    packed = docs.select(F.struct(F.lit(0).alias("__"), *[c for c in docs.columns if c not in (*own, text_col)]).alias("__doc"), F.col(text_col).alias("__text"))
    out = _matched(packed, items, "__text", item_col, item_text_col, window)
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col("__doc")[c].alias(c) for c in docs.columns if c not in own], F.col("__m.n").alias("n_words"), _hit_words().alias("n_hit"), F.col("__m.s").alias("hit_spans"), F.col("__m.i").alias("hit_items"))


def _hit_words() -> Column:
    return F.aggregate("__m.s", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``, one line break in place of each."""
    data = text.encode()
    places = [m.span() for m in WORD.finditer(data.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : places[a][0]])
        at = places[b - 1][1]
    out.append(data[at:])
    return b"\n".join(out).decode()


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs``, same columns, without hit spans; documents with a larger share of hit words than ``max_coverage`` go.

    Documents without hits stay as they are, null and empty ones too.
    """

    # Documents carry their own columns in a struct, so that none clashes with those of the match.
    packed = docs.select(F.struct(*[c for c in docs.columns if c != text_col]).alias("__doc") if len(docs.columns) > 1 else F.lit(0).alias("__doc"), F.col(text_col).alias("__text"))
    found = _matched(packed, items, "__text", "item_id", "text", window, max_coverage).where(_hit_words() <= F.col("__m.n") * max_coverage)
    return found.select(*[F.coalesce("__m.t", "__text").alias(c) if c == text_col else F.col("__doc")[c].alias(c) for c in docs.columns])


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = match_items(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op2_decontamination": op2_decontamination}
SQL: dict[str, str] = {}
