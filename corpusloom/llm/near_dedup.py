"""Operator 10: MinHash near-duplicates by a multi-index Hamming join.

A document's set is that of its distinct SHINGLE-word shingles. Its signature has SYMBOLS minima, B bits of each. Two
signatures are near when they differ in at most ``distance`` symbols, which a linked pair exceeds with a chance of at most
LOSS (binomial in the similarity asked for; 13 of 32 symbols at 0.85). Signatures split into chunks; by pigeonhole, a near
pair has a chunk with at most one differing symbol, as there are more than half as many chunks as differences. Each
chunk therefore enters the index once for each of its symbols, that symbol left out: 32 keys a document find every near
pair.

Documents with the same set are one node, so copies are never paired. Nodes that share a key first meet the bucket's
smallest node, and links are confirmed on the full sets. Buckets that then still fall into several components become one
where they hold mostly the same nodes, and are compared within bounded blocks by sizes and signatures, and confirmed on the
full sets too; those of more than FINER blocks first become finer ones by a second pigeonhole, on all symbols in more chunks
than a near pair has differences, of which it therefore shares one without an error.

Defined results: null and empty texts, and texts of blanks, have an empty set and link with nothing; a text of fewer
words than a shingle is one shingle; each input row gives one row, repeated ones too; rows that repeat a doc_id with other
texts are documents of their own; null doc_ids are never a component's id unless all of it has none; empty tables give
empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, release, ship, table

from .components import in_blocks, join_facts, linked_classes

SHINGLE = 5
SYMBOLS, LOSS = 32, 5e-5
PRIME = np.uint64(0x9E3779B97F4A7C15)
WORDS_KEPT = 200_000


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


FACTORS = _odd(SYMBOLS, 10)


def _bound(n: int, miss: float, loss: float) -> int:
    """The least t that n tries, each failing with chance ``miss``, exceed with a chance of at most ``loss``."""
    tail, t = 1.0, -1
    while tail > loss:
        t += 1
        tail -= math.comb(n, t) * miss**t * (1 - miss) ** (n - t)
    return t


class Index:
    """Distances and keys for a similarity of ``percent`` hundredths."""

    def __init__(self, percent: int):
        self.percent = percent
        self.distance = _bound(SYMBOLS, 1 - percent / 100, LOSS)
        chunks = np.array_split(np.arange(SYMBOLS), self.distance // 2 + 1)
        #: What each key hashes: the positions of a chunk but one, and a factor for each.
        self.parts = [(np.delete(at, skip), _odd(len(at) - 1, 1000 + int(at[skip]))) for at in chunks for skip in range(len(at))]
        self.finer = np.array_split(np.arange(SYMBOLS), self.distance + 1)

    def keys(self, symbols: np.ndarray) -> np.ndarray:
        """The keys of signatures, a row for each: every chunk without one of its symbols, hashed with where it stands."""
        x = symbols.astype(np.uint64) + np.uint64(1)
        out = np.empty((len(x), len(self.parts)), dtype=np.uint64)
        for k, (at, factors) in enumerate(self.parts):
            h = (x[:, at] * factors).sum(axis=1, dtype=np.uint64)
            out[:, k] = (h ^ (h >> np.uint64(29))) * PRIME + np.uint64(k)
        return out.view(np.int64)

    def finer_keys(self, keys: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Keys below ``keys``: one for each chunk of the second pigeonhole, of its symbols and the key."""
        x, k = symbols.astype(np.uint64), keys.astype(np.int64).view(np.uint64)
        out = np.empty((len(x), len(self.finer)), dtype=np.uint64)
        for c, at in enumerate(self.finer):
            h = k * PRIME + np.uint64(c)
            for i in at:
                h = (h ^ (h >> np.uint64(29))) * PRIME + x[:, i]
            out[:, c] = (h ^ (h >> np.uint64(31))) * PRIME
        return out.view(np.int64)


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of words; ``known`` keeps those of a task's words."""
    import xxhash

    if len(known) > WORDS_KEPT:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, known: dict[bytes, int] | None = None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; bytes.lower() changes A-Z alone, split() cuts at ASCII blanks."""
    words = text.encode().lower().split() if text else []
    h = word_hashes(words, {} if known is None else known)
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    s = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(h))):
        s = s * PRIME + h[i : i + n]
    return np.unique(s * PRIME + np.uint64(min(k, len(h))))


def minima(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return np.array([(s * a).min() for a in factors], dtype=np.uint64)


def signatures(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` columns with __n (set size), __node (16 bytes that stand for the set; null if empty) and __sig."""

    @F.pandas_udf("struct<n:long,node:binary,sig:binary>")
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        known: dict[bytes, int] = {}
        for part in parts:
            rows = []
            for t in part:
                s = shingle_set(t, known)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), minima(s, FACTORS).astype("<u2").tobytes()) if len(s) else (0, None, None))
            yield pd.DataFrame(rows, columns=["n", "node", "sig"])

    return df.withColumn("__s", sign(F.col(text_col))).select(*keep, F.col("__s.n").alias("__n"), F.col("__s.node").alias("__node"), F.col("__s.sig").alias("__sig"))


def _classes(df: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """(__id, __key, __n, __node) for each row, and (__node, rows, comp, first) for each node.

    __node stands for the row's set and is null for empty ones; comp is the component's smallest node, first the smallest
    (__id, __key) of its rows with an id, or null.
    """
    index = Index(percent)
    ship(df.sparkSession)
    docs = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__key"))
    signed = materialize(signatures(docs, "__text", ["__id", "__key"]), "signed")
    row = F.struct("__id", "__key")
    # Any row has the set; the one with the smallest id stands for it, so that copies don't meet in a task.
    nodes = signed.where("__node is not null").groupBy(F.col("__node").alias("node")).agg(
        F.count("*").alias("rows"), F.min(row).alias("row"), F.min(F.when(F.col("__id").isNotNull(), row)).alias("first"), F.first("__n").alias("n"), F.first("__sig").alias("sig")
    )
    nodes = materialize(nodes, "nodes")

    @F.pandas_udf("array<long>")
    def keys(sigs: pd.Series) -> pd.Series:
        return pd.Series(list(index.keys(np.frombuffer(b"".join(sigs), dtype="<u2").reshape(-1, SYMBOLS))), dtype=object)

    entries = nodes.select("node", F.explode(keys("sig")).alias("key")).repartition("key")
    shared = entries.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
    members = materialize(entries.join(shared, "key").select("key", "node", F.lit(3).alias("kind")), "members")

    # Full sets, of nodes that share a key only, from one text of each.
    wanted = members.select("node").distinct().join(nodes.select("node", "row"), "node").select(F.col("row.__id").alias("i"), F.col("row.__key").alias("k"), F.col("node").alias("want"))
    texts = docs.join(wanted, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__key") == F.col("k"))).groupBy("want").agg(F.first("__text").alias("__text"))

    @F.pandas_udf("array<long>")
    def full(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, int] = {}
        for part in parts:
            yield pd.Series([shingle_set(t, known).view(np.int64) for t in part], dtype=object)

    sets = materialize(texts.select(F.col("want").alias("node"), full("__text").alias("s")).join(nodes.select("node", "n"), "node"), "sets")

    def verify(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa"))
        b = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb"))
        sizes = sets.select("node", "n")
        # Sizes alone rule most pairs out before sets move.
        p = pairs.join(sizes.toDF("a", "n1"), "a").join(sizes.toDF("b", "n2"), "b").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * percent).select("a", "b")
        both = F.size(F.array_intersect("sa", "sb"))
        return p.join(a, "a").join(b, "b").where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b")

    def residual_links(dealt: DataFrame) -> DataFrame:
        rows = dealt.join(nodes.select("node", "n", "sig"), "node")

        def candidates(cols: dict[str, np.ndarray], first: int, last: int) -> list[tuple]:
            """A row for each node of a block that is in a near pair, with those of its partners that come after it."""
            pa, pb, key = cols["part_a"][first], cols["part_b"][first], int(cols["key"][first])
            part, n, node, comp = (cols[c][first:last] for c in ("part", "n", "node", "comp"))
            codes: dict[bytes, int] = {}
            comp = np.fromiter((codes.setdefault(c, len(codes)) for c in comp), dtype=np.int64, count=len(comp))
            sig = np.frombuffer(b"".join(cols["sig"][first:last]), dtype="<u2").reshape(-1, SYMBOLS)
            y, found, met = np.flatnonzero(part == pb), {}, set()
            for i in np.flatnonzero(part == pa).tolist():
                js = y[y > i] if pa == pb else y
                js = js[(comp[js] != comp[i]) & (np.minimum(n[js], n[i]) * 100 >= np.maximum(n[js], n[i]) * percent)]
                if len(js):
                    js = js[(sig[js] != sig[i]).sum(axis=1) <= index.distance]
                if len(js):
                    found[i] = [node[j] for j in js]
                    met.update(js.tolist())
            return [(key, pa, pb, node[i], found.get(i, [])) for i in sorted(met | found.keys())]

        def links(cols: dict[str, np.ndarray], first: int, last: int) -> list[tuple]:
            """Near pairs confirmed on full sets; pairs that the links so far already join are passed over."""
            at = {node: i for i, node in enumerate(cols["node"][first:last])}
            full, top, out = cols["s"][first:last], list(range(last - first)), []

            def root(i: int) -> int:
                while top[i] != i:
                    top[i] = top[top[i]]
                    i = top[i]
                return i

            for node, i in at.items():
                for other in cols["others"][first + i]:
                    j = at[other]
                    if root(i) != root(j):
                        both = len(np.intersect1d(full[i], full[j], assume_unique=True))
                        if both * 100 >= (len(full[i]) + len(full[j]) - both) * percent:
                            top[root(i)] = root(j)
                            out.append((node, other))
            return out

        near = in_blocks(rows.select("key", "part", "part_a", "part_b", "node", "comp", "n", "sig"), candidates, "key long, part_a int, part_b int, node binary, others array<binary>")
        return in_blocks(near.join(sets.select("node", "s"), "node"), links, "a binary, b binary")

    def refine(large: DataFrame) -> DataFrame:
        @F.pandas_udf("array<long>")
        def finer(keys_: pd.Series, sigs: pd.Series) -> pd.Series:
            return pd.Series(list(index.finer_keys(keys_.to_numpy(), np.frombuffer(b"".join(sigs), dtype="<u2").reshape(-1, SYMBOLS))), dtype=object)

        entries = large.join(nodes.select("node", "sig"), "node").select("node", F.explode(finer("key", "sig")).alias("key"))
        several = entries.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
        return entries.join(several, "key").select("key", "node", F.lit(3).alias("kind"))

    comps = linked_classes(members, verify, residual_links, refine)
    of_nodes = nodes.select("node", "rows", "first").join(comps, "node", "left").select("node", "rows", "first", F.coalesce("comp", "node").alias("comp"))
    of_nodes = materialize(of_nodes, "nodes")
    release(members, sets, nodes, comps)
    of_comps = of_nodes.groupBy("comp").agg(F.count("*").alias("many"), F.min("first").alias("first"))
    # A node that is alone in its component needn't be joined with it.
    whole = join_facts(of_nodes.select("node", "rows", "comp"), of_comps, "comp", "many", "inner")
    return signed.select("__id", "__key", "__n", "__node"), whole.select(F.col("node").alias("__node"), "rows", "comp", "first")


def near_duplicate_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``df``; see the module's text. Links: 100 * |A and B| >= percent * |A or B|."""
    rows, facts = _classes(df, id_col, text_col, percent)
    found = join_facts(rows.where("__node is not null"), facts, "__node", "rows", "inner").select("__id", "__n", F.col("first.__id").alias("least"))
    empty = rows.where("__node is null").select("__id", "__n", F.col("__id").alias("least"))
    return found.union(empty).select(F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), F.col("least").alias("component_id"), F.col("__id").eqNullSafe(F.col("least")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``df`` with one row of each component, that of the smallest id (then of the smallest text hash); empty texts all stay.

    Null ids come first. Which of several rows that agree in id and text stays isn't determined.
    """
    rows, facts = _classes(df, id_col, text_col, percent)
    nodes = rows.where("__node is not null").groupBy("__node").agg(F.min(F.struct("__id", "__key")).alias("row"), F.count("*").alias("n"))
    first = nodes.join(facts.select("__node", "comp"), "__node").groupBy("comp").agg(F.min("row").alias("row"))
    stay = materialize(first.select(F.col("row.__id").alias("i"), F.col("row.__key").alias("k"), F.lit(False).alias("blank")).union(rows.where("__node is null").select("__id", "__key", F.lit(True)).distinct()), "stay")
    same = F.col("__id").eqNullSafe(F.col("i")) & F.col("__key").eqNullSafe(F.col("k"))
    kept = df.select(F.struct(*df.columns).alias("__doc"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__key")).join(stay, same)
    again = rows.where("__node is not null").groupBy("__id", "__key").count().where("count > 1")
    if not again.isEmpty():
        kept = kept.where("blank").select("__doc").union(kept.where("not blank").groupBy("__id", "__key").agg(F.first("__doc").alias("__doc")).select("__doc"))
    return kept.select(*[F.col("__doc")[c].alias(c) for c in df.columns])


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_near_dedup": op10_near_dedup}
SQL: dict[str, str] = {}
