"""Operator 4: approximate nearest neighbours by learned partitions.

A bounded sample of vectors (by a hash of the vector: SAMPLE, or SAMPLED_PER_PART for each part where that is more, up to
MOST_SAMPLED) makes a neighbour graph, which is cut into balanced parts: median splits along principal directions start
it, and moves that gain neighbours within a part, under a bound on its size, refine it. A small network learns, from the
parts of each sampled vector's neighbours, where a vector's neighbours are. It files every vector under its most probable
part and sends a query to the most probable parts for exact reranking: as many as give the sample's held-out vectors a
recall of TARGET, and at least as together hold ENOUGH times k vectors. Neighbours in the sample are farther away than in the
whole, so that recall is, if anything, an underestimate. Data without any structure need most of the parts, clustered data
a few. Parts have PART_SIZE distinct vectors up to a few thousand vectors, then their number grows with the root of the
vectors (ROOTS times it), so that routing and scanning stay in balance, up to what MOST_SAMPLED can teach; parts are scanned
in blocks of bounded bytes, so a part of any size, or many queries for it, spread over tasks, and a query moves once to each
block of its parts. Huge components are held to a bound before the network sees them; distances are those of the vectors
themselves, and differences whose squares leave the range of a double are scaled first.

Equal vectors are one entry with its K + 1 smallest ids, which is all that the K nearest with ties to smaller ids can need;
equal queries are searched once. Within the parts searched results are exact: a block keeps every vector as near as its
K + 1 nearest, however many tie, until distances are exact and ids have settled the ties. Fewer than two parts of K + 1
vectors are one part.

Defined results: vectors that are null, zero, hold null or non-finite components, or have another dimension than most, and rows
with a null id take no part, neither as queries nor as candidates; rows that repeat id and vector count once; with fewer
than K candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import materialize, release, ship, table

K = 10
SAMPLE, SAMPLED_PER_PART, MOST_SAMPLED = 4096, 32, 65_536
GRAPH_K, HIDDEN, PART_SIZE, ROOTS = 12, 96, 64, 0.75
TARGET, HELD_OUT, ENOUGH = 0.95, 384, 4
#: Numbers in a block of the index and of queries: 8 MB and 4 MB.
INDEX_NUMBERS, QUERY_NUMBERS = 1 << 20, 1 << 19


def neighbour_graph(x: np.ndarray, k: int = GRAPH_K) -> np.ndarray:
    """The k nearest of each row of ``x`` (without itself)."""
    sq, k = (x * x).sum(1), min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for a in range(0, len(x), 512):
        d = sq[None, :] - 2 * x[a : a + 512] @ x.T
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        out[a : a + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 0.1) -> np.ndarray:
    """A part for each row: median splits, then moves that raise the number of neighbours in the own part."""
    part = np.zeros(len(x), dtype=np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            part[rows] = first
            continue
        c = x[rows] - x[rows].mean(0)
        _, _, v = np.linalg.svd(c[:: max(1, len(c) // 1024)], full_matrices=False)
        order = np.argsort(c @ v[0], kind="stable")
        cut = len(rows) * (n // 2) // n
        todo += [(rows[order[:cut]], first, n // 2), (rows[order[cut:]], first + n // 2, n - n // 2)]
    both = [set(g) for g in graph.tolist()]
    for i, g in enumerate(graph.tolist()):
        for j in g:
            both[j].add(i)
    near = [np.fromiter(s, dtype=np.int64) for s in both]
    size = np.bincount(part, minlength=parts)
    most = int(np.ceil(len(x) / parts * (1 + slack)))
    for _ in range(rounds):
        moved = 0
        for i, js in enumerate(near):
            count = np.bincount(part[js], minlength=parts)
            count[size >= most] = 0
            own, best = part[i], int(np.argmax(count))
            if best != own and count[best] > (part[js] == own).sum():
                size[own] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer and a softmax over parts; fitted by Adam to the parts of a vector's neighbours."""

    def __init__(self, x: np.ndarray, own: np.ndarray, near: np.ndarray, parts: int, limit: float = np.inf, epochs: int = 16, seed: int = 1):
        """own: the part of each row; near: those of its neighbours, which count half together. limit: of components."""
        rng = np.random.default_rng(seed)
        self.limit, self.mean, self.scale = limit, x.mean(0), x.std() + 1e-12
        z = ((x - self.mean) / self.scale).astype(np.float32)
        dims = z.shape[1]
        w = [rng.normal(0, dims**-0.5, (dims, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts)]
        self.w = [a.astype(np.float32) for a in w]
        m, v, t = [np.zeros_like(a) for a in self.w], [np.zeros_like(a) for a in self.w], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for a in range(0, len(z), 256):
                b = order[a : a + 256]
                h = np.maximum(z[b] @ self.w[0] + self.w[1], 0)
                g = self._softmax(h @ self.w[2] + self.w[3])
                rows = np.arange(len(b))
                g[rows, own[b]] -= 0.5
                np.subtract.at(g, (rows[:, None], near[b]), 0.5 / near.shape[1])
                g /= len(b)
                back = (g @ self.w[2].T) * (h > 0)
                grads, t = [z[b].T @ back, back.sum(0), h.T @ g, g.sum(0)], t + 1
                for k, d in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.w[k] -= (0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = ((np.clip(x, -self.limit, self.limit) - self.mean) / self.scale).astype(np.float32)
        return self._softmax(np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


    def parts_of(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each row, some rows at a time."""
        return np.concatenate([self(x[a : a + 4096]).argmax(1) for a in range(0, len(x), 4096)] or [np.zeros(0, dtype=np.int64)])


def limit_of(x: np.ndarray) -> float:
    """What components are held to: far above the usual ones, far below where squares leave a double's range."""
    usual = np.abs(x[x != 0])
    return min(1e100, 1e3 * float(np.median(usual))) if len(usual) else 1.0


def fit_router(x: np.ndarray, parts: int) -> Router:
    limit = limit_of(x)
    x = np.clip(x, -limit, limit)
    graph = neighbour_graph(x)
    part = balanced_parts(x, graph, parts)
    return Router(x, part, part[graph], parts, limit)


def probes_for(router: Router, x: np.ndarray, held_out: int, k: int = K, target: float = TARGET) -> int:
    """The fewest parts that hold ``target`` of the k nearest sample vectors of the first ``held_out`` ones."""
    x, k, found = np.clip(x, -router.limit, router.limit), min(k, len(x) - 1), []
    parts, sq = router.parts_of(x), (x * x).sum(1)
    for a in range(0, held_out, 64):
        asked = x[a : min(a + 64, held_out)]
        d = sq[None, :] - 2 * asked @ x.T
        d[np.arange(len(asked)), np.arange(a, a + len(asked))] = np.inf
        rank = np.argsort(np.argsort(-router(asked), axis=1), axis=1)
        found.append(np.take_along_axis(rank, parts[np.argpartition(d, k - 1, axis=1)[:, :k]], axis=1).ravel())
    reached = np.sort(np.concatenate(found))
    return int(reached[int(np.ceil(target * len(reached))) - 1]) + 1


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of ``q`` to rows; where squares leave the range of a double, by differences in their own unit."""
    with np.errstate(over="ignore", under="ignore"):
        d = x - q
        out = np.sqrt((d * d).sum(1))
        odd = ~np.isfinite(out) | ((out < 1e-140) & d.any(axis=1))
        if odd.any():
            unit = np.abs(d[odd]).max(axis=1)
            out[odd] = unit * np.sqrt(((d[odd] / unit[:, None]) ** 2).sum(1))
    return out


def usable(vector: Column) -> Column:
    """Neither null nor zero, every component there and finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda c: c != 0)


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, probes: int | None = None
) -> DataFrame:
    """(query_id, rank from 1, id, score): the k nearest found of each row that ``is_query`` (on ``id``) marks.

    ``probes``: the number of parts to search; by default the fit chooses it.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("v") == (sizes.d if sizes else 0))
    # The k + 1 smallest ids of a vector; Spark limits groups before the shuffle too.
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = materialize(ranked.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    n = entries.count()
    parts = 1 if n < 2 * (k + 1) else min(MOST_SAMPLED // SAMPLED_PER_PART, max(2, min(round(n / PART_SIZE), round(ROOTS * n**0.5))))
    router = None
    if parts > 1:
        size = max(SAMPLE, SAMPLED_PER_PART * parts)
        few = entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < (1 << 30) * 2 * size / n).orderBy(F.xxhash64("v")).limit(size).select("v")
        sample = np.stack([np.asarray(r.v, dtype=np.float64) for r in few.collect()])
        # Held-out vectors are the sample's first; the order is that of a hash.
        held_out = min(HELD_OUT, len(sample) // 4)
        router = fit_router(sample[held_out:], parts)
        probes = probes or probes_for(router, sample, held_out)
    shared = spark.sparkContext.broadcast(router)

    @F.pandas_udf("int")
    def file_under(v: pd.Series) -> pd.Series:
        if shared.value is None or not len(v):
            return pd.Series(np.zeros(len(v), dtype=np.int32))
        return pd.Series(shared.value.parts_of(np.stack(v.to_numpy())).astype(np.int32))

    index = materialize(entries.withColumn("part", file_under("v")), "index")
    release(entries)
    count = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # a row for each part

    @F.pandas_udf("array<int>")
    def route(v: pd.Series) -> pd.Series:
        if shared.value is None or not len(v):
            return pd.Series([[0]] * len(v), dtype=object)
        order = np.argsort(-shared.value(np.stack(v.to_numpy())), axis=1, kind="stable")
        held = np.array([count.get(p, 0) for p in range(parts)])
        out = []
        for o in order:
            reach = int(np.searchsorted(np.cumsum(held[o]), ENOUGH * k)) + 1
            out.append([int(p) for p in o[: max(probes or 1, reach)] if held[p]])
        return pd.Series(out, dtype=object)

    asked = rows.where(is_query).groupBy("v").agg(F.min("id").alias("q"))
    asked = materialize(asked.withColumn("part", F.explode(route("v"))), "queries")
    dims = max(1, sizes.d if sizes else 1)
    index_rows, query_rows = max(64, INDEX_NUMBERS // dims), max(64, QUERY_NUMBERS // dims)
    load = {r.part: r["count"] for r in asked.groupBy("part").count().collect()}
    blocks = lambda held, most: F.coalesce(F.create_map(*[F.lit(x) for p, c in held.items() for x in (p, -(-c // most))])[F.col("part")], F.lit(1)) if held else F.lit(1)
    a = index.withColumn("ib", F.pmod(F.xxhash64("v"), blocks(count, index_rows)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), blocks(load, query_rows) - 1)))
    b = asked.withColumn("qb", F.pmod(F.xxhash64("q"), blocks(load, query_rows)).cast("int")).withColumn("ib", F.explode(F.sequence(F.lit(0), blocks(count, index_rows) - 1)))

    def scan(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(entries) or not len(queries):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        x, y = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (entries, queries))
        # Rough values in a unit in which no square leaves the range of a double.
        big = max(np.abs(x).max(), np.abs(y).max())
        unit = big if big > 1e100 or big < 1e-100 else 1.0
        u = x / unit
        sq, most, out = (u * u).sum(1), min(len(x), k + 1), []
        ids = entries["ids"].to_list()
        for s in range(0, len(y), 256):
            part, rough_part = y[s : s + 256], y[s : s + 256] / unit
            rough = sq[None, :] - 2 * rough_part @ u.T
            # Rounding moves a rough value by far less than this.
            reach = np.partition(rough, most - 1, axis=1)[:, most - 1] + 1e-9 * (sq.max() + (rough_part * rough_part).sum(1))
            for i, q in enumerate(queries["q"].to_numpy()[s : s + 256]):
                near = np.flatnonzero(rough[i] <= reach[i])
                exact = distances(x[near], part[i])
                found = sorted((d, v) for d, j in zip(exact.tolist(), near.tolist()) for v in ids[j])
                out += [(q, v, d) for d, v in found[: k + 1]]
        return pd.DataFrame(out, columns=["q", "id", "score"])

    keys = ("part", "ib", "qb")
    hits = a.select(*keys, "v", "ids").groupBy(*keys).cogroup(b.select(*keys, "q", "v").groupBy(*keys)).applyInPandas(scan, "q long, id long, score double")
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score", "id"))).where(F.col("r") <= k + 1)
    best = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "id"))).alias("found"))
    who = rows.where(is_query).select("id", "v").distinct().join(asked.select("v", "q").distinct(), "v").select(F.col("id").alias("query_id"), "q")
    per = who.join(best, "q").select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return per.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.id").alias(id_col), F.col("x.score").alias("score"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)


QUERIES = {"op4_neighbours": op4_neighbours}
SQL: dict[str, str] = {}
