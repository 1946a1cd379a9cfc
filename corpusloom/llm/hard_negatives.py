"""Operator 13: hard negatives by exact integer inner products, with bounds from an orthogonal PCA rotation.

Components become floor(scale * x). A rotation to the principal directions of these integer vectors (their second moments,
over all rows) gathers most of an inner product in a few leading components. A block of rows meets a block of anchors:
partial products over the leading components, plus or minus the product of the norms of what is left and a slack for
rounding, bound every score; whatever can't be among the wanted ones goes before more components are added. What survives
the last stage is verified by the integer product itself, so results are exact whatever the rotation is.

Two passes over the same blocks. The first finds each anchor's nearest rows of the same label: a row goes if its upper bound
lies under the k-th largest lower bound. The second has the positives' scores, and finds for each the best rows of other
labels in [low, high] percent of it: a row goes if it lies outside of all of an anchor's ranges, or under the k-th largest
lower bound of each range it may be in. A block gives at most k rows for each anchor and range; the best of all blocks are
taken by (score, smaller id), which settles ties exactly.

Rows are dealt into blocks of bounded bytes by a hash of the id, anchors too; a row moves once for each block of anchors,
which are a stated query set. No label or vector is a key of a shuffle, so none is hot.

Defined results: rows with a null id, label or vector, a null or non-finite component, or another dimension than most take no
part; zero vectors do. Rows that repeat id, label and vector count once. Scores beyond a long's range count as its nearest
bound. A positive with a negative score has an empty range. Anchors without a positive, and positives without a negative in
range, give no row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import materialize, ship, table

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Numbers in a block of rows and of anchors (8 MB and 2 MB), pairs that are bounded at a time, and verified at a time.
ROW_NUMBERS, ANCHOR_NUMBERS, PAIRS, VERIFIED = 1 << 20, 1 << 18, 1 << 20, 1 << 14
#: Shares of the components that are added before each test of the bounds.
STAGES = (0.125, 0.25, 0.5)
#: Products of norms up to here are exact in 64-bit integers; the share of it that rounding of rotated products stays far below.
EXACT, SLACK = 2.0**62, 2.0**-30
LONG = 2**63 - 1


def quantised(v: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) for each component, as a double, which holds it exactly."""
    most = F.lit(1.7976931348623157e308)
    return F.transform(v, lambda x: (lambda y: F.when(y < 2.0**53, F.when(y > -(2.0**53), F.floor(y).cast("double")).otherwise(F.greatest(y, -most))).otherwise(F.least(y, most)))(x.cast("double") * scale))


def second_moments(rows: DataFrame, dims: int) -> np.ndarray:
    """The sum of v v' over ``rows`` (v), each vector by its norm; partial sums in partitions, and a few of these at the end."""

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for p in parts:
            if len(p):
                x = np.stack(p["v"].to_numpy())
                x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
                total += x.T @ x
        yield pd.DataFrame({"m": [total.tobytes()]})

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(dims * dims)
        for p in parts:
            for m in p["m"]:
                total += np.frombuffer(m)
        yield pd.DataFrame({"m": [total.tobytes()]})

    few = rows.select("v").mapInPandas(add, "m binary").repartition(8).mapInPandas(merge, "m binary")
    return sum((np.frombuffer(r.m).reshape(dims, dims) for r in few.collect()), np.zeros((dims, dims)))


def rotation_of(moments: np.ndarray) -> np.ndarray:
    """Orthogonal columns, by falling share of the second moments."""
    _, v = np.linalg.eigh(moments)
    return np.ascontiguousarray(v[:, ::-1])


class Block:
    """Vectors with their rotation and the norms of what is left after each stage."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, rotation: np.ndarray):
        self.ids, self.labels, self.v = ids, labels, v
        self.big = float(np.abs(v).max(initial=0.0))
        # Huge vectors are bounded in units of their largest component, so that no bound overflows.
        self.unit = self.big if self.big > 2.0**30 else 1.0
        self.r = (v / self.unit) @ rotation
        d = v.shape[1]
        self.cuts = sorted({max(1, int(d * s)) for s in STAGES} | {d})
        tail = np.cumsum((self.r * self.r)[:, ::-1], axis=1)[:, ::-1]
        self.norm = np.sqrt(tail[:, 0]) if d else np.zeros(len(v))
        self.rest = [np.sqrt(tail[:, c]) if c < d else np.zeros(len(v)) for c in self.cuts]


def integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; exact, and held to the range of a long."""
    safe = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1]) < EXACT
    if safe and max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0)) < 2.0**53:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([min(LONG, max(-LONG, sum(int(x) * int(y) for x, y in zip(p, q)))) for p, q in zip(a.tolist(), b.tolist())], dtype=np.int64)


def survivors(a: Block, rows: slice, b: Block, allowed: np.ndarray, narrow) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of pairs that ``narrow(allowed, low, high)`` keeps at every stage, verified.

    low and high bound the scores of all pairs of the anchors ``rows`` and of ``b``; narrow returns which stay.
    """
    ar, unit = a.r[rows], min(a.unit * b.unit, 1e300)
    slack = SLACK * (a.norm[rows][:, None] * b.norm[None, :]) + 1e-9
    partial, at, keep = np.zeros(allowed.shape), 0, allowed
    for k, cut in enumerate(a.cuts):
        live = np.flatnonzero(keep.any(axis=0))
        if len(live) * 2 < keep.shape[1]:  # the columns that nobody wants any more stay out of the products
            partial[:, live] += ar[:, at:cut] @ b.r[live, at:cut].T
        else:
            partial += ar[:, at:cut] @ b.r[:, at:cut].T
        at = cut
        room = a.rest[k][rows][:, None] * b.rest[k][None, :] + slack
        with np.errstate(over="ignore"):
            keep = narrow(keep, *(np.clip(x * unit, -(2.0**63), 2.0**63) for x in (partial - room, partial + room)))
        if not keep.any():
            break
    i, j = np.nonzero(keep)
    av, score = a.v[rows], np.zeros(len(i), dtype=np.int64)
    for s in range(0, len(i), VERIFIED):
        score[s : s + VERIFIED] = integer_products(av[i[s : s + VERIFIED]], b.v[j[s : s + VERIFIED]])
    return i, j, score


def _kth(values: np.ndarray, mask: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of ``values`` where ``mask`` holds, in each line; -inf where there are fewer."""
    out = np.full(len(values), -np.inf)
    full = np.flatnonzero(mask.sum(axis=1) >= k)
    if len(full):
        out[full] = -np.partition(np.where(mask[full], -values[full], np.inf), k - 1, axis=1)[:, k - 1]
    return out


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each i, by falling score, then smaller id."""
    order = np.lexsort((ids, -score, i))
    ranked = i[order]
    start = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(ranked)) - np.repeat(start, np.diff(np.append(start, len(ranked))))
    return order[rank < k]


def best_positives(a: Block, b: Block, k: int) -> list[tuple]:
    """(anchor id, row id, score): in this block, the k best rows of each anchor's label."""
    out, step = [], max(1, PAIRS // max(1, len(b.ids)))

    def narrow(keep, low, high):
        return keep & (high >= _kth(low, keep, k)[:, None])

    for s in range(0, len(a.ids), step):
        rows = slice(s, s + step)
        allowed = (a.labels[rows][:, None] == b.labels[None, :]) & (a.ids[rows][:, None] != b.ids[None, :])
        i, j, score = survivors(a, rows, b, allowed, narrow)
        own = a.ids[rows]
        out += [(int(own[i[x]]), int(b.ids[j[x]]), int(score[x])) for x in _best(i, b.ids[j], score, k)]
    return out


def best_negatives(a: Block, b: Block, ranges: list[list[tuple[int, int, int]]], k: int) -> list[tuple]:
    """(anchor id, positive's score, row id, score): in this block, the k best rows of other labels in each range.

    ranges: for each anchor (least score, greatest score, positive's score).
    """
    out, step = [], max(1, PAIRS // max(1, len(b.ids)))
    for s in range(0, len(a.ids), step):
        rows = slice(s, s + step)
        mine = ranges[s : s + step]
        width = max((len(x) for x in mine), default=0)
        if not width:
            continue
        # Ranges as doubles, a little wider, for the bounds; exact integers for what is verified.
        least, most = np.full((len(mine), width), np.inf), np.full((len(mine), width), -np.inf)
        for n, x in enumerate(mine):
            for m, (lo, hi, _) in enumerate(x):
                least[n, m], most[n, m] = np.nextafter(float(lo), -np.inf), np.nextafter(float(hi), np.inf)

        def narrow(keep, low, high):
            wanted = np.zeros_like(keep)
            for m in range(width):
                lo, hi = least[:, m, None], most[:, m, None]
                may = keep & (high >= lo) & (low <= hi)
                sure = may & (low >= lo) & (high <= hi)
                wanted |= may & (high >= _kth(low, sure, k)[:, None])
            return wanted

        allowed = a.labels[rows][:, None] != b.labels[None, :]
        i, j, score = survivors(a, rows, b, allowed, narrow)
        own, ids = a.ids[rows], b.ids[j]
        for m in range(width):
            lo = np.array([x[m][0] if m < len(x) else LONG for x in mine], dtype=np.int64)
            hi = np.array([x[m][1] if m < len(x) else -LONG for x in mine], dtype=np.int64)
            inside = np.flatnonzero((score >= lo[i]) & (score <= hi[i]))
            out += [(int(own[i[x]]), mine[i[x]][m][2], int(ids[x]), int(score[x])) for x in inside[_best(i[inside], ids[inside], score[inside], k)]]
    return out


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank from 1, negative_id, positive_score, negative_score).

    For each row that ``is_anchor`` (on ``id``) marks: its best ``positives`` other rows of the same label, and for each of
    these the best ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = sizes.d if sizes else 0
    rows = materialize(rows.where(F.size("v") == dims).select("id", "label", quantised(v, scale).alias("v")).distinct(), "vectors")
    n, asked = rows.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    rotation = spark.sparkContext.broadcast(rotation_of(second_moments(rows, dims)) if dims else np.zeros((0, 0)))
    row_blocks, anchor_blocks = (max(1, -(-count * max(1, dims) // most)) for count, most in ((n, ROW_NUMBERS), (asked, ANCHOR_NUMBERS)))
    deal = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    b = rows.withColumn("rb", deal(row_blocks)).withColumn("ab", every(anchor_blocks)).groupBy("ab", "rb")
    anchors = rows.where(is_anchor).withColumn("ab", deal(anchor_blocks))

    def block(p: pd.DataFrame) -> Block:
        return Block(p["id"].to_numpy(), p["label"].to_numpy().astype(str), np.stack(p["v"].to_numpy()).astype(np.float64).reshape(len(p), dims), rotation.value)

    def scan(names: list[str], find):
        def run(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            found = find(p, block(q)) if len(p) and len(q) else []
            return pd.DataFrame(found, columns=names).astype("int64")

        return run

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "row_id")
    found = anchors.withColumn("rb", every(row_blocks)).groupBy("ab", "rb").cogroup(b)
    near = found.applyInPandas(scan(["anchor_id", "row_id", "score"], lambda p, q: best_positives(block(p), q, positives)), "anchor_id long, row_id long, score long")
    near = materialize(near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives).drop("r"), "positives")
    # Equal scores of an anchor's positives ask for the same range.
    scores = near.where("score >= 0").groupBy("anchor_id").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    asking = materialize(anchors.join(scores.withColumnRenamed("anchor_id", "id"), "id"), "asking").withColumn("rb", every(row_blocks))

    def negative(p: pd.DataFrame, q: Block) -> list[tuple]:
        ranges = [[(-(-low * int(s) // 100), high * int(s) // 100, int(s)) for s in x] for x in p["scores"]]
        return best_negatives(block(p), q, ranges, negatives)

    kept = asking.groupBy("ab", "rb").cogroup(b).applyInPandas(scan(["anchor_id", "score", "row_id", "n_score"], negative), "anchor_id long, score long, row_id long, n_score long")
    order = Window.partitionBy("anchor_id", "score").orderBy(F.desc("n_score"), "row_id")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).withColumnRenamed("row_id", "negative_id")
    return near.join(kept, ["anchor_id", "score"]).select(
        "anchor_id", F.col("row_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", F.col("score").alias("positive_score"), F.col("n_score").alias("negative_score")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


QUERIES = {"op13_hard_negatives": op13_hard_negatives}
SQL = {
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 5"""
}
