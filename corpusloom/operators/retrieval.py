"""Lexical and dense retrieval over tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import tokens
from corpusloom.session import materialize, ship

#: Okapi parameters, fixed values: term saturation, length normalisation, floor of negative idf as a share of the mean.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Query terms up to so many are broadcast (some tens of bytes each).
FEW_TERMS = 200_000
#: Numbers in a block of rows and of queries: 8 MB and 4 MB.
ROW_NUMBERS, QUERY_NUMBERS = 1 << 20, 1 << 19
#: Scores of a block that are held at once: 8 MB.
HELD_SCORES = 1 << 20
#: Scores of a query and document that a task adds up, at most about so many.
TASK_SCORES = 2_000_000


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, term, tf), written once: the one pass over texts that a search makes.

    A document's tokens are in one task, so its terms are counted there, and the shuffle has a row for each posting.
    """
    words = docs.select(F.col(id_col).alias("doc"), F.explode(tokens(F.col(text_col))).alias("term"))
    return materialize(words.groupBy("doc", "term").agg(F.count("*").alias("tf")), "postings")


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, as it is otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def by_document(hits: DataFrame, scores: int) -> DataFrame:
    """``hits`` (doc, ...) by document in so many parts that each gives about TASK_SCORES of its ``scores``; what follows by document stays there."""
    parts = max(int(hits.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-scores // TASK_SCORES))
    return hits.repartition(parts, "doc")


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query, doc, score, rank): Okapi scores of documents that share a term with a query; ties keep document order.

    A negative idf becomes EPSILON times the mean idf over all terms. Repeated query terms count repeatedly. Scores are
    rounded to nine decimals before ranking. Terms and lengths come from the written postings; only postings of query terms
    meet the queries, without a shuffle as long as these have at most FEW_TERMS terms.
    """
    return bm25_from_postings(postings(docs, doc_id, text_col), docs.count(), queries, k, query_id, text_col)


def bm25_from_postings(index: DataFrame, n: int, queries: DataFrame, k: int, query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """``bm25_topk`` on written (doc, term, tf) of ``n`` documents."""
    terms = index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tokens"))
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = materialize(terms.select("term", "df", "tokens", raw.alias("raw")), "terms")
    all_ = terms.agg(F.avg("raw"), F.sum("tokens")).first()
    mean, avgdl = all_[0] or 0.0, (all_[1] or 0) / max(n, 1)
    asked = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    idf = terms.select("term", F.when(F.col("raw") < 0, F.lit(mean) * EPSILON).otherwise(F.col("raw")).alias("idf"))
    asked = materialize(asked.join(idf, "term"), "asked")
    met = few(asked.select("term").distinct(), FEW_TERMS)
    # Lengths of all documents, from the same postings, meet the hits.
    lengths = index.groupBy("doc").agg(F.sum("tf").alias("dl"))
    scores = asked.join(few(terms.select("term", "df"), FEW_TERMS), "term").agg(F.sum("df")).first()[0] or 0
    hits = by_document(index.join(met, "term"), scores).join(lengths, "doc")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    scored = hits.join(few(asked, FEW_TERMS), "term").groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("score"))
    return topk(scored, k, "query", "doc")


def topk(hits: DataFrame, k: int, query: str = "query", doc: str = "doc") -> DataFrame:
    """The k best of each query by score, ties to the smaller id; Spark limits groups before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exclude_seen(hits: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Hits without pairs in ``seen`` (query, doc), ranked anew."""
    return topk(hits.drop("rank").join(seen.select("query", "doc"), ["query", "doc"], "left_anti"), k)


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", digits: int = 6) -> DataFrame:
    """(query, doc, score, rank): exact inner products in double precision of all rows but the query's own.

    Queries and rows meet in blocks, each a product of two matrices, of which the k best of each query leave it: a row moves
    once for each block of QUERY_NUMBERS numbers of queries, a query once for each block of ROW_NUMBERS numbers of rows.
    """
    ship(vectors.sparkSession)
    q = queries.select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("v")).where("query is not null and v is not null")
    d = vectors.select(F.col(id_col).alias("doc"), F.col(vector_col).cast("array<double>").alias("v")).where("doc is not null and v is not null")
    n, m, dims = d.count(), q.count(), d.agg(F.max(F.size("v"))).first()[0] or 1
    rows, asks = (max(1, -(-have * dims // most)) for have, most in ((n, ROW_NUMBERS), (m, QUERY_NUMBERS)))
    a = d.withColumn("rb", F.pmod(F.xxhash64("doc"), F.lit(rows))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(asks - 1))))
    b = q.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(asks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def best(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(held) and len(asked):
            held = held.sort_values("doc", kind="stable")
            ids, x = held["doc"].to_numpy(), np.stack(held["v"].to_numpy())
            step = max(1, HELD_SCORES // len(ids))
            for first in range(0, len(asked), step):
                part = asked.iloc[first : first + step]
                score = np.stack(part["v"].to_numpy()) @ x.T
                np.round(score, digits, out=score)
                score[part["query"].to_numpy()[:, None] == ids[None, :]] = -np.inf
                for i, query in enumerate(part["query"].to_numpy()):
                    least = np.partition(score[i], -min(k, len(ids)))[-min(k, len(ids))]
                    near = np.flatnonzero(score[i] >= least)
                    near = near[np.argsort(-score[i][near], kind="stable")[:k]]
                    out += [(query, ids[j], score[i][j]) for j in near if np.isfinite(score[i][j])]
        return pd.DataFrame(out, columns=["query", "doc", "score"])

    by = ("rb", "qb")
    hits = a.withColumn("rb", F.col("rb").cast("int")).groupBy(*by).cogroup(b.withColumn("rb", F.col("rb").cast("int")).groupBy(*by)).applyInPandas(best, "query long, doc long, score double")
    return topk(hits, k)


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: hit@k, recall@k and mean reciprocal rank over the queries of ``relevant`` (query, doc)."""
    found = relevant.join(hits.where(F.col("rank") <= k).select("query", "doc", "rank"), ["query", "doc"], "left")
    return _mean_metrics(found.groupBy("query").agg(F.count("rank").alias("found"), F.count("*").alias("wanted"), F.min("rank").alias("first")))


def label_metrics(hits: DataFrame, queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """``retrieval_metrics`` where a document of the query's label, but itself, is relevant: queries (query, label), docs (doc, label).

    Relevant documents are counted by label, and only hits are looked up, so that pairs of a label are never made.
    """
    sizes = docs.groupBy("label").agg((F.count("*") - 1).alias("wanted"))
    asked = queries.join(sizes, "label").where("wanted > 0")
    right = hits.where(F.col("rank") <= k).join(docs.withColumnRenamed("label", "doc_label"), "doc").join(queries, "query").where("doc_label = label and query <> doc")
    per = asked.join(right.groupBy("query").agg(F.count("*").alias("found"), F.min("rank").alias("first")), "query", "left")
    return _mean_metrics(per.withColumn("found", F.coalesce("found", F.lit(0))))


def _mean_metrics(per: DataFrame) -> DataFrame:
    """One row over (query, found, wanted, first)."""
    return per.agg(
        F.count("*").alias("queries"),
        F.round(F.avg((F.col("found") > 0).cast("double")), 9).alias("hit_at_k"),
        F.round(F.avg(F.col("found") / F.col("wanted")), 9).alias("recall_at_k"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 9).alias("mrr"),
    )
