"""Retrieval queries: benchmark items ask, documents answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import shingles, tokens
from corpusloom.operators import retrieval as R
from corpusloom.session import materialize, table

TOP = 10


def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    hits = R.bm25_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), TOP)
    return hits.select("query", "doc", F.round("score", 6).alias("score"), "rank")


_BM25 = """
WITH w AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT doc, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY doc, term),
s AS (SELECT count(*) AS n, avg(coalesce(len(w), 0)) AS avgdl FROM w),
t AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw, any_value(avgdl) AS avgdl FROM p, s GROUP BY term, n),
i AS (SELECT term, avgdl, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM t) ELSE raw END AS idf FROM t),
q AS (SELECT query, term, count(*) AS qtf FROM (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY query, term),
h AS (SELECT query, doc, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM q JOIN i USING (term) JOIN p USING (term) GROUP BY query, doc),
r AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h)
"""


def bm25_excluding_seen(spark: SparkSession, sf: str) -> DataFrame:
    """The next best after each query's first three are taken as seen."""
    hits = materialize(R.bm25_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), TOP + 3), "hits")
    return R.exclude_seen(hits, hits.where("rank <= 3"), TOP).select("query", "doc", F.round("score", 6).alias("score"), "rank")


def dense_search(spark: SparkSession, sf: str) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 20."""
    v = table(spark, sf, "embeddings")
    return R.dense_topk(v, v.where("vec_id % 20 = 0"), TOP)


_DENSE = """
WITH h AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h)
"""


def dense_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A row of the same label is relevant."""
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0")
    return R.label_metrics(R.dense_topk(v, asked, TOP), asked.select(F.col("vec_id").alias("query"), "label"), v.select(F.col("vec_id").alias("doc"), "label"), TOP)


def bm25_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Relevant: documents that hold one of a query's eight-word shingles."""
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    grams = lambda df, i: df.select(F.col(i), tokens(F.col("text")).alias("w")).select(i, F.explode(shingles(F.col("w"), 8)).alias("gram"))
    wanted = grams(items, "item_id").withColumnRenamed("item_id", "query")
    relevant = grams(docs, "doc_id").withColumnRenamed("doc_id", "doc").join(wanted, "gram").select("query", "doc").distinct()
    return R.retrieval_metrics(R.bm25_topk(docs, items, TOP), relevant, TOP)


_METRICS = """
f AS (SELECT rel.query, count(rank) AS found, count(*) AS wanted, min(rank) AS first FROM rel LEFT JOIN (SELECT * FROM r WHERE rank <= 10) x ON rel.query = x.query AND rel.doc = x.doc GROUP BY rel.query)
SELECT count(*) AS queries, round(avg((found > 0)::INT), 9) AS hit_at_k, round(avg(found / wanted), 9) AS recall_at_k, round(avg(coalesce(1.0 / first, 0)), 9) AS mrr FROM f
"""
_GRAMS = "SELECT DISTINCT {0}, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))) AS gram FROM (SELECT {0}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {1}) WHERE len(w) >= 8"


def latency_p95(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and nearest-rank 95th percentile of values by event type."""
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"), F.max("value").alias("most")
    )


def fallback_purity(spark: SparkSession, sf: str) -> DataFrame:
    """A user with one fallback row (an error event) has no dense metric at all; others have their mean."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("fallbacks"),
        F.when(F.count_if(F.col("event_type") == "error") == 0, F.round(F.avg("value"), 6)).alias("metric"),
    )


def page_rank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Three best documents for each item by distinct shared words, then by id."""
    words = lambda df, i, o: df.select(F.col(i).alias(o), F.explode(F.array_distinct(tokens(F.col("text")))).alias("w"))
    asked = materialize(words(table(spark, sf, "benchmark"), "item_id", "query"), "asked")
    by_word = asked.groupBy("w").agg(F.count("*").alias("n"))
    shared = materialize(R.few(by_word, 500_000).join(words(table(spark, sf, "documents"), "doc_id", "doc"), "w").select("doc", "w", "n"), "shared")
    scores = shared.agg(F.sum("n")).first()[0] or 0
    hits = R.few(asked, 500_000).join(R.by_document(shared.select("doc", "w"), scores), "w").groupBy("query", "doc").agg(F.count("*").alias("score"))
    return R.topk(hits, 3)


def relevance_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Turns that share at least a quarter of the distinct words of four letters or more of the turn before."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.filter(F.array_distinct(tokens(F.col("text"))), lambda w: F.length(w) >= 4).alias("w"))
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("asked"))
    shared = F.size(F.array_intersect("asked", "w"))
    return c.join(before, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.size("asked").alias("asked"), shared.alias("shared"), (F.when(F.size("asked") > 0, shared * 4 >= F.size("asked")).otherwise(False)).alias("relevant")
    )


QUERIES = {f.__name__: f for f in (bm25_search, bm25_excluding_seen, dense_search, dense_metrics, bm25_metrics, latency_p95, fallback_purity, page_rank_lexical, relevance_overlap)}
SQL = {
    "bm25_search": _BM25 + "SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10",
    "bm25_excluding_seen": _BM25 + "SELECT query, doc, round(score, 6) AS score, rank - 3 AS rank FROM r WHERE rank BETWEEN 4 AND 13",
    "dense_search": _DENSE + "SELECT * FROM r WHERE rank <= 10",
    "dense_metrics": _DENSE + ", rel AS (SELECT q.vec_id AS query, d.vec_id AS doc FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)," + _METRICS,
    "bm25_metrics": _BM25 + f", rel AS (SELECT DISTINCT item_id AS query, doc_id AS doc FROM ({_GRAMS.format('item_id', 'benchmark')}) JOIN ({_GRAMS.format('doc_id', 'documents')}) USING (gram))," + _METRICS,
    "latency_p95": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type",
    "fallback_purity": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS fallbacks, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN round(avg(value), 6) END AS metric FROM events GROUP BY user_id",
    "page_rank_lexical": """WITH q AS (SELECT item_id AS query, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM benchmark),
d AS (SELECT doc_id AS doc, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS w FROM documents),
h AS (SELECT query, doc, count(*) AS score FROM q JOIN d USING (w) GROUP BY query, doc)
SELECT * FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM h) WHERE rank <= 3""",
    "relevance_overlap": """WITH c AS (SELECT conv_id, turn, list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda x: length(x) >= 4) AS w FROM conversations)
SELECT c.conv_id, c.turn, len(b.w) AS asked, len(list_intersect(b.w, c.w)) AS shared, len(b.w) > 0 AND len(list_intersect(b.w, c.w)) * 4 >= len(b.w) AS relevant
FROM c JOIN c b ON b.conv_id = c.conv_id AND b.turn + 1 = c.turn""",
}
