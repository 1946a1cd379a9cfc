"""Operator 3: document quality by hierarchical empirical Bayes over sites.

A logistic classifier on surface features gives each document its own evidence. A document's site is a host and, where
there is one, the first part of a path below it, read from its source. Sites gather the evidence of their documents by
grouped aggregation: a host's posterior shrinks towards the global mean, a path's towards its host's, with prior weights
that the spread between sites decides (method of moments), so that a site of a few documents says little. The final
probability adds the site's log odds against the global ones, its own document left out, to the document's.

The classifier learns from at most MAX_LABELLED labelled rows, chosen by a hash of the id; site statistics cover all rows.

Defined results: null and empty texts, and texts of blanks, have no evidence of quality, a score of 0 and no say in their site's; a null source is a host of its own; null labels
teach nothing, several labels of an id count as their smallest; without both labels every document with a word has the
share of label 1 (1 without labels); repeated rows count as often as they are there and give the same result; empty
tables give empty tables; input columns that clash with output names are replaced.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.components import join_facts
from corpusloom.session import materialize, ship, table

#: What a text that isn't blank holds.
WORDY = r"[^ \t-\r]"
MAX_LABELLED = 12_000
KEEP = 0.5
#: Up to so many sites are broadcast (some tens of bytes each), so that texts needn't be shuffled; beyond, those of hot sites are, and the others are joined by a shuffle.
BROADCAST_SITES = 200_000
#: How much of the site's log odds counts, and the bounds of the prior weights (in documents).
SITE_SHARE, LEAST_WEIGHT, MOST_WEIGHT = 0.5, 5.0, 1e6
UPPER = bytes(range(0x41, 0x5B))
DIGIT = bytes(range(0x30, 0x3A))
PLAIN = UPPER + bytes(range(0x61, 0x7B)) + DIGIT + b" \n\t\r.,;:'\"()-?" + bytes(range(0x80, 0x100))


def features(text: str | None) -> list[float]:
    """Shares in 0..1 of a whole text: odd symbols, bars, exclamation, capitals, digits, repeats, short words and lines."""
    data = (text or "").encode()
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * 13
    odd = len(data.translate(None, PLAIN))
    letters = size - len(data.translate(None, UPPER + bytes(range(0x61, 0x7B))))
    runs = sum(map(operator.eq, words, words[1:]))
    lines = [x for x in data.split(b"\n") if x.strip()]
    bare = sum(1 for w in words if not w.translate(None, PLAIN) == b"")
    alone = words.count(b"|")
    upper = sum(map(bytes.isupper, words))
    mean = sum(map(len, words)) / n
    return [
        odd / size, bare / n, alone / n, data.count(b"!") / n, (size - len(data.translate(None, UPPER))) / max(1, letters),
        upper / n, (size - len(data.translate(None, DIGIT))) / size, runs / n, len(set(words)) / n,
        1.0 - len(set(lines)) / max(1, len(lines)), min(1.0, mean / 20), min(1.0, n / 200), min(1.0, len(lines) / n),
    ]


def _vectors(df: DataFrame, text_col: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            # Square roots spread small shares.
            yield pd.Series([[x**0.5 for x in features(t)] for t in part], dtype=object)

    return df.withColumn("__x", array_to_vector(vector(F.col(text_col))))


class DocumentClassifier:
    """Logistic regression on surface features; without both labels a constant."""

    def __init__(self, model, share: float):
        self.model, self.share = model, share

    def evidence(self, df: DataFrame, text_col: str) -> DataFrame:
        """``df`` with __p, the document's own probability."""
        empty = ~F.coalesce(F.col(text_col).rlike(WORDY), F.lit(False))
        if self.model is None:
            return df.withColumn("__p", F.when(empty, 0.0).otherwise(F.lit(float(self.share))))
        found = self.model.transform(_vectors(df, text_col)).withColumn("__q", vector_to_array("__prob")[1])
        return found.withColumn("__p", F.when(empty, 0.0).otherwise(F.least(F.lit(0.9999), F.greatest(F.lit(0.0001), "__q")))).drop("__x", "__prob", "__raw", "__pred", "__q")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DocumentClassifier:
    ship(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("y"))
    total = marks.count()
    few = marks.where(F.pmod(F.xxhash64(F.lit("quality"), "__id"), F.lit(1_000_000)) < 1_000_000 * MAX_LABELLED / max(total, 1)).orderBy(F.xxhash64("__id")).limit(2 * MAX_LABELLED)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t")).join(F.broadcast(few), "__id").select("t", F.col("y").cast("double").alias("y"))
    x = materialize(_vectors(rows, "t").select("y", vector_to_array("__x").alias("x")), "vectors").select("y", array_to_vector("x").alias("__x"))
    counts = {r.y: r["count"] for r in x.groupBy("y").count().collect()}
    n = sum(counts.values())
    if not (counts.get(0.0) and counts.get(1.0)):
        return DocumentClassifier(None, counts.get(1.0, 0) / n if n else 1.0)
    fit = LogisticRegression(featuresCol="__x", labelCol="y", predictionCol="__pred", probabilityCol="__prob", rawPredictionCol="__raw", regParam=1e-4, maxIter=60).fit(x)
    return DocumentClassifier(fit, counts[1.0] / n)


def site_of(source: Column) -> tuple[Column, Column]:
    """(host, first path part or null) of a source or address."""
    bare = F.regexp_replace(F.lower(F.trim(source)), r"^[a-z][a-z0-9+.-]*://", "")
    path = F.regexp_extract(bare, r"^[^/?#]*/([^/?#]+)", 1)
    return F.regexp_extract(bare, r"^[^/?#]*", 0), F.when(path != "", path)


def _site_key(host: str, path: str) -> Column:
    """Host and path as one text; null and empty differ, and no host holds a stroke."""
    return F.concat(*[F.coalesce(F.concat(F.lit(mark), F.col(c)), F.lit("n")) for mark, c in (("h", host), ("/p", path))])


def _weight(groups: DataFrame, n: str, total: str, mean: Column) -> float:
    """Prior weight, in documents, of a level: within-site variance over the variance between sites, by moments."""
    g = groups.where(F.col(n) > 0).withColumn("m", F.col(total) / F.col(n))
    r = g.agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(F.col(n) * F.col(n)).alias("n2"),
        F.sum(F.col(n) * F.pow(F.col("m") - mean, 2)).alias("between"), F.sum(F.col(total) - F.col(n) * F.col("m") * F.col("m")).alias("within"),
    ).first()
    if not r.k or r.k < 2 or r.n <= r.k:
        return MOST_WEIGHT
    within = max(r.within, 0.0) / r.n
    spread = (r.between - (r.k - 1) * within) / max(r.n - r.n2 / r.n, 1e-9)
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, within / spread)) if spread > 0 else MOST_WEIGHT


def _log_odds(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def score_quality(docs: DataFrame, classifier: DocumentClassifier, source_col: str = "source", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with doc_score (the document alone), site_score (its site's posterior without it), score and keep (score >= KEEP).

    Rows are written once with doc_score, so that texts are looked at once; with_text: whether the text goes along.
    """
    ship(docs.sparkSession)
    own = ("doc_score", "site_score", "score", "keep")
    host, path = site_of(F.col(source_col))
    columns = [c for c in docs.columns if c not in own and c != text_col]
    scored = classifier.evidence(docs.select(F.struct(F.lit(0).alias("__"), *columns).alias("__doc"), F.col(text_col).alias("__text"), host.alias("__host"), path.alias("__path")), "__text")
    scored = scored.withColumn("__own", F.coalesce(F.col("__text").rlike(WORDY), F.lit(False)).cast("int"))
    scored = materialize(scored if with_text else scored.drop("__text"), "scored")
    # Blank texts are no evidence of a site.
    told = F.sum(F.when(F.col("__own") == 1, F.col("__p")).otherwise(0.0))
    paths = materialize(scored.groupBy("__host", "__path").agg(F.count("*").alias("rows"), F.sum("__own").alias("n"), told.alias("s")), "sites")
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    all_ = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    mean = all_[1] / all_[0] if all_[0] else 0.5
    by_host = _weight(hosts, "hn", "hs", F.lit(mean))
    below = paths.where("__path is not null").join(hosts.withColumnRenamed("__host", "__h"), F.col("__host").eqNullSafe(F.col("__h"))).select("n", "s", F.try_divide("hs", "hn").alias("hm"))
    by_path = _weight(below, "n", "s", F.col("hm"))
    sites = paths.join(hosts.withColumnRenamed("__host", "__h"), F.col("__host").eqNullSafe(F.col("__h"))).select(_site_key("__host", "__path").alias("__site_key"), "rows", "n", "s", "hn", "hs")
    sites = materialize(sites, "sites")
    keyed = scored.withColumn("__site_key", _site_key("__host", "__path"))
    few = sites.count() <= BROADCAST_SITES
    found = keyed.join(F.broadcast(sites), "__site_key") if few else join_facts(keyed, sites, "__site_key", "rows", "inner")
    one, p = F.col("__own"), F.col("__p") * F.col("__own")
    host_score = (F.col("hs") - p + by_host * mean) / (F.col("hn") - one + by_host)
    path_score = (F.col("s") - p + by_path * host_score) / (F.col("n") - one + by_path)
    found = found.withColumn("__site", F.when(F.col("__path").isNull(), host_score).otherwise(path_score))
    odds = _log_odds(F.col("__p")) + SITE_SHARE * (_log_odds(F.col("__site")) - _log_odds(F.lit(mean)))
    found = found.withColumn("__score", F.when(F.col("__p") == 0, 0.0).otherwise(1 / (1 + F.exp(-odds))))
    return found.select(
        *[F.col("__text").alias(c) if c == text_col else F.col("__doc")[c].alias(c) for c in docs.columns if c in columns or c == text_col and with_text],
        F.col("__p").alias("doc_score"),
        F.col("__site").alias("site_score"),
        F.col("__score").alias("score"),
        (F.col("__score") >= KEEP).alias("keep"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs.select("doc_id", "source", "text"), model, with_text=False).select("doc_id", "doc_score", "site_score", "score", "keep")


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
