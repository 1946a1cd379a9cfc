"""Operator 5: toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a learned lexicon and of a short fixed one, second-person words and their closeness
to lexicon words, capitals, punctuation, and obfuscated words. The lexicon holds words and word beginnings that are far
more frequent in toxic than in other labelled texts; near copies of a text count once in it.

The model learns from at most MAX_LABELLED labelled rows, chosen by a hash of the id: FIT of them fit the trees and the
lexicon, the others calibrate. Everything else covers all rows.

Defined results: null and empty texts score like a text without any word; null labels teach nothing, several labels of an
id count as its largest; without both labels every score is the share of label 1 (0 without labels); repeated rows give
repeated scores; an empty table gives an empty table; input columns that clash with output names are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, ship, table

from .language import fold_of
from .merge_queue import Kept
from .near_dedup import shingle_set

MAX_LABELLED = 12_000
FIT = 0.75
TREES, DEPTH = 12, 4
MIN_SUPPORT, MIN_ODDS, MIN_EVIDENCE, MAX_GRAMS, CANDIDATES = 4, 2.5, 16.0, 800, 50_000
PREFIXES = (4, 5, 6)
NEAR = 6
WORD = re.compile(r"[^\W\d_]+(?:[*@$#!013457]+[^\W\d_]+)*")
PLAIN = re.compile(r"[*@$#!013457]")
#: Fixed word lists.
INSULTS = frozenset("idiot stupid moron loser trash scum pathetic worthless disgusting clown dumb fool idiota estupido imbecil basura idiotin dumm dummkopf abschaum trottel imbecile stupide ordure debile".split())
SECOND = frozenset("you your yours yourself u du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!*#", "oieastasiaa")
NAMES = ("lexicon", "lexicon_log", "lexicon_kinds", "insults", "second", "near_second", "capitals", "exclaims", "questions", "punctuation", "obfuscated", "obfuscated_hits", "length", "window", "weight")


class Features:
    """The feature vector of a text under one lexicon (gram -> log odds; a gram ending in * is a beginning)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.kept = Kept(100_000)

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "kept": Kept(100_000)}

    def weigh(self, words: list[str]) -> dict[str, tuple[float, int, int, int]]:
        """word -> (lexicon weight, insult, second person, obfuscated)."""
        lex, out = self.lexicon, {}
        for w in words:
            low = w.lower()
            odd = 1 if PLAIN.search(low) else 0
            if odd:
                low = low.translate(LEET)
            weight = max(lex.get(low, 0.0), *(lex.get(low[:k] + "*", 0.0) for k in PREFIXES))
            out[w] = (weight, int(low in INSULTS), int(low in SECOND), odd)
        return out

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        words = WORD.findall(text)
        if not words:
            return [0.0] * len(NAMES)
        known = self.kept.fill(words, self.weigh)
        facts = list(map(known.__getitem__, words))
        hits = [i for i, f in enumerate(facts) if f[0] or f[1]]
        second = [i for i, f in enumerate(facts) if f[2]]
        n, near, j, most = len(words), 0, 0, 0
        for i in hits:
            while j < len(second) and second[j] < i - NEAR:
                j += 1
            near += j < len(second) and second[j] <= i + NEAR
        first = 0
        for k, i in enumerate(hits):
            while hits[first] < i - 50:
                first += 1
            most = max(most, k - first + 1)
        size = len(text)
        letters = sum(map(len, words))
        capitals = sum(1 for w in words if len(w) > 1 and w.isupper())
        marks = size - letters - text.count(" ") - text.count("\n")
        lexical = [i for i in hits if facts[i][0]]
        return [
            len(lexical) / n, math.log1p(len(lexical)), float(min(50, len({words[i].lower() for i in lexical}))), sum(f[1] for f in facts) / n,
            len(second) / n, near / len(hits) if hits else 0.0, capitals / n, text.count("!") / size, text.count("?") / size, marks / size,
            sum(f[3] for f in facts) / n, float(sum(1 for i in hits if facts[i][3])), math.log1p(n), float(most), sum(facts[i][0] for i in lexical) / n,
        ]


def _grams(text: str) -> set[str]:
    low = {w.lower() for w in WORD.findall(text)}
    return low | {w[:k] + "*" for w in low for k in PREFIXES if len(w) > k}


def learn_lexicon(rows: DataFrame, text_col: str, label_col: str) -> dict[str, float]:
    """gram -> log odds, from labelled rows: grams of enough toxic texts are candidates, their counts elsewhere decide."""

    @F.pandas_udf("long")
    def kind(texts: pd.Series) -> pd.Series:
        return pd.Series([int(s.min() >> 1) if len(s := shingle_set(t)) else -1 for t in texts], dtype="int64")

    once = materialize(rows.withColumn("__kind", kind(text_col)).groupBy(label_col, "__kind").agg(F.min(text_col).alias("t")), "lexicon")
    totals = {r[0]: r[1] for r in once.groupBy(label_col).count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return {}

    def count(wanted: frozenset | None):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            c: Counter = Counter()
            for part in parts:
                for t in part["t"]:
                    g = _grams(t or "")
                    c.update(g if wanted is None else g & wanted)
                    if len(c) > 300_000:
                        yield pd.DataFrame(list(c.items()), columns=["g", "n"])
                        c.clear()
            if c:
                yield pd.DataFrame(list(c.items()), columns=["g", "n"])

        return run

    schema = "g string, n long"
    found = once.where(F.col(label_col) == 1).select("t").mapInPandas(count(None), schema).groupBy("g").agg(F.sum("n").alias("n"))
    found = {r.g: r.n for r in found.where(F.col("n") >= MIN_SUPPORT).orderBy(F.desc("n"), "g").limit(CANDIDATES).collect()}
    rest = once.where(F.col(label_col) == 0).select("t").mapInPandas(count(frozenset(found)), schema).groupBy("g").agg(F.sum("n").alias("n"))
    rest = {r.g: r.n for r in rest.collect()}
    odds = {g: math.log((n + 0.5) / (toxic - n + 0.5)) - math.log((rest.get(g, 0) + 0.5) / (other - rest.get(g, 0) + 0.5)) for g, n in found.items()}
    rate = toxic / (toxic + other)

    def evidence(g: str) -> float:
        """Twice the log likelihood ratio of the gram's own rate of toxic texts to the general one."""
        n, m = found[g], rest.get(g, 0)
        return 2 * (n * math.log(n / (n + m) / rate) + (m * math.log(m / (n + m) / (1 - rate)) if m else 0.0))

    strong = {g: v for g, v in odds.items() if v >= MIN_ODDS and evidence(g) >= MIN_EVIDENCE}
    # A word or beginning says nothing beside a shorter beginning that is in the lexicon too.
    plain = [g for g in strong if not any(g != g[:k] + "*" and g[:k] + "*" in strong for k in PREFIXES)]
    best = sorted(plain, key=lambda g: (-evidence(g), g))[:MAX_GRAMS]
    return {g: strong[g] for g in best}


def _vectors(df: DataFrame, text_col: str, lexicon: dict[str, float]) -> DataFrame:
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Features(lexicon))

    @F.pandas_udf("array<double>")
    def vector(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = shared.value
        for part in parts:
            yield pd.Series([f.of(t) for t in part], dtype=object)

    return df.withColumn("__x", array_to_vector(vector(F.col(text_col))))


class ToxicityModel:
    """A lexicon, trees and a calibration; without trees a constant."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with score (0 to 1) and predicted (1 from 0.5 on)."""
        own = ("score", "predicted")
        packed = df.select(F.struct(F.lit(0).alias("__"), *[c for c in df.columns if c not in own]).alias("__doc"), F.col(text_col).alias("__text"))
        if self.trees is None:
            out = packed.withColumn("__score", F.lit(float(self.share)))
        else:
            found = self.trees.transform(_vectors(packed, "__text", self.lexicon)).withColumn("__raw", vector_to_array("__p")[1])
            found = self.calibration.transform(found) if self.calibration is not None else found.withColumn("__c", F.col("__raw"))
            # The calibrated value is a step function; a thousandth of the trees' own keeps their order within a step.
            out = found.withColumn("__score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__c") * 0.999 + F.col("__raw") * 0.001)))
        return out.select(*[F.col("__doc")[c].alias(c) for c in df.columns if c not in own], F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the rows of ``docs`` that ``labels`` (id, label) marks, at most MAX_LABELLED of them."""
    ship(docs.sparkSession)
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("y"))
    total = marks.count()
    part = F.pmod(F.xxhash64(F.lit("part"), "__id"), F.lit(1_000_000)) / 1_000_000
    few = marks.where(part < MAX_LABELLED / max(total, 1)).orderBy(F.xxhash64("__id")).limit(2 * MAX_LABELLED)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(few), "__id")
    rows = materialize(rows.select("__id", "t", F.col("y").cast("double").alias("y"), (F.pmod(F.xxhash64(F.lit("fit"), "__id"), F.lit(1000)) < 1000 * FIT).alias("fit")), "labelled")
    counts = {(r.fit, r.y): r["count"] for r in rows.groupBy("fit", "y").count().collect()}
    n = sum(counts.values())
    share = sum(v for (_, y), v in counts.items() if y == 1) / n if n else 0.0
    if not all(counts.get((True, y)) for y in (0.0, 1.0)):
        return ToxicityModel({}, None, None, share)
    lexicon = learn_lexicon(rows.where("fit"), "t", "y")
    x = materialize(_vectors(rows, "t", lexicon).select("y", "fit", vector_to_array("__x").alias("x")), "vectors").select("y", "fit", array_to_vector("x").alias("__x")).coalesce(6)
    trees = GBTClassifier(featuresCol="__x", labelCol="y", predictionCol="__pred", maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.3, seed=1, minInstancesPerNode=5)
    trees = trees.setRawPredictionCol("__rawp").setProbabilityCol("__p").fit(x.where("fit"))
    held = trees.transform(x.where("not fit")).select("y", vector_to_array("__p")[1].alias("__raw"))
    calibration = None
    if all(counts.get((False, y)) for y in (0.0, 1.0)):
        calibration = IsotonicRegression(featuresCol="__raw", labelCol="y", predictionCol="__c").fit(held)
    return ToxicityModel(lexicon, trees, calibration, share)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold_of("doc_id", 5) != 0)
    scored = learn(docs, labels).score(docs)
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op5_toxicity": op5_toxicity}
SQL: dict[str, str] = {}
