"""Corpus curation: splits, duplicates, leakage screens, gates and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import shingles, tokens


def hash_split(id_col: str) -> Column:
    """dev where the first eight hexadecimal digits of the id's SHA-256 are even, else test."""
    return F.when(F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 8), 16, 10).cast("long") % 2 == 0, "dev").otherwise("test")


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """(key's hash, first ``order`` value, copies): dedup that keeps the first; one shuffle of hashes, not of texts."""
    return df.select(F.md5(key).alias("key"), order).groupBy("key").agg(F.min(order).alias(order), F.count("*").alias("copies"))


def grams(df: DataFrame, id_col: str, n: int, text_col: str = "text") -> DataFrame:
    """(id, gram): the distinct n-word shingles of each row."""
    return df.select(id_col, tokens(F.col(text_col)).alias("w")).where(F.size("w") >= n).select(id_col, F.explode(shingles(F.col("w"), n)).alias("gram"))


def shingle_leakage(docs: DataFrame, targets: DataFrame, n: int, doc_id: str, target_id: str) -> DataFrame:
    """(doc, shared): documents that hold n-word shingles of ``targets``, with how many distinct ones."""
    wanted = grams(targets, target_id, n).select("gram").distinct()
    return grams(docs, doc_id, n).join(wanted, "gram", "left_semi").groupBy(doc_id).agg(F.count("*").alias("shared"))


def heads(sets: DataFrame, id_col: str) -> DataFrame:
    """(id, word, s) of the first words of each set ``w`` of s words, in an order that all sets share.

    Two sets with a similarity of 0.8 or more share one of their first s - ceil(0.8 s) + 1 words; long words come first, as
    they are rarer, so that common words rarely are in a head.
    """
    ordered = F.transform(F.array_sort(F.transform("w", lambda x: F.struct((-F.length(x)).alias("l"), F.xxhash64(x).alias("h"), x.alias("x")))), lambda y: y["x"])
    n = F.size("w")
    return sets.select(id_col, n.alias("s"), F.explode(F.slice(ordered, F.lit(1), (n - F.ceil(n * 8 / 10) + 1).cast("int"))).alias("word"))


def leakage_pairs(docs: DataFrame, targets: DataFrame, doc_id: str, target_id: str, n: int = 8, least: int = 6) -> DataFrame:
    """(target, doc, shared_grams, jaccard): pairs that share an n-word shingle, or whose word sets have a similarity of 0.8.

    Similar sets of ``least`` words or more have sizes within a factor of 0.8, and share a word of their heads (see ``heads``):
    only such pairs meet.
    """
    by_gram = grams(targets, target_id, n).join(grams(docs, doc_id, n), "gram").groupBy(target_id, doc_id).agg(F.count("*").alias("shared_grams"))
    sets = lambda df, i: df.select(i, F.array_distinct(tokens(F.col("text"))).alias("w")).where(F.size("w") >= least)
    t, d = sets(targets, target_id), sets(docs, doc_id)
    small = t.select(F.size("w").alias("s")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    d = d.join(F.broadcast(small), (F.size("w") * 10 >= F.col("lo") * 8) & (F.size("w") * 8 <= F.col("hi") * 10)).drop("lo", "hi")  # one row
    a = heads(t, target_id).withColumnRenamed("s", "ts")
    b = heads(d, doc_id).withColumnRenamed("s", "ds")
    pairs = a.join(b, "word").where((F.col("ds") * 10 >= F.col("ts") * 8) & (F.col("ts") * 10 >= F.col("ds") * 8)).select(target_id, doc_id).distinct()
    both = pairs.join(t.withColumnRenamed("w", "tw"), target_id).join(d.withColumnRenamed("w", "dw"), doc_id)
    common = F.size(F.array_intersect("tw", "dw"))
    jaccard = common / (F.size("tw") + F.size("dw") - common)
    by_set = both.select(target_id, doc_id, jaccard.alias("jaccard")).where("jaccard >= 0.8")
    return by_gram.join(by_set, [target_id, doc_id], "full_outer").select(target_id, doc_id, F.coalesce("shared_grams", F.lit(0)).alias("shared_grams"), F.round("jaccard", 9).alias("jaccard"))


def corpus_gate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: rows, distinct ids, null ids, blank texts, and whether the corpus may be used."""
    r = docs.agg(
        F.count("*").alias("rows"), F.countDistinct(id_col).alias("ids"), F.count_if(F.col(id_col).isNull()).alias("null_ids"),
        F.count_if(F.coalesce(F.trim(F.col(text_col)), F.lit("")) == "").alias("blank"),
    )
    return r.select("*", ((F.col("rows") > 0) & (F.col("rows") == F.col("ids")) & (F.col("null_ids") == 0) & (F.col("blank") == 0)).alias("ok"))


def zip_columns(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Array columns of equal length as rows (pos from 0); unequal lengths are an error, where arrays_zip would pad."""
    sizes = [F.size(c) for c in arrays]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    rest = [c for c in df.columns if c not in arrays]
    checked = df.where(F.when(same, True).otherwise(F.raise_error(F.lit("columns differ in length")).cast("boolean")))
    return checked.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "x")).select(*rest, "pos", "x.*")


def chunks(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part_no from 0, chunk): texts cut into pieces of ``size`` characters."""
    n = F.ceil(F.length(text_col) / size).cast("int")
    return docs.where(F.length(text_col) > 0).select(id_col, text_col, F.explode(F.sequence(F.lit(0), n - 1)).alias("part_no")).select(id_col, "part_no", F.substring(text_col, F.col("part_no") * size + 1, F.lit(size)).alias("chunk"))


def first_per_group(df: DataFrame, groups: list[str], order: Column, k: int) -> DataFrame:
    """The first k rows of each group by ``order``; Spark limits groups before the shuffle too."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(order))).where(F.col("rank") <= k)
