"""Evidence binding: sentence units, spans, citations, range and interval joins, packing."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import squeeze


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, sentence): texts cut after . ! ? before blanks."""
    marked = F.split(F.regexp_replace(text_col, r"([.!?])[ \t\n\r\f]+", "$1\u0001"), "\u0001")
    return docs.select(id_col, F.posexplode(marked).alias("pos", "sentence")).where(F.trim("sentence") != "")


def neighbours_in_order(rows: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with the value before and after in the group."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("before", F.lag(value).over(w)).withColumn("after", F.lead(value).over(w))


def span_containment(spans: DataFrame, docs: DataFrame, span_id: str, doc_id: str, anchor: int = 4) -> DataFrame:
    """(span, doc): documents whose squeezed lower-case text contains the span's.

    A text that contains the span holds its first ``anchor`` words as a shingle, so only such pairs are tested. The last
    word of an anchor may go on in the document; anchors therefore leave out a span's outermost words. Spans of three words
    or more that are too short for such an anchor have a shorter one of all their inner words. Spans of one or two words
    have no inner word: their first word lies inside a document word, or ends one, which is looked for among the distinct
    words of all documents. Only lengths that occur cost a pass.
    """
    words = lambda c: F.split(squeeze(F.lower(F.col(c))), " ")
    s = spans.select(span_id, squeeze(F.lower(F.col("text"))).alias("span"), words("text").alias("w")).where(F.col("span").isNotNull())
    s = s.withColumn("inner", F.least(F.greatest(F.size("w") - 2, F.lit(0)), F.lit(anchor)))
    d = docs.select(doc_id, words("text").alias("w")).where(F.size("w") > 0)
    found = []
    for n in sorted(r["inner"] for r in s.select("inner").distinct().collect()):
        own = s.where(F.col("inner") == n)
        if n:
            asked = own.select(span_id, F.array_join(F.slice("w", 2, n), " ").alias("gram"))
            grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " ")))
            held = d.where(F.size("w") >= n).select(doc_id, F.explode(grams).alias("gram"))
        else:
            held = d.select(doc_id, F.explode(F.array_distinct("w")).alias("gram"))
            # A lone word is part of a document's word, the first of two ends one: equal to a part of its length.
            first = own.select(span_id, F.col("w")[0].alias("part"), (F.size("w") == 1).alias("alone"))
            vocabulary, parts = held.select("gram").distinct(), None
            for alone, size in sorted((r["alone"], r["n"]) for r in first.select("alone", F.length("part").alias("n")).distinct().collect()):
                cut = vocabulary.where(F.length("gram") >= size).select("gram", F.explode(_parts(F.col("gram"), size, alone)).alias("part"), F.lit(alone).alias("alone"))
                parts = cut if parts is None else parts.union(cut)
            asked = first.join(parts, ["part", "alone"]).select(span_id, "gram").distinct()
        found.append(asked.join(held, "gram").select(span_id, doc_id))
    if not found:
        return spans.select(span_id).limit(0).crossJoin(docs.select(doc_id).limit(0))
    pairs = functools.reduce(DataFrame.union, found).distinct()
    # Texts are read again for the few pairs, not carried along with every shingle.
    full = docs.select(doc_id, squeeze(F.lower(F.col("text"))).alias("doc"))
    return pairs.join(s.select(span_id, "span"), span_id).join(full, doc_id).where(F.contains("doc", F.col("span"))).select(span_id, doc_id).distinct()


def _parts(word: Column, size: int, anywhere: bool) -> Column:
    """The distinct parts of ``size`` characters of a word that has as many: all of them, or the one at its end."""
    last = F.length(word) - (size - 1)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(word, i, F.lit(size)))) if anywhere else F.array(F.substring(word, last, F.lit(size)))


def band_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, width: int) -> DataFrame:
    """Rows of a key whose positions (numbers) differ by at most ``width``: an equi-join on buckets of that width."""
    a = left.withColumn("__b", F.explode(F.array(*[F.floor(F.col(left_at) / width) + k for k in (-1, 0, 1)])))
    b = right.withColumn("__b", F.floor(F.col(right_at) / width))
    return a.join(b, [key, "__b"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= width).drop("__b")


def pack(rows: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """(group, kept, used): greedy packing in order, passing over what doesn't fit; a group must be bounded (a context)."""
    items = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("x"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0).cast("bigint").alias("used"))
    fits = lambda a, x: a["used"] + x[size] <= budget
    step = lambda a, x: F.when(fits(a, x), F.struct(F.concat(a["kept"], F.array(x[order].cast("bigint"))).alias("kept"), (a["used"] + x[size].cast("bigint")).alias("used"))).otherwise(a)
    return items.select(group, F.aggregate("x", start, step).alias("p")).select(group, "p.kept", "p.used")
