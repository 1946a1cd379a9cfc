"""Curation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators import curation as C
from corpusloom.session import table

CHUNK, MIN_CHARS = 800, 60


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("source", C.hash_split("doc_id").alias("split")).agg(F.count("*").alias("n"))


def split_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    """Sources in both halves of the split, which a training split must not have."""
    d = table(spark, sf, "documents").select("source", C.hash_split("doc_id").alias("split"))
    return d.where("split = 'dev'").select("source").intersect(d.where("split = 'test'").select("source"))


def shingle_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return C.shingle_leakage(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 12, "doc_id", "item_id")


def leakage_screen(spark: SparkSession, sf: str) -> DataFrame:
    return C.leakage_pairs(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"), "doc_id", "item_id")


def seen_union_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and conversation turns as one list; equal texts, but for case and outer blanks, keep the first document."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1_000_000_000).alias("id"), "text")
    return C.keep_first(d.unionByName(t), F.lower(F.trim(F.col("text"))), "id")


def reject_routing(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's first reason to be rejected, or accepted; every one of several equal texts is a duplicate."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.md5("text").alias("key"))
    same = d.groupBy("key").agg(F.count("*").alias("copies"))
    marked = d.join(same, "key").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    reason = F.when(F.col("n_chars") < MIN_CHARS, "too_short").when(F.col("copies") > 1, "duplicate").when(F.col("quality").isNull(), "unlabelled").when(F.col("quality") == 0, "low_quality").otherwise("accepted")
    return marked.select("doc_id", reason.alias("reason"))


def corpus_gate(spark: SparkSession, sf: str) -> DataFrame:
    return C.corpus_gate(table(spark, sf, "documents"))


def struct_of_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as parallel arrays, then as rows again."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("x"))
    arrays = lines.select("l_orderkey", F.col("x.l_linenumber").alias("line"), F.col("x.l_partkey").alias("part"), F.col("x.l_quantity").alias("quantity"))
    rows = C.zip_columns(arrays, ["line", "part", "quantity"])
    return rows.groupBy("pos").agg(F.count("*").alias("n"), F.sum("part").alias("parts"), F.round(F.sum("quantity"), 2).alias("quantity"))


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunks(table(spark, sf, "documents"), CHUNK).select("doc_id", "part_no", F.length("chunk").alias("size"), F.md5("chunk").alias("digest"))


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of raw pages, with what inner markup holds, an adaptation of page blocks to HTML, with the page's title."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.transform(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)</p>"), F.lit(1)), lambda x: F.regexp_replace(x, "<[^>]*>", "")).alias("b"))
    return p.select("page_id", "title", F.posexplode("b").alias("block_no", "block")).select("page_id", F.length("title").alias("title_size"), "block_no", F.length("block").alias("size"), F.md5("block").alias("digest"))


def eligible_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Two documents a source of 35 to 200 words without markup signs, of good quality, in the order of a hash of the id."""
    d = table(spark, sf, "documents").withColumn("words", F.size(F.split(F.trim("text"), "[ \\t\\n\\r]+"))).where("words between 35 and 200").where(~F.col("text").rlike(r"[$\\{}|]"))
    good = d.join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return C.first_per_group(good.select("source", "doc_id", "words"), ["source"], F.md5(F.col("doc_id").cast("string")), 2)


def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Five documents of each language and source by a hash of the id: a sample that is the same everywhere."""
    return C.first_per_group(table(spark, sf, "documents").select("lang", "source", "doc_id"), ["lang", "source"], F.md5(F.concat(F.lit("s"), F.col("doc_id").cast("string"))), 5)


def claim_doc_nei(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as claims and their returned lines as evidence; a claim that cites none has not enough information."""
    cited = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    evidence = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("spans"))
    j = cited.join(evidence, "o_orderkey", "left")
    return j.groupBy("o_orderpriority", F.when(F.col("spans").isNull(), "not_enough_info").otherwise("support").alias("label")).agg(F.count("*").alias("n"), F.coalesce(F.sum("spans"), F.lit(0)).alias("spans"))


def json_strict(spark: SparkSession, sf: str) -> DataFrame:
    """The number under k of strict JSON properties; invalid ones count as rejected."""
    e = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.expr("try_parse_json(props)").isNotNull().alias("valid"))
    return e.groupBy("event_type").agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("rejected"), F.sum("k").alias("total"))


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Document and collection frequency of each term."""
    w = table(spark, sf, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return w.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


QUERIES = {f.__name__: f for f in (hash_split, split_disjoint, shingle_leakage, leakage_screen, seen_union_dedup, reject_routing, corpus_gate, struct_of_arrays, chunk_fixed, page_blocks, eligible_paragraphs, stratified_sample, claim_doc_nei, json_strict, term_stats)}
_SPLIT = "CASE WHEN ('0x' || substr(sha256(doc_id::VARCHAR), 1, 8))::BIGINT % 2 = 0 THEN 'dev' ELSE 'test' END"
_GRAMS = "SELECT DISTINCT {0}, unnest(list_distinct(list_transform(range(1, len(w) - {2} + 2), lambda i: array_to_string(w[i:i + {2} - 1], ' ')))) AS gram FROM (SELECT {0}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {1}) WHERE len(w) >= {2}"
_WORDS = "SELECT {0}, len(w) AS {2}, unnest(w) AS word FROM (SELECT {0}, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {1}) WHERE len(w) >= 6"
SQL = {
    "hash_split": f"SELECT source, {_SPLIT} AS split, count(*) AS n FROM documents GROUP BY ALL",
    "split_disjoint": f"SELECT source FROM documents WHERE {_SPLIT} = 'dev' INTERSECT SELECT source FROM documents WHERE {_SPLIT} = 'test'",
    "shingle_leakage": f"SELECT doc_id, count(*) AS shared FROM ({_GRAMS.format('doc_id', 'documents', 12)}) WHERE gram IN (SELECT gram FROM ({_GRAMS.format('item_id', 'benchmark', 12)})) GROUP BY doc_id",
    "leakage_screen": f"""WITH g AS (SELECT item_id, doc_id, count(*) AS shared_grams FROM ({_GRAMS.format('item_id', 'benchmark', 8)}) JOIN ({_GRAMS.format('doc_id', 'documents', 8)}) USING (gram) GROUP BY ALL),
s AS (SELECT item_id, doc_id, count(*) / (ts + ds - count(*)) AS jaccard FROM ({_WORDS.format('item_id', 'benchmark', 'ts')}) JOIN ({_WORDS.format('doc_id', 'documents', 'ds')}) USING (word) GROUP BY item_id, doc_id, ts, ds HAVING count(*) / (ts + ds - count(*)) >= 0.8)
SELECT item_id, doc_id, coalesce(shared_grams, 0) AS shared_grams, round(jaccard, 9) AS jaccard FROM g FULL JOIN s USING (item_id, doc_id)""",
    "seen_union_dedup": "SELECT md5(lower(trim(text))) AS key, min(id) AS id, count(*) AS copies FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT conv_id * 1000 + turn + 1000000000, text FROM conversations) GROUP BY 1",
    "reject_routing": """SELECT doc_id, CASE WHEN n_chars < 60 THEN 'too_short' WHEN count(*) OVER (PARTITION BY text) > 1 THEN 'duplicate' WHEN quality IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'low_quality' ELSE 'accepted' END AS reason
FROM documents LEFT JOIN labels USING (doc_id)""",
    "corpus_gate": """SELECT *, rows > 0 AND rows = ids AND null_ids = 0 AND blank = 0 AS ok FROM (SELECT count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) FILTER (doc_id IS NULL) AS null_ids,
count(*) FILTER (coalesce(trim(text), '') = '') AS blank FROM documents)""",
    "struct_of_arrays": """SELECT pos, count(*) AS n, sum(l_partkey)::BIGINT AS parts, round(sum(l_quantity), 2) AS quantity FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS pos FROM lineitem) GROUP BY pos""",
    "chunk_fixed": "SELECT doc_id, part_no, length(chunk) AS size, md5(chunk) AS digest FROM (SELECT doc_id, part_no, substring(text, part_no * 800 + 1, 800) AS chunk FROM (SELECT doc_id, text, unnest(range((length(text) + 799) // 800)) AS part_no FROM documents))",
    "page_blocks": """SELECT page_id, length(title) AS title_size, i - 1 AS block_no, length(b[i]) AS size, md5(b[i]) AS digest FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM (
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')) AS b FROM pages))""",
    "eligible_paragraphs": r"""SELECT * FROM (SELECT source, doc_id, words, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR)) AS rank FROM (
SELECT *, len(regexp_split_to_array(trim(text), '[ \t\n\r]+')) AS words FROM documents) WHERE words BETWEEN 35 AND 200 AND NOT regexp_matches(text, '[$\\{}|]') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) WHERE rank <= 2""",
    "stratified_sample": "SELECT * FROM (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('s' || doc_id)) AS rank FROM documents) WHERE rank <= 5",
    "claim_doc_nei": """SELECT o_orderpriority, CASE WHEN spans IS NULL THEN 'not_enough_info' ELSE 'support' END AS label, count(*) AS n, coalesce(sum(spans), 0)::BIGINT AS spans
FROM orders LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS spans FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (o_orderkey) GROUP BY 1, 2""",
    "json_strict": "SELECT event_type, count(*) FILTER (json_valid(props)) AS valid, count(*) FILTER (NOT json_valid(props)) AS rejected, sum((props->>'$.k')::INT)::BIGINT AS total FROM events GROUP BY event_type",
    "term_stats": "SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term",
}
