"""Queries on source segments and their windows, over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import grammar as G
from corpusloom.operators import segments as S
from corpusloom.session import materialize, table

LIMIT = 160


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(S.source_segments(_documents(spark, sf)), "segments")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Segments without offsets and paragraphs, which are then not worked out."""
    return materialize(S.source_segments(_documents(spark, sf)).select("doc_id", "n", "text"), "segments")


def source_segments(spark: SparkSession, sf: str) -> DataFrame:
    return S.source_segments(_documents(spark, sf))


def _chosen(s: DataFrame) -> DataFrame:
    """A stand-in for cited segments: the second, the fifth and every twelfth."""
    return s.where("n in (2, 5) or n % 12 = 0").select("doc_id", "n")


def nearby_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = _segments(spark, sf)
    return S.nearby_segments(s, _chosen(s))


def related_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = _segments(spark, sf)
    return S.related_windows(s, _chosen(s))


def source_window(spark: SparkSession, sf: str) -> DataFrame:
    """The nearby window of the second and fifth segment as one text."""
    s = _segments(spark, sf)
    near = S.nearby_segments(s, s.where("n in (2, 5)").select("doc_id", "n"))
    w = S.source_window(_documents(spark, sf), s, near)
    return w.select("doc_id", F.md5("window").alias("window"), F.transform("offsets", lambda o: o["end"]).alias("ends"))


def ledger_window(spark: SparkSession, sf: str) -> DataFrame:
    """A document's third segment is its claim, the fifth is proposed."""
    s = _texts(spark, sf)
    return S.ledger_window(s, s.where("n = 3").select("doc_id", F.col("text").alias("claim")), s.where("n = 5").select("doc_id", "n"))


def segment_rank(spark: SparkSession, sf: str) -> DataFrame:
    s = _texts(spark, sf)
    return S.rank_by_terms(s, s.where("n = 3").select("doc_id", F.col("text").alias("claim"))).where("rank <= 5")


def evidence_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct passages of each document, as counts and a digest of their lengths."""
    p = S.evidence_passages(_documents(spark, sf), LIMIT)
    return p.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("passage")).alias("chars"), F.max(F.length("passage")).alias("longest"))


def resolve_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on documents by a rule on ids: some cite segments that don't exist, too many, or the same twice."""
    k = F.col("doc_id") % 7
    cited = F.when(k == 0, F.array().cast("array<int>")).when(k == 1, F.array(F.lit(1), F.lit(1))).when(k == 2, F.sequence(F.lit(1), F.lit(5))).when(k == 3, F.array(F.lit(9_999_999))).otherwise(F.array(F.lit(2), F.lit(1)))
    label = F.when(F.col("doc_id") % 5 == 0, "not_enough_info").when(F.col("doc_id") % 11 == 0, "perhaps").otherwise("support")
    v = _documents(spark, sf).select("doc_id", label.alias("label"), cited.alias("cited"))
    return S.resolve_citations(v, _segments(spark, sf)).select("doc_id", "issue", F.transform("evidence", F.length).alias("evidence"))


_BLANK = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SEG = rf"""
WITH m AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])({_BLANK}+)|(\r?\n[ \t]*\r?\n)', '\1' || chr(1) || '\2\3' || chr(2), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, unnest(x) AS piece, generate_subscripts(x, 1) AS pos FROM m),
b AS (SELECT doc_id, pos, CASE WHEN pos > 1 THEN split_part(piece, chr(2), 1) ELSE '' END AS gap, CASE WHEN pos > 1 THEN substr(piece, strpos(piece, chr(2)) + 1) ELSE piece END AS body FROM p),
c AS (SELECT *, length(body) - length(regexp_replace(body, '^{_BLANK}+', '')) AS lead, regexp_replace(regexp_replace(body, '^{_BLANK}+', ''), '{_BLANK}+$', '') AS text,
  coalesce(sum(length(gap) + length(body)) OVER w, 0) + length(gap) AS raw, coalesce(sum(length(gap || body) - length(replace(gap || body, chr(10), ''))) OVER w, 0) AS lines
  FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT doc_id, pos, (raw + lead)::INT AS start, (raw + lead + length(text))::INT AS "end", text,
  lines + length(gap || left(body, lead)) - length(replace(gap || left(body, lead), chr(10), '')) AS line, length(text) - length(replace(text, chr(10), '')) AS own FROM c WHERE text <> ''),
e AS (SELECT doc_id, row_number() OVER w AS n, start, "end", text, coalesce(line - lag(line + own) OVER w, 0)::INT AS breaks FROM d WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
s AS (SELECT *, (sum((breaks >= 2)::INT) OVER (PARTITION BY doc_id ORDER BY n))::INT AS para FROM e),
ch AS (SELECT doc_id, n, para FROM s WHERE n IN (2, 5) OR n % 12 = 0)"""
_NEAR = """
, {o} AS (SELECT doc_id, n FROM {c}), {o}h AS (SELECT doc_id, count(*) AS held FROM {o} GROUP BY doc_id),
{o}d AS (SELECT s.doc_id, s.n, min(abs(s.n - c.n)) AS d FROM s JOIN {c} c ON s.doc_id = c.doc_id AND s.para = c.para AND abs(s.n - c.n) <= 4 WHERE NOT EXISTS (SELECT 1 FROM {o} o WHERE o.doc_id = s.doc_id AND o.n = s.n) GROUP BY s.doc_id, s.n),
{o}n AS (SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, n) AS r FROM {o}d) JOIN {o}h USING (doc_id) WHERE r <= 8 - held UNION ALL SELECT doc_id, n FROM {o})"""
_TOKEN = r"[+−-]?\pN+(?:[.,/]\pN+)*|[\pL\pM]+(?:[-‐‑][\pL\pM]+)*|[^\s\pL\pM\pN_]"
_STOP = "['" + "','".join(G.FUNCTION_WORDS) + "']"
_KEYS = rf"list_filter(list_transform(regexp_extract_all({{0}}, '{_TOKEN}'), lambda t: translate(lower(t), '‑‐', '--')), lambda t: regexp_matches(t, '[\pL\pN]') AND NOT list_contains({_STOP}, t))"
_RANK = f"""
, cl AS (SELECT doc_id, list_distinct({_KEYS.format('text')}) AS c FROM s WHERE n = 3),
rk AS (SELECT s.doc_id, s.n, len(list_intersect(c, {_KEYS.format('s.text')})) AS shared FROM s JOIN cl USING (doc_id)),
ra AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, n) AS rank FROM rk)"""

QUERIES = {f.__name__: f for f in (source_segments, nearby_segments, related_windows, source_window, segment_rank, ledger_window, evidence_passages, resolve_citations)}
SQL = {
    "source_segments": _SEG + " SELECT * FROM s",
    "nearby_segments": _SEG + _NEAR.format(o="t", c="ch") + " SELECT doc_id, n FROM tn",
    "related_windows": _SEG + " SELECT c.doc_id, c.n, s.n AS other FROM ch c JOIN s ON s.doc_id = c.doc_id AND s.para = c.para AND abs(s.n - c.n) <= 1",
    "source_window": _SEG
    + ", c2 AS (SELECT doc_id, n, para FROM s WHERE n IN (2, 5))"
    + _NEAR.format(o="t", c="c2")
    + """, x AS (SELECT s.*, lag(s.n) OVER w AS pn, lag(s."end") OVER w AS pe FROM s JOIN tn q ON s.doc_id = q.doc_id AND s.n = q.n WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.n)),
y AS (SELECT x.doc_id, x.n, CASE WHEN pn IS NULL THEN '' WHEN pn = x.n - 1 THEN substr(t.text, pe + 1, start - pe) ELSE chr(10) || chr(10) END AS g, x.text AS t FROM x JOIN documents t USING (doc_id)),
z AS (SELECT *, (sum(length(g) + length(t)) OVER (PARTITION BY doc_id ORDER BY n))::INT AS e FROM y)
SELECT doc_id, md5(string_agg(g || t, '' ORDER BY n)) AS "window", list(e ORDER BY n) AS ends FROM z GROUP BY doc_id""",
    "segment_rank": _SEG + _RANK + " SELECT * FROM ra WHERE rank <= 5",
    "ledger_window": _SEG
    + _RANK
    + """, pr AS (SELECT doc_id, n FROM s WHERE n = 5), lv AS (SELECT doc_id, n, 0 AS level, n AS pl FROM pr UNION ALL SELECT doc_id, n - 1, 1, n - 1 FROM pr UNION ALL SELECT doc_id, n, 2, rank FROM ra),
u AS (SELECT doc_id, n, min(row(level, pl)) AS o FROM lv GROUP BY ALL) SELECT doc_id, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM u) WHERE r <= 8""",
    "evidence_passages": rf"""
WITH m AS (SELECT doc_id, text AS t, string_split(regexp_replace(regexp_replace(text, '([.!?])({_BLANK})', '\1' || chr(1) || '\2', 'g'), '([.!?])$|(\n)', '\1\2' || chr(1), 'g'), chr(1)) AS x FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, t, unnest(x) AS piece, generate_subscripts(x, 1) AS pos FROM m),
q AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raw, regexp_replace(regexp_replace(piece, '^{_BLANK}+', ''), '{_BLANK}+$', '') AS s FROM p),
r AS (SELECT doc_id, t, pos, s, raw + length(piece) - length(regexp_replace(piece, '^{_BLANK}+', '')) AS a FROM q WHERE s <> ''),
f AS (SELECT *, a + length(s) AS b FROM r),
g AS (SELECT DISTINCT i.doc_id, substr(i.t, i.a::INT + 1, (j.b - i.a)::INT) AS v FROM f i JOIN f j ON i.doc_id = j.doc_id AND j.a >= i.a AND j.b - i.a <= {LIMIT}),
w AS (SELECT doc_id, pos, s, regexp_extract_all(s, '{_BLANK}*[^\s\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{3000}}]+') AS l FROM f WHERE length(s) > {LIMIT}),
h AS (SELECT doc_id, pos, s, unnest(l) AS z, generate_subscripts(l, 1) AS k FROM w),
o AS (SELECT doc_id, pos, s, k, sum(length(z)) OVER (PARTITION BY doc_id, pos ORDER BY k) AS b, length(regexp_replace(z, '^{_BLANK}+', '')) AS c FROM h),
y AS (SELECT i.doc_id, i.s, i.b - i.c AS a, max(j.b) AS b FROM o i JOIN o j ON i.doc_id = j.doc_id AND i.pos = j.pos AND j.k >= i.k AND j.k <= i.k + {LIMIT} AND j.b - (i.b - i.c) <= {LIMIT} GROUP BY i.doc_id, i.pos, i.k, i.s, i.b, i.c),
al AS (SELECT doc_id, v FROM g UNION SELECT doc_id, substr(s, a::INT + 1, (b - a)::INT) FROM y)
SELECT doc_id, count(*) AS n, sum(length(v))::BIGINT AS chars, max(length(v)) AS longest FROM al GROUP BY doc_id""",
    "resolve_citations": _SEG
    + """, v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'not_enough_info' WHEN doc_id % 11 = 0 THEN 'perhaps' ELSE 'support' END AS label,
CASE doc_id % 7 WHEN 0 THEN [] WHEN 1 THEN [1, 1] WHEN 2 THEN [1, 2, 3, 4, 5] WHEN 3 THEN [9999999] ELSE [2, 1] END AS cited FROM documents),
k AS (SELECT v.doc_id, list(length(s.text) ORDER BY s.n) AS k FROM v JOIN s ON s.doc_id = v.doc_id AND list_contains(v.cited, s.n) GROUP BY v.doc_id),
i AS (SELECT v.doc_id, k, CASE WHEN label = 'perhaps' THEN 'invalid_label' WHEN len(cited) > 4 OR (label <> 'not_enough_info' AND len(cited) = 0) OR len(list_distinct(cited)) < len(cited) OR coalesce(len(k), 0) < len(cited) THEN 'invalid_evidence_ids' END AS issue FROM v LEFT JOIN k USING (doc_id))
SELECT doc_id, issue, CASE WHEN issue IS NULL THEN coalesce(k, []) END AS evidence FROM i""",
}
