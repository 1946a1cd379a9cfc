"""Operator 8: language identification by compression.

Each language has a zstandard raw-content dictionary of known text. A text is cut into blocks of BLOCK bytes, every block
is compressed with every dictionary, and the language of the smallest total wins, ties to the first by name. A margin
below MARGIN of the total rejects the winner: ``lang_kept`` is then ``und``, while ``lang_pred`` still names it.

Before compression texts are lower-cased and all but letters (ASCII others) become single blanks, so that capitals and
junk characters say nothing.

Dictionaries come from a bounded sample of labelled rows: at most SAMPLE_ROWS distinct texts for each language, of each at
most SAMPLE_BYTES characters from its first letter on, DICT_BYTES bytes in all; which ones is decided by a hash of the
text, at a rate that follows from the number of distinct texts. Every labelled language with a letter has a dictionary.
All prediction covers whole texts.

Defined results: ``und`` and a score of 0 for null or empty texts, texts without a letter, and where no row is labelled;
null labels teach nothing; repeated rows give repeated results; empty tables give empty tables; input columns that clash
with output names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import ship, table

DICT_BYTES, BLOCK, LEVEL = 131_072, 4096, 9
SAMPLE_ROWS, SAMPLE_BYTES = 160, 8192
MARGIN = 0.01
#: Natural-log odds that a saved byte is worth in the score.
BYTE_ODDS = 0.35
LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Letters alone: numerals such as fractions and Roman ones are none.
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def fold(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(LETTERS).split())


class Compressors:
    """One compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dict(sorted(dictionaries.items()))
        self.made: dict = {}

    def __getstate__(self) -> dict:
        return {"dictionaries": self.dictionaries, "made": {}}

    def sizes(self, data: bytes) -> dict[str, int]:
        import zstandard

        if not self.made:
            for lang, raw in self.dictionaries.items():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.made[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in self.made.items()}

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin as a share of the smallest size)."""
        if not text or not self.dictionaries or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        sizes = self.sizes(fold(text))
        best = min(sizes, key=sizes.__getitem__)
        low = sizes[best]
        others = sorted(s for lang, s in sizes.items() if lang != best)
        score = 1 / sum(math.exp(-min(700.0, BYTE_ODDS * (s - low))) for s in sizes.values())
        return best, score, (others[0] - low) / max(1, low) if others else 1.0


def learn_dictionaries(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """language -> dictionary, from the bounded sample that the module's text describes."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("h", F.xxhash64("text"))
    # Copies pass or fail together, so the rate counts a text once.
    counts = {r["lang"]: max(1, r["n"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * SAMPLE_ROWS / n))])
    hashed = rows.where(F.pmod("h", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).withColumn("text", F.regexp_extract("text", rf"\p{{L}}[\s\S]{{0,{SAMPLE_BYTES - 1}}}", 0))
    few = hashed.groupBy("lang", "h").agg(F.min("text").alias("text"))
    ranked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))).where(F.col("k") <= SAMPLE_ROWS)
    found: dict[str, bytes] = {lang: b"" for lang in counts}
    for r in ranked.orderBy("lang", "k").collect():
        if len(found[r["lang"]]) < DICT_BYTES:
            found[r["lang"]] += fold(r["text"]) + b" "
    return {lang: data[:DICT_BYTES] for lang, data in found.items() if data.strip()}


def identify(df: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score (0 to 1), margin, reliable (margin >= MARGIN) and lang_kept (lang_pred, or ``und`` if it isn't)."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Compressors(dictionaries))

    @F.pandas_udf("struct<l:string,s:double,m:double>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for part in parts:
            yield pd.DataFrame([c.predict(t) for t in part], columns=["l", "s", "m"])

    own = ("lang_pred", "score", "margin", "reliable", "lang_kept")
    out = df.select(F.struct(F.lit(0).alias("__"), *df.columns).alias("__doc"), predict(F.col(text_col)).alias("__p"))
    reliable = F.col("__p.m") >= MARGIN
    return out.select(*[F.col("__doc")[c].alias(c) for c in df.columns if c not in own], F.col("__p.l").alias("lang_pred"), F.col("__p.s").alias("score"), F.col("__p.m").alias("margin"), reliable.alias("reliable"), F.when(reliable, F.col("__p.l")).otherwise(UNKNOWN).alias("lang_kept"))


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of an id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn_dictionaries(docs.where(fold_of("doc_id", 3) != 1))
    found = identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "reliable", "lang_kept")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
