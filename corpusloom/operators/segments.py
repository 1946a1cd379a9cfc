"""Source segments with exact character offsets, and the windows of segments that evidence is looked up in.

Ids must be unique (``curation.corpus_gate`` says whether they are). Segments of a text are numbered from 1; ``start`` and
``end`` are character offsets [start, end) into the text. All windows are joins and windows within one text.
"""

from __future__ import annotations

import functools
import itertools
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.grammar import key_tokens, tokens, word_tokens
from corpusloom.session import ship

#: Words that refer to the sentence before, and how many segments a verdict cites and a window holds.
PLURAL = ("them", "these", "those", "both", "they")
CITED, WINDOW, REACH = 4, 8, 4
#: Private-use characters that mark boundaries; a text that holds them is cut there too.
CUT, JOINT = "\uf8fe", "\uf8ff"
_BOUNDARY = r"(?U)([.!?])(\s+)|(\r?\n[ \t]*\r?\n)"
#: What the pattern of a blank matches under (?U).
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_END, _WORD = re.compile(rf"[.!?](?=[{BLANKS}]|\Z)|\n"), re.compile(f"[^{BLANKS}]+")
#: Passages of one text that are told apart at once, a text with more takes turns; characters of passages sent at once.
HELD_PASSAGES, BATCH_CHARS = 200_000, 1 << 20


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def _blank(letter: Column) -> Column:
    """Whether the first or last character of a text is a blank; most texts have none at their ends and go by no pattern."""
    return (letter != "") & F.contains(F.lit(BLANKS), letter)


def _strip_left(text: Column) -> Column:
    return F.when(_blank(F.left(text, F.lit(1))), F.regexp_replace(text, r"(?U)^\s+", "")).otherwise(text)


def _strip(text: Column) -> Column:
    left = _strip_left(text)
    return F.when(_blank(F.right(text, F.lit(1))), F.regexp_replace(left, r"(?U)\s+$", "")).otherwise(left)


def source_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, start, end, text, breaks, para): sentences and paragraphs, cut after . ! ? before blanks and at blank lines.

    breaks: line breaks between a segment and the one before; para: number of its paragraph, as two breaks or more part two.
    Null, empty and blank texts have no segment.
    """
    marked = F.split(F.regexp_replace(text_col, _BOUNDARY, f"$1{CUT}$2$3{JOINT}"), CUT, -1)
    pieces = docs.select(id_col, F.posexplode(marked).alias("pos", "piece"))
    cut = F.when(F.col("pos") > 0, F.instr("piece", JOINT)).otherwise(0)
    pieces = pieces.select(id_col, "pos", F.substring("piece", F.lit(1), F.greatest(cut - 1, F.lit(0))).alias("gap"), F.substring("piece", cut + 1, F.length("piece")).alias("body"))
    by = Window.partitionBy(id_col).orderBy("pos")
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    lead = F.length("body") - F.length(_strip_left(F.col("body")))
    raw = F.coalesce(F.sum(F.length("gap") + F.length("body")).over(earlier), F.lit(0)) + F.length("gap")
    lines = F.coalesce(F.sum(_breaks(F.col("gap")) + _breaks(F.col("body"))).over(earlier), F.lit(0)) + _breaks(F.col("gap"))
    placed = pieces.select(id_col, "pos", (raw + lead).cast("int").alias("start"), (lines + _breaks(F.substring("body", F.lit(1), lead))).alias("line"), _strip(F.col("body")).alias("text")).where("text <> ''")
    before = F.lag(F.col("line") + _breaks(F.col("text"))).over(by)
    found = placed.select(
        id_col, "pos", F.row_number().over(by).alias("n"), "start", (F.col("start") + F.length("text")).alias("end"), "text", F.coalesce(F.col("line") - before, F.lit(0)).cast("int").alias("breaks")
    )
    # By place, as rows are in that order already.
    return found.withColumn("para", F.sum((F.col("breaks") >= 2).cast("int")).over(by).cast("int")).drop("pos")


def _sentences(text: str) -> tuple[array, array]:
    """Starts and ends of a text's sentences without the blanks around them."""
    starts, ends, at = array("q"), array("q"), 0
    for to in itertools.chain((m.end() for m in _END.finditer(text)), (len(text),)):
        body = text[at:to].lstrip(BLANKS)
        if body:
            starts.append(to - len(body))
            ends.append(starts[-1] + len(body.rstrip(BLANKS)))
        at = to
    return starts, ends


def _reach(starts: array, ends: array, limit: int) -> Iterator[int]:
    """For each part of a text, the first one from there on that doesn't end within ``limit`` characters of its start."""
    to = 0
    for start in starts:
        while to < len(ends) and ends[to] - start <= limit:
            to += 1
        yield to


def _spans(text: str, limit: int) -> Iterator[tuple[int, array]]:
    """Where passages start, and where those that start there end; equal passages come as often as the text has them."""
    starts, ends = _sentences(text)
    for i, to in enumerate(_reach(starts, ends, limit)):
        if to > i:
            yield starts[i], ends[i:to]
            continue
        first, last = array("q"), array("q")
        for w in _WORD.finditer(text, starts[i], ends[i]):
            first.append(w.start())
            last.append(w.end())
        for k, longest in enumerate(_reach(first, last, limit)):
            if longest > k:
                yield first[k], last[longest - 1 : longest]


def _distinct_passages(text: str, limit: int) -> Iterator[str]:
    turns = 1 + sum(len(ends) for _, ends in _spans(text, limit)) // HELD_PASSAGES if len(text) > HELD_PASSAGES // 4 else 1
    for turn in range(turns):
        seen = set()
        for start, ends in _spans(text, limit):
            for end in ends:
                passage = text[start:end]
                if passage not in seen and (turns == 1 or hash(passage) % turns == turn):
                    seen.add(passage)
                    yield passage


def _passages(limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, found, chars = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(found, batch.schema.field(1).type)], names=[batch.schema.names[0], "passage"])  # noqa: B023

        for i, text in enumerate(batch.column(1)):
            for passage in _distinct_passages(text.as_py(), limit):
                rows.append(i)
                found.append(passage)
                chars += len(passage)
                if chars >= BATCH_CHARS:
                    yield out()
                    rows, found, chars = [], [], 0
        if rows:
            yield out()


def evidence_passages(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, passage): distinct sentences and runs of adjacent ones of at most ``limit`` characters.

    A longer sentence gives, for each of its words, the longest run of words from there that fits. Sentences end after . ! ?
    before a blank or the end, and at line breaks; blanks between sentences are part of a run. A text's passages are found and
    told apart where the text is, so none is shuffled; rows without an id have none.
    """
    ship(docs.sparkSession)
    texts = docs.select(id_col, F.col(text_col).alias("passage")).where(F.col(id_col).isNotNull() & F.col("passage").isNotNull())
    return texts.mapInArrow(functools.partial(_passages, limit), texts.schema)


def _first_per_text(rows: DataFrame, id_col: str, order: list[Column], room: Column) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col("__r") <= room).drop("__r")


def nearby_segments(segments: DataFrame, chosen: DataFrame, id_col: str = "doc_id", reach: int = REACH, most: int = WINDOW) -> DataFrame:
    """(id, n): ``chosen`` (id, n) and the segments of their paragraphs within ``reach``, nearest first, ``most`` in all."""
    own = chosen.select(id_col, "n").distinct().join(segments.select(id_col, "n", "para"), [id_col, "n"])
    asked = own.select(id_col, F.col("para").alias("p"), F.col("n").alias("c"), F.explode(F.sequence(F.col("n") - reach, F.col("n") + reach)).alias("n"))
    held = own.groupBy(id_col).agg(F.count("*").alias("held"))
    near = asked.join(segments.select(id_col, "n", "para"), [id_col, "n"]).where("para = p").join(own.select(id_col, "n"), [id_col, "n"], "left_anti")
    near = near.groupBy(id_col, "n").agg(F.min(F.abs(F.col("n") - F.col("c"))).alias("d")).join(held, id_col)
    return own.select(id_col, "n").union(_first_per_text(near, id_col, [F.col("d"), F.col("n")], F.lit(most) - F.col("held")).select(id_col, "n"))


def with_antecedents(segments: DataFrame, chosen: DataFrame, id_col: str = "doc_id", most: int = CITED) -> DataFrame:
    """(id, n): ``chosen`` and the segment before each one that holds a plural reference, in its paragraph; ``most`` in all."""
    own = chosen.select(id_col, "n").distinct()
    held = own.groupBy(id_col).agg(F.count("*").alias("held"))
    plural = F.arrays_overlap(tokens(F.col("text")), F.array(*[F.lit(w) for w in PLURAL]))
    before = segments.join(own, [id_col, "n"]).where(plural & (F.col("breaks") < 2) & (F.col("n") > 1)).select(id_col, (F.col("n") - 1).alias("n"))
    more = before.join(own, [id_col, "n"], "left_anti").join(held, id_col)
    return own.union(_first_per_text(more, id_col, [F.col("n")], F.lit(most) - F.col("held")).select(id_col, "n"))


def related_windows(segments: DataFrame, chosen: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n, other): each chosen segment with itself and its neighbours in the same paragraph."""
    own = chosen.select(id_col, "n").distinct().join(segments.select(id_col, "n", "para"), [id_col, "n"])
    asked = own.select(id_col, "n", F.col("para").alias("p"), F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1)).alias("other"))
    return asked.join(segments.select(id_col, F.col("n").alias("other"), "para"), [id_col, "other"]).where("para = p").select(id_col, "n", "other")


def rank_by_terms(segments: DataFrame, claims: DataFrame, id_col: str = "doc_id", claim_col: str = "claim") -> DataFrame:
    """(id, n, shared, rank): segments by how many of the claim's key words they hold, ties in text order; one claim for each id."""
    asked = claims.select(id_col, F.array_distinct(key_tokens(F.col(claim_col))).alias("__c"))
    # Claims hold key words alone, so other words needn't be told apart in segments.
    shared = segments.join(asked, id_col).select(id_col, "n", F.size(F.array_intersect("__c", word_tokens(F.col("text")))).alias("shared"))
    return shared.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("shared"), "n")))


def ledger_window(segments: DataFrame, claims: DataFrame, proposed: DataFrame, id_col: str = "doc_id", claim_col: str = "claim", most: int = WINDOW) -> DataFrame:
    """(id, n): proposed segments, the one before each, then the best by shared words, until there are ``most``."""
    own = proposed.select(id_col, "n").distinct().withColumn("level", F.lit(0)).withColumn("at", F.col("n"))
    before = own.where("n > 1").select(id_col, (F.col("n") - 1).alias("n"), F.lit(1).alias("level"), (F.col("n") - 1).alias("at"))
    # Beyond the ``most`` best, which are as many segments, no other can find room by its rank.
    ranked = rank_by_terms(segments, claims, id_col, claim_col).where(F.col("rank") <= most).select(id_col, "n", F.lit(2).alias("level"), F.col("rank").alias("at"))
    every = own.union(before).union(ranked).groupBy(id_col, "n").agg(F.min(F.struct("level", "at")).alias("o"))
    return _first_per_text(every, id_col, [F.col("o")], F.lit(most)).select(id_col, "n")


def source_window(docs: DataFrame, segments: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, window, offsets): chosen segments as one text in order, with what lies between adjacent ones, else a blank line.

    offsets: (n, start, end) of each segment in the window.
    """
    rows = segments.join(chosen.select(id_col, "n").distinct(), [id_col, "n"]).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("n", "start", "end"))).alias("x"))
    j = rows.join(docs.select(id_col, F.col(text_col).alias("__t")), id_col)
    text = lambda s: F.substring(F.col("__t"), s["start"] + 1, s["end"] - s["start"])
    gap = lambda s, i: F.when(i == 0, "").when(F.col("x")[i - 1]["n"] == s["n"] - 1, F.substring(F.col("__t"), F.col("x")[i - 1]["end"] + 1, s["start"] - F.col("x")[i - 1]["end"])).otherwise("\n\n")
    j = j.select(id_col, F.transform("x", lambda s, i: F.struct(s["n"].alias("n"), gap(s, i).alias("g"), text(s).alias("t"))).alias("p"))
    whole = F.array_join(F.transform("p", lambda s: F.concat(s["g"], s["t"])), "")
    # A window holds WINDOW segments at most, so lengths so far may be summed anew for each.
    ends = F.transform("p", lambda s, i: F.aggregate(F.slice("p", F.lit(1), i + 1), F.lit(0), lambda a, y: a + F.length(y["g"]) + F.length(y["t"])))
    offsets = F.transform("p", lambda s, i: F.struct(s["n"].alias("n"), (ends[i] - F.length(s["t"])).alias("start"), ends[i].alias("end")))
    return j.select(id_col, whole.alias("window"), offsets.alias("offsets"))


def resolve_citations(verdicts: DataFrame, segments: DataFrame, id_col: str = "doc_id", most: int = CITED) -> DataFrame:
    """``verdicts`` (id, label, cited: segment numbers) with issue (null if right), and evidence, the cited texts in order.

    Citations are distinct, known, at most ``most``, and there are some unless the label is not_enough_info.
    """
    known = verdicts.select(id_col, F.explode("cited").alias("n")).distinct().join(segments.select(id_col, "n", "text"), [id_col, "n"]).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("k"))
    j = verdicts.join(known, id_col, "left")
    bad = (F.size("cited") > most) | ((F.col("label") != "not_enough_info") & (F.size("cited") == 0)) | (F.size(F.array_distinct("cited")) < F.size("cited")) | (F.size(F.coalesce("k", F.array())) < F.size("cited"))
    issue = F.when(~F.col("label").isin("support", "contradict", "not_enough_info"), "invalid_label").when(bad, "invalid_evidence_ids")
    return j.withColumn("issue", issue).select(*verdicts.columns, "issue", F.when(F.col("issue").isNull(), F.coalesce(F.transform("k", lambda x: x["text"]), F.array().cast("array<string>"))).alias("evidence"))
