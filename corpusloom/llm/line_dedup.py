"""Operator 9: near-duplicate lines by a segment-partition edit join.

Lines are compared in a normal form (blanks squeezed, lower case); a line is eligible from ``min_exact`` characters on
(MIN_EXACT by default), as shorter ones ("Yes.") repeat by nature; with 1 every line that isn't blank is. Equal eligible lines
are always linked. Two lines of ``min_chars`` characters or more (MIN_CHARS by default, 1 at least) are also linked when their edit distance is at most EDITS characters, or at most ``word_edits`` words, a number that grows with the
words of the shorter line: one from MIN_WORDS words on, then the root of a twelfth of the words (2 from 48, 3 from 108, 4
from 192, up to MOST_WORD_EDITS from 768 on). By the root and with an end, as the keys of a line grow with the cube of the
threshold: a line of any length has some hundreds of keys of words at most. A line of one long word
or without blanks is compared by characters only.

A line of length L is cut into threshold + 1 segments; by pigeonhole a line within the threshold holds one of them
unchanged, near its place. The index has (L, segment number, segment); a line of length M looks up the substrings of the
multi-match-aware positions for every L that may lie so near. Characters and words are two such indexes, and L has its own
threshold in the second. Lines too short for segments of their own have the keys of what is left of them without up to EDITS
characters, which near lines share. Lines that share a key are verified by a banded bit-parallel edit distance. Equal lines are one
node; buckets are joined through their smallest nodes first and through bounded blocks where that leaves several
components (see ``components``).

A class is a connected component of lines; its first occurrence (smallest id, then text, then position) stays, the others
are dropped.

Defined results: null and empty texts have no eligible line and stay as they are; rows that agree in id and text share
one decision and both keep what it keeps; a null id orders first; a document may lose all lines, its text is then "";
empty tables give empty tables; lines of any length are compared whole; input columns that clash with output names are
replaced.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import materialize, release, ship, table

from .components import in_blocks, join_facts, linked_classes

EDITS = 2
MIN_CHARS = 24
#: Equal lines are copies from so many characters on.
MIN_EXACT = 5
MIN_WORDS = 8
MOST_WORD_EDITS = 8
#: Keys of words have seeds from here on.
WORD_SEEDS = 1 << 56
SHORT_SEED = 7
#: Candidate lines up to so many are broadcast (8 bytes each); beyond, they are joined by a shuffle.
BROADCAST_NODES = 500_000
SEEN = 300_000
#: Entries that a task holds before it sends them, those of each part of the keys as one row, and entries of a part, about.
HELD, PART = 1 << 20, 1 << 20
#: Parts there are for each shuffle partition at least, and entries that a line is taken to have.
PARTS, LINE_ENTRIES = 4, 24
#: Characters whose keys are made together, and what spans are hashed with.
CHUNK = 200_000
BASE, MIX, SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def normal(line: str) -> str:
    # Most lines are squeezed already; no blank but the space is printable.
    if "  " in line or not line.isprintable() or line[:1] == " " or line[-1:] == " ":
        line = " ".join(line.split())
    return line.lower()


def segments(length: int, parts: int = EDITS + 1) -> list[tuple[int, int]]:
    """(start, length) of the even partition: the last segments are one longer where it doesn't divide."""
    short, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = short + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def word_edits(words: int) -> int:
    """Words that may differ between a line of so many words and one that isn't shorter."""
    return min(MOST_WORD_EDITS, max(1, math.isqrt(words // 12))) if words >= MIN_WORDS else 0


def _spans(size: int, length: int, edits: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(start, end, seed, kind) of what ``size`` units look up among lines of ``length``, and of their own entries."""
    out = []
    delta = size - length
    for i, (at, n) in enumerate(segments(length, edits + 1)):
        low = max(0, at - i, at + delta - (edits - i))
        high = min(size - n, at + i, at + delta + (edits - i))
        out += [(p, p + n, seed + i, 3 if delta == 0 and p == at else 2) for p in range(low, high + 1)]
    return out


#: Starts, ends, seeds and kinds of a line's spans, in characters or in words: four rows.
Plan = np.ndarray


def _arrays(spans: list[tuple[int, int, int, int]]) -> Plan:
    return np.array(spans, dtype=np.int64).reshape(-1, 4).T.copy()


@functools.lru_cache(maxsize=20_000)
def _plan(size: int, edits: int = EDITS) -> Plan:
    """The spans of a line of ``size`` characters."""
    return _arrays([x for length in range(max(edits + 1, size - edits), size + 1) for x in _spans(size, length, edits, length * 16)])


def _long_word_plan(size: int) -> Plan:
    lengths = range(max(MIN_WORDS, size - word_edits(size)), size + 1)
    return _arrays([x for n in lengths if size - n <= word_edits(n) for x in _spans(size, n, word_edits(n), WORD_SEEDS + (n << 24))])


@functools.lru_cache(maxsize=512)
def _short_word_plan(size: int) -> Plan:
    return _long_word_plan(size)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of BASE and of its inverse, modulo 2**64."""
    one = np.ones(1, dtype=np.uint64)
    return tuple(np.concatenate((one, np.multiply.accumulate(np.full(n, b, dtype=np.uint64)))) for b in (BASE, INVERSE))


def _keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, kinds, places in ``lines``) of normal lines: spans of characters, and of words where there are enough.

    A span's hash is a polynomial of its characters, from sums over all lines together. Equal spans have equal keys; others
    that collide are told apart when links are verified.
    """
    text = " ".join(lines)
    plans: list[list] = [[], []]
    at, first = 0, 0
    for k, line in enumerate(lines):
        words = line.count(" ") + 1
        plans[0].append((_plan(len(line)), at, k))
        if words >= MIN_WORDS:
            plans[1].append((_short_word_plan(words) if words <= 512 else _long_word_plan(words), first, k))
        at += len(line) + 1
        first += words
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    up, down = _powers(-(-(len(codes) + 1) // CHUNK) * CHUNK)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    places = [np.arange(len(codes) + 2), np.concatenate(([0], np.flatnonzero(codes == 32) + 1, [len(codes) + 1]))]
    keys, kinds, of = [], [], []
    for unit, (own, place) in enumerate(zip(plans, places)):
        if not own:
            continue
        counts = [p.shape[1] for p, _, _ in own]
        starts, ends, seeds, kind = np.concatenate([p for p, _, _ in own], axis=1)
        shift = np.repeat([a for _, a, _ in own], counts)
        starts, ends = place[starts + shift], place[ends + shift] - unit
        h = ((sums[ends] - sums[starts]) * down[starts]) ^ (seeds.view(np.uint64) * MIX)
        h = (h ^ (h >> np.uint64(29))) * SPREAD
        h = (h ^ (h >> np.uint64(32))) * MIX
        keys.append((h ^ (h >> np.uint64(29))).view(np.int64))
        kinds.append(kind)
        of.append(np.repeat([k for _, _, k in own], counts))
    short = [(k, x) for k, line in enumerate(lines) if len(line) <= 2 * EDITS for x in _left_of(line)]
    if short:
        keys.append(np.array([_short_key(x) for _, x in short], dtype=np.int64))
        kinds.append(np.full(len(short), 3))
        of.append(np.array([k for k, _ in short]))
    return np.concatenate(keys), np.concatenate(kinds), np.concatenate(of)


def _left_of(line: str) -> set[str]:
    """What is left of a short line without up to EDITS of its characters."""
    return {"".join(c) for n in range(max(0, len(line) - EDITS), len(line) + 1) for c in itertools.combinations(line, n)}


def _short_key(left: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(left, SHORT_SEED) - (1 << 63)


def line_keys(line: str) -> list[tuple[int, int]]:
    """(key, kind) of a normal line: kind 1 is an index entry, 2 a look-up, 3 both; a key may come with several kinds."""
    keys, kinds, _ = _keys([line])
    return list(zip(keys.tolist(), kinds.tolist()))


def linked(a: str, b: str) -> bool:
    """Whether two normal lines of MIN_CHARS or more are near: by characters, or by words."""
    if within(a, b):
        return True
    edits = word_edits(min(a.count(" "), b.count(" ")) + 1)
    return bool(edits) and within(a.split(" "), b.split(" "), edits)


def within(a: str | list[str], b: str | list[str], edits: int = EDITS) -> bool:
    """Whether the edit distance is at most ``edits``.

    A bit-parallel automaton over the band of 2 * edits + 1 diagonals: bit d of level e says that a prefix of ``a``,
    d - edits longer than the prefix of ``b`` read so far, is reached with e edits.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    i = 0
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    places: dict[str, int] = {}
    for p, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << p
    full = (1 << 2 * edits + 1) - 1
    level = [1 << edits]
    for e in range(edits):
        level.append((level[e] << 1 | level[e]) & full)
    for p, c in enumerate(b):
        m = places.get(c, 0)
        m = (m >> p - edits if p >= edits else m << edits - p) & full
        before = level
        level = [before[0] & m]
        for e in range(1, edits + 1):
            level.append((before[e] & m | before[e - 1] | before[e - 1] >> 1 | level[e - 1] << 1) & full)
        if not level[edits]:
            return False
    return bool(level[edits] >> (len(a) - len(b) + edits) & 1)


def _eligible(text: str | None, least: int = MIN_EXACT) -> Iterator[tuple[int, str]]:
    for i, line in enumerate(text.split("\n") if text else ()):
        if len(line) >= least and len(x := normal(line)) >= least:
            yield i, x


def _node(line: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(line)


def _binary(digests: list[bytes]) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(digests), [None, pa.py_buffer(np.arange(len(digests) + 1, dtype="<i4") * 16), pa.py_buffer(b"".join(digests))])


def _short(digests: list[bytes]) -> np.ndarray:
    """The first 62 bits of nodes, which tell a bucket's lines apart."""
    return np.frombuffer(b"".join(digests), dtype=">i8").astype(np.int64)[::2] >> 2


def _packed(keys: np.ndarray, marks: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, keys, marks): a row for each part of the keys, its entries as arrays of 64-bit numbers."""
    part = ((keys.view(np.uint64) >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    held = np.flatnonzero(np.diff(ends, prepend=0))
    offsets = pa.py_buffer((np.concatenate(([0], ends[held])) * 8).astype("<i4"))
    packed = [pa.Array.from_buffers(pa.binary(), len(held), [None, offsets, pa.py_buffer(x[order])]) for x in (keys, marks)]
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), *packed], ["part", "keys", "marks"])


def _entries(least: int, parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, keys, marks) of the lines of texts, a mark being a line's short node and the kind in its last two bits; a line that the task has just seen isn't repeated."""
    seen: set[bytes] = set()
    made: list[tuple[np.ndarray, np.ndarray]] = []
    many, nodes, lines, size = 0, [], [], 0
    for batch in itertools.chain(batches, [None]):
        for text in [None] if batch is None else batch.column(0).to_pylist():
            for _, line in _eligible(text, least):
                d = _node(line)
                if d in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                nodes.append(d)
                lines.append(line)
                size += len(line) + 1
                if size < CHUNK:
                    continue
                keys, kinds, of = _keys(lines)
                made.append((keys, (_short(nodes) << 2)[of] | kinds))
                many += len(keys)
                nodes, lines, size = [], [], 0
                if many >= HELD:
                    yield _packed(*map(np.concatenate, zip(*made)), parts)
                    made, many = [], 0
    if lines:
        keys, kinds, of = _keys(lines)
        made.append((keys, (_short(nodes) << 2)[of] | kinds))
    if made:
        yield _packed(*map(np.concatenate, zip(*made)), parts)


def _members(part: pa.Table) -> pa.Table:
    """(key, short, kind) of the entries of a part whose key several lines share, one of them offering it and one looking it up."""
    keys, marks = (np.concatenate([np.frombuffer(x, dtype=np.int64) for x in part[c].to_pylist()]) for c in ("keys", "marks"))
    order = np.argsort(keys)
    keys, marks = keys[order], marks[order]
    same = keys[1:] == keys[:-1]
    again = np.append(False, same) | np.append(same, False)
    keys, marks = keys[again], marks[again]
    order = np.lexsort((marks, keys))
    keys, short, kind = keys[order], marks[order] >> 2, (marks[order] & 3).astype(np.int32)
    if len(keys):
        new = np.append(True, keys[1:] != keys[:-1])
        first = np.flatnonzero(new)
        wanted = (np.minimum.reduceat(short, first) != np.maximum.reduceat(short, first)) & (np.bitwise_or.reduceat(kind, first) == 3)
        first = np.flatnonzero(new | np.append(True, short[1:] != short[:-1]))
        kind = np.bitwise_or.reduceat(kind, first)
        held = wanted[np.cumsum(new)[first] - 1]
        keys, short, kind = keys[first][held], short[first][held], kind[held]
    return pa.table({"key": keys, "short": short, "kind": kind})


def _occurrences(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__id, __key, n, lines): each text's number of lines, and places and nodes of the eligible ones."""
    for batch in batches:
        counts, ends, places, nodes = [], [0], [], []
        for text in batch.column(2).to_pylist():
            counts.append(text.count("\n") + 1 if text else 0)
            for i, line in _eligible(text, least):
                places.append(i)
                nodes.append(_node(line))
            ends.append(len(places))
        items = pa.StructArray.from_arrays([pa.array(places, pa.int32()), _binary(nodes)], ["line_no", "node"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["__id", "__key", "n", "lines"])


def _lines(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    for batch in batches:
        nodes, lines = [], []
        for text in batch.column(0).to_pylist():
            for _, line in _eligible(text, least):
                if (d := _node(line)) not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    nodes.append(d)
                    lines.append(line)
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(_short(nodes)), _binary(nodes), pa.array(lines, pa.string())], ["short", "node", "line"])


def _links_in_block(cols: dict[str, np.ndarray], first: int, last: int) -> list[tuple]:
    """Links between components inside one block pair of a bucket; those that a found link already implies are left out."""
    pa_, pb = cols["part_a"][first], cols["part_b"][first]
    part, kind, lines, node, comp = (cols[c][first:last] for c in ("part", "kind", "line", "node", "comp"))
    codes: dict[bytes, int] = {}
    comp = np.fromiter((codes.setdefault(c, len(codes)) for c in comp), dtype=np.int64, count=len(comp))
    size = np.array([len(x) for x in lines])
    bins = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le"), dtype="<u4") % 61, minlength=61) for x in lines]).astype(np.int32)
    words = [[hash(w) % 61 for w in x.split(" ")] for x in lines]
    many = np.array([len(w) for w in words])
    may = np.array([word_edits(n) for n in many.tolist()])
    word_bins = np.stack([np.bincount(w, minlength=61) for w in words]).astype(np.int32)
    top = list(range(len(codes)))

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    out = []
    ys = np.flatnonzero(part == pb)
    for i in np.flatnonzero(part == pa_):
        js = ys[ys > i] if pa_ == pb else ys
        js = js[(comp[js] != comp[i]) & (((kind[js] & 1) & (kind[i] >> 1)) | ((kind[js] >> 1) & (kind[i] & 1)) > 0)]
        edits = np.minimum(may[js], may[i])
        js = js[(np.abs(size[js] - size[i]) <= EDITS) | (np.abs(many[js] - many[i]) <= edits)]
        if len(js):
            edits = np.minimum(may[js], may[i])
            by_words = (edits > 0) & (np.abs(word_bins[js] - word_bins[i]).sum(axis=1) <= 2 * edits)
            js = js[by_words | (np.abs(bins[js] - bins[i]).sum(axis=1) <= 2 * EDITS)]
        for j in js:
            if root(comp[i]) != root(comp[j]) and linked(lines[i], lines[j]):
                top[root(comp[i])] = root(comp[j])
                out.append((node[i], node[j]))
    return out


def line_classes(docs: DataFrame, text_col: str = "text", min_chars: int = MIN_CHARS, n_lines: int | None = None) -> DataFrame:
    """(node, comp) of the lines of ``min_chars`` or more that are linked to another; node is the 128-bit digest of the normal line.

    n_lines: about how many lines there are, counted if not given; the parts that keys are dealt into grow with them.
    """
    least = max(1, min_chars)
    texts = docs.select(F.col(text_col).alias("t")).where(F.octet_length("t") >= least)
    if n_lines is None:
        n_lines = texts.agg(F.sum(F.size(F.split("t", "\n")))).first()[0] or 0
    parts = max(PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_lines * LINE_ENTRIES // PART)
    # This is the widest shuffle: entries go packed, a row for all those that a task has for a part, and each of them meets others once.
    entries = texts.mapInArrow(functools.partial(_entries, least, parts), "part int, keys binary, marks binary")
    found = entries.groupBy("part").applyInArrow(_members, "key long, short long, kind int")
    found = materialize(found, "members")
    wanted = found.select("short").distinct()
    few = wanted.count() <= BROADCAST_NODES
    held = texts.mapInArrow(functools.partial(_lines, least), "short long, node binary, line string").join(F.broadcast(wanted) if few else wanted, "short", "left_semi")
    lines = materialize(held.groupBy("node").agg(F.first("short").alias("short"), F.first("line").alias("line")), "lines")
    members = materialize(found.join(lines.select("short", "node"), "short").select("key", "node", "kind"), "members")
    release(found)

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([linked(x, y) for x, y in zip(a, b)], dtype=bool)

    def verify(pairs: DataFrame) -> DataFrame:
        a, b = lines.select(F.col("node").alias("a"), F.col("line").alias("la")), lines.select(F.col("node").alias("b"), F.col("line").alias("lb"))
        return pairs.join(a, "a").join(b, "b").where(near("la", "lb")).select("a", "b")

    def residual(dealt: DataFrame) -> DataFrame:
        return in_blocks(dealt.join(lines, "node").select("key", "part", "part_a", "part_b", "node", "kind", "comp", "line"), _links_in_block, "a binary, b binary")

    comps = linked_classes(members, verify, residual)
    release(members, lines)
    return comps


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exact: int = MIN_EXACT, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``text_col`` rid of dropped lines, n_lines, n_eligible, n_dropped and dropped.

    dropped: (line_no, first_id, first_line_no) of each dropped line, first being the class's occurrence that stays.
    min_exact, min_chars: from how many characters on equal and near lines are linked; lines that may be near may be equal too.
    """
    own = ("n_lines", "n_eligible", "n_dropped", "dropped")
    ship(docs.sparkSession)
    base = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__key"))

    kind = base.schema["__id"].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__key"), F.col(text_col).alias("__text")).mapInArrow(functools.partial(_occurrences, max(1, min(min_exact, min_chars))), f"__id {kind}, __key long, n int, lines array<struct<line_no:int,node:binary>>")
    counted = materialize(counted, "occurrences")
    counted_lines = counted.select("__id", "__key", F.explode("lines").alias("x")).select("__id", "__key", "x.line_no", "x.node")
    comps = line_classes(docs, text_col, min_chars, counted.agg(F.sum("n")).first()[0] or 0)
    # A row for each distinct line, so that a very common one is a row too when classes are looked up.
    at = F.struct("__id", "__key", "line_no")
    nodes = counted_lines.groupBy("node").agg(F.count("*").alias("rows"), F.min(at).alias("f"))
    nodes = nodes.join(comps, "node", "left").where("rows > 1 or comp is not null")
    nodes = materialize(nodes.select("node", "rows", "f", F.coalesce("comp", "node").alias("cls")), "nodes")
    release(comps)
    classes = nodes.groupBy("cls").agg(F.count("*").alias("many"), F.min("f").alias("f"))
    facts = materialize(join_facts(nodes.select("node", "rows", "cls"), classes.select("cls", "many", "f"), "cls", "many", "inner").select("node", "rows", "f"), "facts")
    release(nodes)
    again = join_facts(counted_lines, facts, "node", "rows", "inner").where(~at.eqNullSafe(F.col("f")))
    # A row that repeats with its id and text has each line twice; a set keeps one of each.
    dropped = again.groupBy("__id", "__key").agg(F.collect_set(F.struct("line_no", F.col("f.__id").alias("first_id"), F.col("f.line_no").alias("first_line_no"))).alias("d"))
    dropped = dropped.select(F.col("__id").alias("__i"), F.col("__key").alias("__k"), F.array_sort("d").alias("d"))
    sizes = counted.groupBy("__id", "__key").agg(F.first("n").alias("n"), F.first(F.size("lines")).alias("e"))
    facts = sizes.join(dropped, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k")), "left").select(F.col("__id").alias("__i"), F.col("__key").alias("__k"), "n", "e", "d")
    out = base.join(facts, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__key") == F.col("__k")))
    numbers = F.transform("d", lambda x: x["line_no"])
    whole = F.col("__doc")[text_col]
    text = F.when(F.col("d").isNull(), whole).otherwise(F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains(numbers, i)), "\n"))
    return out.select(
        *[(text if c == text_col else F.col("__doc")[c]).alias(c) for c in docs.columns if c not in own or c == text_col],
        F.col("n").alias("n_lines"),
        F.col("e").alias("n_eligible"),
        F.coalesce(F.size("d"), F.lit(0)).alias("n_dropped"),
        F.coalesce("d", F.array().cast(dropped.schema["d"].dataType)).alias("dropped"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its lines, and those dropped with the occurrence that stays in their place."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL: dict[str, str] = {}
