"""Operator 12: the prefix trie of conversations, with subtree sums by heavy paths.

A node stands for a distinct sequence of first turns; its members are the conversations that start with it. Turns get their
place by a sort over ranges of (conversation, turn), so that a conversation of any length spreads over tasks. The key of a
prefix is a 128-bit chain of its turns' digests, made in blocks of BLOCK turns: the totals of full blocks are a sequence of
their own, whose chain starts the next block, and so on.

Heavy-path decomposition: a node's heavy child is the one with most members (of equal ones that with the smallest member).
A light child has half its parent's members at most, so no node lies below more than log2(members) light edges. Nodes of one
light depth make up whole paths, and rounds go from the deepest light depth to the root's: each path is an array of its
nodes' values plus what light paths have attached to them, its suffix sums are the sums over subtrees, and the first of
them is attached to the node that the path hangs from. A node is touched once in all rounds.

Hot nodes (a common first turn, the root) are aggregated before they are shuffled, and their facts are broadcast
(``components.join_facts``). Equal conversations share all their nodes. The one thing that stays in one task is a digest over
the members that end at one node: it takes their numbers as a stream, sorted by Spark, in constant memory, since SHA-256 is
sequential.

Defined results: a null role or text is an empty one; turns come by turn, null first, ties by role, then text, and repeated
rows are turns of their own; rows with a null conv_id take no part; a conversation without turns is a member of the root and
ends there; an empty table has no node, not even a root; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.components import join_facts
from corpusloom.session import materialize, release, ship, table

#: Turns of a conversation, or nodes of a path, in a block; conv_ids in a chunk of a node's members.
BLOCK, CHUNK = 1024, 4096
#: Every so many conversations share the first turns of the first of them, up to TAKEN - 1 turns.
FAMILY, TAKEN = 5, 9
NO_MEMBER = hashlib.sha256(b"").hexdigest()


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal keys start."""
    change = np.zeros(len(keys[0]), dtype=bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos from 0, digest, n_bytes) for each turn, and (conv_id, n) for each conversation."""
    ship(conversations.sparkSession)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.octet_length("role").cast("string"), F.concat("role", "text")), 256), 1, 32))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))

    def number(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held, own = None, 0, TaskContext.get().partitionId()
        for p in parts:
            if not len(p):
                continue
            c = p["conv_id"].to_numpy()
            start = _runs([c])
            size = np.diff(np.append(start, len(c)))
            pos = np.arange(len(c), dtype=np.int64) - np.repeat(start, size)
            if last == c[0]:
                pos[: size[0]] += held
            last, held = c[-1], int(pos[-1]) + 1
            yield p.assign(pos=pos, pid=own)

    turns = materialize(placed.mapInPandas(number, "conv_id long, digest binary, n_bytes long, pos long, pid int"), "turns")
    pieces = turns.groupBy("conv_id", "pid").agg((F.max("pos") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A partition goes on with one conversation at most, so these are no more than partitions.
    goes_on = pieces.withColumn("before", before).where("before > 0").select("conv_id", "pid", "before")
    turns = turns.join(F.broadcast(goes_on), ["conv_id", "pid"], "left").select("conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "n_bytes")
    return turns, pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, n_bytes, length): each conversation rebuilt, its root (depth 0) and its turns from depth 1 on.

    It starts with the first h turns of the first conversation of its family, and goes on with its own after its first h.
    """
    turns, convs = ordered_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string")) % TAKEN
    convs = materialize(convs, "convs")
    facts = convs.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    facts = facts.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left").withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0))))
    facts = materialize(facts.withColumn("length", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")
    own = join_facts(turns.where(F.col("pos") >= h), facts.where("n > h").select("conv_id", "h", "lead", "n", "length"), "conv_id", "n", "inner")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("lead") + 1).alias("depth"), "digest", "n_bytes", "length")
    first = turns.where(F.col("pos") < TAKEN - 1).withColumnRenamed("conv_id", "base")
    # TAKEN - 1 turns at most of a conversation, for its family.
    lent = facts.where("lead > 0").select("conv_id", "base", "h", "length").join(first, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "n_bytes", "length")
    return own.union(lent).union(facts.select("conv_id", F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long"), "length"))


def _chained(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, blk, depth, digest, start) with key and prev, the chain within a block and its value before.

    The first of a sequence without digest is the root; prev is null there and at the start of later blocks.
    """
    schema = "conv_id long, depth long, n_bytes long, length long, k1 long, k2 long, p1 long, p2 long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, key = None, b""
        for p in parts:
            keys, prev, known = [], [], []
            for c, b, x, s in zip(p["conv_id"].tolist(), p["blk"].tolist(), p["digest"], p["start"]):
                fresh = at != (c, b)
                if fresh:
                    at, key = (c, b), bytes(16) if s is None else bytes(s)
                known.append(not fresh)
                prev.append(key)
                if x is not None:
                    key = hashlib.blake2b(key + x, digest_size=16).digest()
                keys.append(key)
            if keys:
                k, q = (np.frombuffer(b"".join(x), dtype="<i8").reshape(-1, 2) for x in (keys, prev))
                out = p[["conv_id", "depth", "n_bytes", "length"]].assign(k1=k[:, 0], k2=k[:, 1])
                yield out.assign(p1=pd.array(q[:, 0], dtype="Int64"), p2=pd.array(q[:, 1], dtype="Int64")).assign(**{c: lambda d, c=c: d[c].where(known) for c in ("p1", "p2")})

    by = ["conv_id", "blk"]
    return rows.select(*by, "depth", "digest", "start", "n_bytes", "length").repartition(*by).sortWithinPartitions(*by, "depth").mapInPandas(run, schema)


def prefix_keys(rows: DataFrame, block: int, longest: int) -> DataFrame:
    """(conv_id, depth, n_bytes, length, k1, k2, p1, p2): the key of each prefix and of the one before it."""
    blk = F.floor(F.col("depth") / block)
    rows = rows.withColumn("blk", blk)
    if longest < block:
        return _chained(rows.withColumn("start", F.lit(None).cast("binary")))
    full = rows.where(F.col("length") >= (F.col("blk") + 1) * block).withColumn("start", F.lit(None).cast("binary"))
    ends = _chained(full).where(F.col("depth") % block == block - 1)
    both = F.concat(*[F.unhex(F.lpad(F.hex(k), 16, "0")) for k in ("k1", "k2")])
    totals = materialize(ends.select("conv_id", blk.alias("depth"), both.alias("digest"), F.lit(0).cast("long").alias("n_bytes"), (F.floor(F.col("length") / block) - 1).alias("length")), "totals")
    carry = prefix_keys(totals, block, longest // block - 1).select("conv_id", (F.col("depth") + 1).alias("blk"), both.alias("start"))
    keyed = materialize(_chained(rows.join(carry, ["conv_id", "blk"], "left")), "chained")
    # Blocks start without knowing the key before: it is the last of the block before.
    starts = (F.col("depth") % block == 0) & (F.col("depth") > 0)
    last = keyed.where(F.col("depth") % block == block - 1).select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"))
    fixed = keyed.where(starts).join(last, ["conv_id", "depth"], "left").select("conv_id", "depth", "n_bytes", "length", "k1", "k2", F.col("q1").alias("p1"), F.col("q2").alias("p2"))
    return keyed.where(~starts).unionByName(fixed)


def _light_depths(flagged: DataFrame, block: int, longest: int) -> DataFrame:
    """level and head (key of the path's first node) for each row (conv_id, depth, k1, k2, light)."""
    flagged = flagged.withColumn("blk", F.floor(F.col("depth") / block)).withColumn("mark", F.when(F.col("light"), F.struct("depth", "k1", "k2")))
    inside = Window.partitionBy("conv_id", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = flagged.withColumn("level", F.sum(F.col("light").cast("int")).over(inside)).withColumn("head", F.max("mark").over(inside))
    if longest < block:
        return out
    earlier = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = flagged.groupBy("conv_id", "blk").agg(F.sum(F.col("light").cast("int")).alias("lights"), F.max("mark").alias("mark"))
    carry = sums.select("conv_id", "blk", F.sum("lights").over(earlier).alias("more"), F.max("mark").over(earlier).alias("above")).where("blk > 0")
    out = out.join(carry, ["conv_id", "blk"], "left").withColumn("level", F.col("level") + F.coalesce("more", F.lit(0)))
    return out.withColumn("head", F.coalesce("head", "above"))


def _suffix_sums(nodes: DataFrame, block: int, longest: int) -> DataFrame:
    """``nodes`` with saved and leaves summed from each node to the end of its path."""
    nodes = nodes.withColumn("blk", F.floor(F.col("depth") / block))
    schema = nodes.schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, {"saved": 0, "leaves": 0}
        for p in parts:
            if not len(p):
                continue
            ids = [p[c].to_numpy() for c in ("h1", "h2", "blk")]
            start = _runs(ids)
            size = np.diff(np.append(start, len(p)))
            goes_on, new = at == tuple(x[0] for x in ids), {}
            for c in held:
                v = p[c].to_numpy()
                total = np.cumsum(v)
                total -= np.repeat(total[start] - v[start], size)
                if goes_on:
                    total[: size[0]] += held[c]
                new[c] = total
            at, held = tuple(x[-1] for x in ids), {c: int(v[-1]) for c, v in new.items()}
            yield p.assign(**new)

    path = ["h1", "h2", "blk"]
    summed = nodes.repartition(*path).sortWithinPartitions(*path, F.desc("depth")).mapInPandas(run, schema)
    if longest < block:
        return summed.drop("blk")
    below = Window.partitionBy("h1", "h2").orderBy(F.desc("blk")).rowsBetween(Window.unboundedPreceding, -1)
    sums = nodes.groupBy(*path).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    carry = sums.select(*path, F.sum("s").over(below).alias("more_saved"), F.sum("l").over(below).alias("more_leaves")).where("more_saved is not null")
    out = summed.join(carry, path, "left")
    for c in ("saved", "leaves"):
        out = out.withColumn(c, F.col(c) + F.coalesce(f"more_{c}", F.lit(0)))
    return out.drop("blk", "more_saved", "more_leaves")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) over the members (k1, k2, conv_id) that end at a node: chunks of ids, hashed as a stream."""
    chunk = F.floor(F.col("conv_id") / CHUNK)
    chunks = ends.groupBy("k1", "k2", chunk.alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("k1", "k2", "chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for p in parts:
            out = []
            for k1, k2, ids in zip(p["k1"].tolist(), p["k2"].tolist(), p["ids"]):
                if at == (k1, k2):
                    state.update(b"," + ids.encode())
                else:
                    if state is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (k1, k2), hashlib.sha256(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    return chunks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "chunk").mapInPandas(run, "k1 long, k2 long, ends_sha256 string")


def prefix_trie(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of ``sequences`` (as ``rebuilt`` gives them), with counts and sums over its subtree.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    ship(sequences.sparkSession)
    sequences = materialize(sequences, "sequences")
    longest = sequences.agg(F.max("length")).first()[0] or 0
    rows = materialize(prefix_keys(sequences, block, longest), "prefixes")
    release(sequences)
    key, up = ["k1", "k2"], ["p1", "p2"]
    constant = [F.max("depth").alias("depth"), F.max("n_bytes").alias("n_bytes"), F.min("p1").alias("p1"), F.min("p2").alias("p2")]
    nodes = materialize(rows.groupBy(*key).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("owner"), *constant), "nodes")
    heavy = nodes.where("p1 is not null").groupBy(*up).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", (-F.col("owner")).alias("o"), *key)).alias("h"))
    heavy = materialize(heavy.join(nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("owner").alias("parent_owner")), up), "heavy")
    own = nodes.join(heavy.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("n_children").alias("children")), key, "left")
    known = join_facts(materialize(own, "nodes"), heavy, up, "n_children")
    is_heavy = (F.col("k1") == F.col("h.k1")) & (F.col("k2") == F.col("h.k2"))
    carried = ["p1", "p2", "n_convs", "n_bytes", "parent_owner", "children"]
    facts = materialize(known.select(*key, "owner", (~F.coalesce(is_heavy, F.lit(False))).alias("light"), *carried), "facts")
    # A node is told from its smallest member's row; the others only need what lies above it.
    flagged = join_facts(rows.select("conv_id", "depth", *key), facts, key, "n_convs", "inner")
    flagged = flagged.select("conv_id", "depth", *key, "light", F.when(F.col("owner") == F.col("conv_id"), F.struct(*carried)).alias("node"))
    tree = _light_depths(flagged, block, longest).where("node is not null")
    tree = tree.select(*key, F.col("conv_id"), "depth", "light", "level", F.col("head.k1").alias("h1"), F.col("head.k2").alias("h2"), "node.*")
    tree = tree.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).withColumn("leaves", F.col("children").isNull().cast("long"))
    tree = materialize(tree, "tree")
    release(nodes, heavy, facts)
    # Levels are at most log2 of the number of conversations.
    levels = sorted((r.level for r in tree.select("level").distinct().collect()), reverse=True)
    done = None
    for level in levels:
        part = tree.where(F.col("level") == level)
        if done is not None:
            hanging = done.where(F.col("light") & (F.col("level") == level + 1)).groupBy(*up).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
            part = part.join(hanging.withColumnsRenamed({"p1": "k1", "p2": "k2"}), key, "left")
            part = part.withColumn("saved", F.col("saved") + F.coalesce("s", F.lit(0))).withColumn("leaves", F.col("leaves") + F.coalesce("l", F.lit(0))).drop("s", "l")
        summed = materialize(_suffix_sums(part.select(*tree.columns), block, longest), "paths")
        done = summed if done is None else done.unionByName(summed)
    if done is None:
        done = tree
    digests = _end_digests(rows.where("depth = length").select(*key, "conv_id"))
    return done.join(digests, key, "left").select(
        "conv_id",
        "depth",
        F.col("parent_owner").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_MEMBER)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}
SQL = {
    "op12_prefix_trie": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(s) + 1),
        lambda k: [CAST(ascii(s[k]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h FROM i),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos < h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
s AS (SELECT c.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, pos) FILTER (WHERE part IS NOT NULL), []) AS turns FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY 1),
m AS (SELECT conv_id, len(turns) AS n, d, list_slice(turns, 1, d) AS key FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM s)),
k AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY key, d),
u AS (SELECT key, d, k.conv_id, n_convs, ends, coalesce(kids, 0) AS kids, CASE WHEN d > 0 THEN (n_convs - 1) * strlen(key[d].text) ELSE 0 END AS saved
      FROM k LEFT JOIN (SELECT list_slice(key, 1, d - 1) AS up, d - 1 AS up_d, count(*) AS kids FROM k WHERE d > 0 GROUP BY 1, 2) ON up = key AND up_d = d),
b AS (SELECT m.key, m.d, count(*) FILTER (WHERE kids = 0) AS n_leaves, sum(saved) AS saved FROM u JOIN m ON m.conv_id = u.conv_id AND m.d <= u.d GROUP BY 1, 2)
SELECT u.conv_id, u.d AS depth, p.conv_id AS parent_conv_id, u.n_convs, u.kids AS n_children, n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(u.ends) AS ends_sha256
FROM u JOIN b ON b.key = u.key AND b.d = u.d LEFT JOIN k p ON u.d > 0 AND p.d = u.d - 1 AND p.key = list_slice(u.key, 1, u.d - 1)"""
}
