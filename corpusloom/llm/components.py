"""Connected components, and classes of a similarity join from shared buckets without all pairs of a bucket."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import hold, materialize, release

BLOCK = 1024
#: A key is hot from so many rows on, or from a HOT_KEYS-th of all rows, whichever is more: HOT_KEYS keys at most are hot.
HOT_ROWS, HOT_KEYS = 2048, 50_000
#: Buckets of more nodes than MERGED become one with those they share most nodes with, where that deals fewer rows. Buckets of
#: more than FINER blocks become finer ones: below, each node is dealt less often than it would have finer keys.
MERGED, FINER = 64, 16
#: Keys of large buckets are broadcast up to so many (8 bytes each).
BROADCAST_KEYS = 500_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """``rows`` joined with ``facts``, one row for each ``key``, whose ``count`` column says how many of ``rows`` have it.

    Facts of hot keys are broadcast, HOT_KEYS of them at most, and their rows stay where they are; the others are shuffled,
    so that no task gets more than HOT_ROWS rows, or a HOT_KEYS-th of all, for one key. ``rows`` are read twice.
    """
    total = facts.agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot, cold = F.broadcast(facts.where(F.col(count) >= least)), facts.where(F.col(count) < least)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for the nodes of ``links`` (a, b), comp the smallest node reachable; alternating large and small stars.

    Each round is two shuffles of at most the number of links; rounds grow with the logarithm of a component's diameter.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        return both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        return (
            down.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    last = state(edges)
    for _ in range(max_rounds):
        before, edges = edges, materialize(small(large(edges)), "stars")
        release(before)
        now = state(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components didn't settle")
    return hold(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b"), F.col("b")).distinct()), edges)


def linked_classes(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    residual_links: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, comp) of the graph whose links are the verified pairs among those that share a bucket.

    ``members``: (key, node, kind), already restricted to keys with two nodes or more; kind has bit 1 for nodes that a
    bucket offers and bit 2 for nodes that look it up, a pair needs one of either. ``verify``: pairs (a, b) -> those that
    are links. First every bucket's smallest offered and smallest looking node meet the bucket's other nodes: pairs as
    many as members. A bucket of two nodes, or one all of whose nodes are then in one component, can add nothing. ``residual_links`` gets the
    others, as (key, node, kind, comp, part, part_a, part_b), dealt into blocks of bounded size, and returns enough links
    between different components: those that join what the links of a block join. Between them these two steps miss no
    component.

    A group of near but unlinked nodes fills many buckets with mostly the same nodes, so overlapping buckets first become one
    (``_merged``). ``refine``, if given, gets those of more than FINER blocks among what is left, and returns them as (key, node,
    kind) of finer buckets in which all their links share a key too: these go through the same steps first, so that blocks are
    made only of what two levels of buckets leave.
    """
    links, comps = _hub_links(members, verify, None)
    left = _merged(_split_buckets(members, comps))
    read = [links, comps, left]
    if refine is not None:
        large = F.col("n") > FINER * BLOCK
        if not left.where(large).isEmpty():
            finer = materialize(refine(left.where(large).select("key", "node", "kind")), "finer")
            coarse = left.where(~large).select("key", "node", "kind")
            links, comps = _hub_links(finer, verify, links)
            left = _merged(_split_buckets(finer.union(coarse), comps))
            read += [finer, links, comps, left]
    left = left.withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = left.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "node", "kind", "comp", "part", F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"))
    more = materialize(residual_links(dealt).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    out = connected_components(links.union(more))
    release(more, *read)
    return out


def join_keys(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose key is among ``keys`` (or isn't, or joined with them), which are broadcast up to BROADCAST_KEYS of them, else shuffled."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return rows.join(F.broadcast(keys) if few else keys, "key", how)


def _hub_links(members: DataFrame, verify: Callable[[DataFrame], DataFrame], known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Links of each bucket's nodes with its hubs, added to the known ones, and components by all of them."""
    offered = F.when(F.col("kind").bitwiseAND(1) > 0, F.col("node"))
    looking = F.when(F.col("kind").bitwiseAND(2) > 0, F.col("node"))
    hubs = members.groupBy("key").agg(F.min(offered).alias("hub1"), F.min(looking).alias("hub2"))
    first = members.join(hubs, "key").select(
        F.explode(F.array(F.when(F.col("kind").bitwiseAND(2) > 0, F.col("hub1")), F.when(F.col("kind").bitwiseAND(1) > 0, F.col("hub2")))).alias("hub"), "node"
    )
    pair = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    tried = materialize(pair(first, "hub", "node"), "tried")
    own = materialize(verify(tried), "links")
    release(tried)
    links = own if known is None else hold(own.union(known), own, known)
    return links, connected_components(links)


def _split_buckets(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, kind, comp, n) of the buckets, of n nodes, that hold several components and can add a link; nodes without a link are their own."""
    labelled = members.join(comps, "node", "left").select("key", "node", "kind", F.coalesce("comp", "node").alias("comp"))
    split = labelled.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n")).where("c1 <> c2 and n > 2")
    return materialize(labelled.join(split.select("key", "n"), "key"), "left")


def _merged(left: DataFrame) -> DataFrame:
    """``left`` (key, node, kind, comp, n) with overlapping buckets as one: each pair that shared a bucket still does.

    Every bucket of more than MERGED nodes joins the one that is the largest for most of its nodes, if that are a quarter of them.
    Buckets so connected become one under one of their keys, unless that deals no fewer rows into blocks than they do.
    """
    large = left.where(F.col("n") > MERGED)
    if large.isEmpty():
        return left
    home = large.groupBy("node").agg(F.max(F.struct("n", "key")).alias("home")).select("node", F.col("home.key").alias("home"))
    share = large.join(home, "node").groupBy("key", "n", "home").agg(F.count("*").alias("many"))
    most = share.groupBy("key", "n").agg(F.max(F.struct("many", "home")).alias("m"))
    edges = most.where("m.many * 4 >= n and m.home <> key").select(F.col("key").alias("a"), F.col("m.home").alias("b"))
    roots = connected_components(edges)
    dealt = F.col("n") * F.ceil(F.col("n") / BLOCK)
    root = roots.select(F.col("node").alias("key"), F.col("comp").alias("root"))
    whole = join_keys(large, root, "inner").groupBy("root", "node").agg(F.bit_or("kind").alias("kind"), F.first("comp").alias("comp"))
    whole = materialize(whole.select(F.col("root").alias("key"), "node", "kind", "comp"), "whole")
    apart = large.select("key", "n").distinct().join(root, "key").groupBy("root").agg(F.sum(dealt).alias("apart"))
    fewer = whole.groupBy("key").agg(F.count("*").alias("n")).join(apart.withColumnRenamed("root", "key"), "key").where(dealt < F.col("apart")).select("key", "n")
    fewer = materialize(fewer, "fewer")
    gone = root.join(fewer.select(F.col("key").alias("root")), "root").select("key")
    out = materialize(join_keys(left, gone, "left_anti").union(join_keys(whole, fewer, "inner").select(*left.columns)), "left")
    release(left, roots, whole, fewer)
    return out


def in_blocks(rows: DataFrame, compare: Callable[[dict[str, np.ndarray], int, int], list[tuple]], schema: str) -> DataFrame:
    """The tuples that ``compare(columns, first, last)`` gives for each (key, part_a, part_b) block of ``rows``.

    Blocks stream through sorted partitions, many to a batch: most hold a few rows, none more than two parts of a bucket.
    """
    by = ["key", "part_a", "part_b"]
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for part in itertools.chain(parts, [None]):
            rows_ = held if part is None else part if held is None else pd.concat([held, part], ignore_index=True)
            if rows_ is None or not len(rows_):
                continue
            ids = rows_[by].to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]).any(axis=1), [True])))
            if part is not None:  # the last block may go on in the next batch
                held = rows_.iloc[edges[-2] :].reset_index(drop=True)
                edges = edges[:-1]
            columns = {c: rows_[c].to_numpy() for c in rows_.columns}
            out = [x for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) for x in compare(columns, a, b)]
            if out:
                yield pd.DataFrame(out, columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by).mapInPandas(run, schema)
