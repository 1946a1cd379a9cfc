"""Evidence ledgers: a claim's label from its parts, and three-valued trees of parts of any depth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialize, release

MOST_CITATIONS, MOST_DEPTH = 4, 64


def claim_labels(parts: DataFrame, claim: str = "claim_id", most: int = MOST_CITATIONS) -> DataFrame:
    """(claim, label, evidence_ids, n_parts, reason) of claims whose parts were each checked.

    parts: (claim, part, relation: entails, refutes or unresolved, evidence_ids, disjunction). A conjunction is refuted by its
    first refuted part and supported if all parts are entailed; a disjunction of several parts decides nothing. evidence_ids are
    the deciding parts' distinct ones, in order; more than ``most`` leave the claim open (too_many_citations).
    """
    per = parts.groupBy(claim).agg(F.array_sort(F.collect_list(F.struct("part", "relation", "evidence_ids"))).alias("ps"), F.bool_or("disjunction").alias("either"))
    refuting = F.filter("ps", lambda p: p["relation"] == "refutes")
    alone = ~F.col("either") | (F.size("ps") == 1)
    label = F.when((F.size(refuting) > 0) & alone, "contradict").when(F.forall("ps", lambda p: p["relation"] == "entails") & alone, "support").otherwise("not_enough_info")
    per = per.withColumn("label", label).withColumn("by", F.when(F.col("label") == "contradict", F.slice(refuting, 1, 1)).when(F.col("label") == "support", F.col("ps")).otherwise(F.slice("ps", 1, 0)))
    per = per.withColumn("ids", F.array_distinct(F.flatten(F.transform("by", lambda p: p["evidence_ids"]))))
    over = F.size("ids") > most
    return per.select(
        claim, F.when(over, "not_enough_info").otherwise(F.col("label")).alias("label"), F.when(over, F.slice("ids", 1, 0)).otherwise(F.col("ids")).alias("evidence_ids"), F.size("ps").alias("n_parts"), F.when(over, "too_many_citations").alias("reason")
    )


def evaluate_trees(nodes: DataFrame, observations: DataFrame, tree: str = "tree", most_depth: int = MOST_DEPTH) -> DataFrame:
    """(tree, node, depth, truth, known, leaves): the three-valued truth of every node that its tree's root reaches.

    nodes: (tree, node, parent: null for the root, op: and, or, leaf; negated: whether the node's truth is turned round);
    observations: (tree, node, truth) of leaves, those that disagree count as none. AND is false by one false child, true if all
    are true, else null; OR the other way round; a node without children has its observation's truth. known and leaves count
    observed and all leaves below. One level at a time, from the deepest; a level is one join and one aggregation, which sums up
    children before they are shuffled. Trees deeper than ``most_depth`` raise an error; nodes outside (cycles, lost parents)
    are left out.
    """
    held = materialize(nodes.select(tree, "node", "parent", "op", F.coalesce("negated", F.lit(False)).alias("negated")), "nodes")
    levels = [materialize(held.where("parent is null").withColumn("depth", F.lit(0)), "level")]
    while not levels[-1].isEmpty():
        if len(levels) > most_depth:
            release(held, *levels)
            raise ValueError(f"a tree is deeper than {most_depth}")
        above = levels[-1].select(tree, F.col("node").alias("parent"))
        levels.append(materialize(held.where("parent is not null").join(above, [tree, "parent"]).withColumn("depth", F.lit(len(levels))), "level"))
    seen = observations.groupBy(tree, "node").agg(F.when(F.min("truth") == F.max("truth"), F.min("truth")).alias("seen"))
    done, below = None, None
    for level in reversed(levels[:-1]):
        rows = level.join(seen, [tree, "node"], "left")
        if below is not None:
            kids = below.groupBy(tree, F.col("parent").alias("node")).agg(
                F.count("*").alias("n"), F.count_if("truth").alias("yes"), F.count_if(~F.col("truth")).alias("no"), F.sum("known").alias("k"), F.sum("leaves").alias("l")
            )
            rows = rows.join(kids, [tree, "node"], "left")
        else:
            rows = rows.withColumns({c: F.lit(None).cast("long") for c in ("n", "yes", "no", "k", "l")})
        joint = F.when(F.col("op") == "or", F.when(F.col("yes") > 0, True).when(F.col("no") == F.col("n"), False)).otherwise(F.when(F.col("no") > 0, False).when(F.col("yes") == F.col("n"), True))
        truth = F.when(F.col("n").isNull(), F.col("seen")).otherwise(joint)
        known = F.coalesce("k", F.col("seen").isNotNull().cast("long"))
        below = materialize(rows.select(tree, "node", "parent", "depth", F.when(F.col("negated"), ~truth).otherwise(truth).alias("truth"), known.alias("known"), F.coalesce("l", F.lit(1).cast("long")).alias("leaves")), "truths")
        done = below if done is None else done.unionByName(below)
    release(held, *levels[1:])
    if done is None:
        done = levels[0].select(tree, "node", "parent", "depth", F.lit(None).cast("boolean").alias("truth"), F.lit(0).cast("long").alias("known"), F.lit(0).cast("long").alias("leaves"))
    return done.drop("parent")
