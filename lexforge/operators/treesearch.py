"""Tree search over sub-questions for many questions at once: a table of nodes, a round of it for all of them.

A round walks from each root to the leaf of best upper confidence, opens it where it was seen before, scores the node it
came to, and adds the score to that node and all above it. How a question falls apart, how a sub-question does, and
what a node is worth are columns that are given. A question stops when its best branch is good enough.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.scoring import ucb1
from lexforge.session import written

#: A node's path is its children's numbers from the root on, one sign each; more children than these signs are not made.
SIGNS = "0123456789abcdefghijklmnopqrstuvwxyz"


def _children(parts: DataFrame, most: int) -> DataFrame:
    """root, path, depth, question of the first ``most`` parts of ``parts(root, path, depth, parts)``."""
    rows = parts.select("root", "path", "depth", F.posexplode(F.slice("parts", 1, most)).alias("k", "question"))
    return rows.select("root", F.concat("path", F.substring(F.lit(SIGNS), F.col("k") + 1, F.lit(1))).alias("path"), (F.col("depth") + 1).alias("depth"), "question", F.lit(0).cast("bigint").alias("visits"), F.lit(0.0).alias("total"))


def search(
    roots: DataFrame,
    decompose: Callable[[Column], Column],
    refine: Callable[[Column], Column],
    reward: Callable[[Column], Column],
    rounds: int = 15,
    depth: int = 3,
    issues: int = 5,
    branches: int = 3,
    enough: float = 0.8,
    c: float = 1.414,
) -> DataFrame:
    """root, path, depth, question, visits, total of every node after ``rounds``.

    ``roots(root, question, ...)`` has one row a question; ``decompose`` and ``refine`` turn a question into an array of
    sub-questions, ``reward`` a question into its worth, with the other columns of ``roots`` at hand. Ties go to the
    first child. A root ends early at ten visits when its best child has five and a mean of ``enough``.
    """
    roots = written(roots.where("root is not null"))
    extra = [x for x in roots.columns if x not in ("root", "question")]
    top = roots.select("root", F.lit("").alias("path"), F.lit(0).alias("depth"), "question", F.lit(0).cast("bigint").alias("visits"), F.lit(0.0).alias("total"))
    parts = decompose(F.col("question"))
    first = roots.select("root", F.lit("").alias("path"), F.lit(0).alias("depth"), F.when(F.size(parts) > 0, parts).otherwise(F.array("question")).alias("parts"))
    nodes = written(top.unionByName(_children(first, issues)))
    up = lambda p: F.left(p, F.length(p) - 1)
    going = nodes.where("path = ''").select("root")
    for _ in range(rounds):
        live = nodes.join(going, "root", "left_semi")
        kids = live.where("path != ''").withColumn("parent", up(F.col("path")))
        above = live.select("root", F.col("path").alias("parent"), F.col("visits").alias("seen"))
        rated = kids.join(above, ["root", "parent"]).select("root", "parent", "path", ucb1(F.col("total"), F.col("visits"), F.col("seen"), c).alias("u"))
        best = written(rated.groupBy("root", F.col("parent").alias("path")).agg(F.min(F.struct((-F.col("u")).alias("u"), F.col("path").alias("p"))).getField("p").alias("next")))
        at = going.select("root", F.lit("").alias("path"))
        for _ in range(depth):
            at = at.join(best, ["root", "path"], "left").select("root", F.coalesce("next", "path").alias("path"))
        chosen = written(at.join(nodes, ["root", "path"]))
        opened = chosen.where((F.col("depth") < depth) & (F.col("visits") > 0)).select("root", "path", "depth", refine(F.col("question")).alias("parts"))
        fresh = written(_children(opened, branches))
        step = fresh.groupBy("root").agg(F.min(F.struct("path", "question")).alias("n"))
        target = chosen.join(step, "root", "left").select("root", F.coalesce("n.path", "path").alias("path"), F.coalesce("n.question", "question").alias("question"))
        worth = target.join(roots.select("root", *extra), "root").select("root", "path", reward(F.col("question")).alias("r"))
        ups = worth.select("root", "r", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.left(F.col("path"), n))).alias("path"))
        nodes = nodes.unionByName(fresh).join(ups, ["root", "path"], "left")
        nodes = written(nodes.select("root", "path", "depth", "question", (F.col("visits") + F.when(F.col("r").isNull(), 0).otherwise(1)).alias("visits"), (F.col("total") + F.coalesce("r", F.lit(0.0))).alias("total")))
        mean = F.when(F.col("visits") > 0, F.col("total") / F.col("visits")).otherwise(0.0)
        lead = nodes.where("depth = 1").groupBy("root").agg(F.min(F.struct((-mean).alias("m"), "path", "visits")).alias("b"))
        seen = nodes.where("path = ''").select("root", F.col("visits").alias("seen"))
        over = lead.join(seen, "root").where((F.col("seen") >= 10) & (F.col("b.visits") >= 5) & (-F.col("b.m") >= enough)).select("root")
        going = written(going.join(over, "root", "left_anti"))
        if going.isEmpty():
            break
    return nodes


def best_path(nodes: DataFrame, depth: int = 3) -> DataFrame:
    """root, path, depth, question, visits, mean along the children of best mean, as far as any was visited."""
    held = nodes.where("visits > 0").withColumn("mean", F.col("total") / F.col("visits"))
    parent = F.left("path", F.length("path") - 1)
    best = written(held.where("path != ''").groupBy("root", parent.alias("parent")).agg(F.min(F.struct((-F.col("mean")).alias("m"), F.col("path").alias("p"))).getField("p").alias("path")))
    step = held.where("path = ''").select("root", "path")
    kept = step
    for _ in range(depth):
        step = best.join(step.withColumnRenamed("path", "parent"), ["root", "parent"]).select("root", "path")
        kept = kept.unionByName(step)
    return held.join(kept, ["root", "path"]).select("root", "path", "depth", "question", "visits", "mean")
