"""Closure of parent tables: every ancestor of every node, by path doubling.

A node has one parent at most (of several, the least by name). Each round joins what is known with itself and doubles the length
of the steps known, so rounds are the logarithm of the depth. A hot ancestor is split as a skewed join is, since each of its
rows finds one row on the other side.

Null nodes are ignored; a null or missing parent ends a branch; repeated rows count once. In a cycle there is no top: each node on
it has the others as ancestors, and the branch is cut where it would come back to the node itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop


def closure(tree: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """ancestor, descendant, depth (steps between them, 1 or more)."""
    up = tree.where(F.col(node).isNotNull() & F.col(parent).isNotNull() & (F.col(node) != F.col(parent))).groupBy(F.col(node).alias("descendant")).agg(F.min(parent).alias("ancestor"))
    # jump: where 2**k steps lead; known: all ancestors within less than 2**k steps.
    jump = cut(up)
    known = cut(jump.select("descendant", "ancestor", F.lit(1).alias("depth")))
    steps = 1
    while True:
        far = jump.select(F.col("descendant").alias("d"), F.col("ancestor").alias("via")).join(known.select(F.col("descendant").alias("via"), "ancestor", "depth"), "via")
        longer = far.select(F.col("d").alias("descendant"), "ancestor", (F.col("depth") + steps).alias("depth"))
        both = known.union(longer).where("ancestor != descendant").groupBy("descendant", "ancestor").agg(F.min("depth").alias("depth"))
        after = cut(both)
        grown = after.count() > known.count()
        drop(known)
        known = after
        if not grown:
            drop(jump)
            return known.select("ancestor", "descendant", "depth")
        twice = jump.select("descendant", F.col("ancestor").alias("via")).join(jump.select(F.col("descendant").alias("via"), "ancestor"), "via").select("descendant", "ancestor")
        jump, old = cut(twice), jump
        drop(old)
        steps *= 2


def subtree_counts(links: DataFrame) -> DataFrame:
    """node, n_children, n_descendants, height of every ancestor of a closure."""
    return links.groupBy(F.col("ancestor").alias("node")).agg(F.count_if(F.col("depth") == 1).alias("n_children"), F.count("*").alias("n_descendants"), F.max("depth").alias("height"))
