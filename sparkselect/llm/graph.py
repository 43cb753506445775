"""Connected components of an edge table by hooking and contraction.

Each round hooks every node to its smallest neighbour, follows the hooks to their
roots and contracts the edges onto the roots, so that the edge table shrinks by at
least half of its nodes per round. Nothing is collected: a node with very many
edges only takes part in minima (combined before the shuffle) and in joins
that spread its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def _roots(parents: DataFrame) -> DataFrame:
    """(v, p) with p replaced by the root that its chain of parents ends in."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = written(spread_join(parents, up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "cc-jump")
        parents = jumped.select("v", "p")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b: long); comp is a node of the component.

    Self-loops, repeated and reversed edges do no harm; no edges give no rows.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        parents = both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p"))
        roots = _roots(written(parents, "cc-hook"))
        ra, rb = roots.select(F.col("v").alias("a"), F.col("p").alias("pa")), roots.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        edges = written(spread_join(spread_join(edges, ra, "a"), rb, "b", like=edges).where("pa <> pb")
                        .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "cc-edges")
        if labels is None:
            labels = roots.select(F.col("v").alias("node"), F.col("p").alias("comp"))
        else:
            up = roots.select(F.col("v").alias("comp"), F.col("p").alias("root"))
            labels = written(spread_join(labels, up, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "cc-labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    return labels
