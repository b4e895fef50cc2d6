"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the same for all nodes of a component.

    Each round points every node at its smallest neighbour and contracts the links, so the number of
    nodes falls by a constant factor per round when node ids are digests (a random order).  Nothing
    is gathered: a round is one aggregation and two joins.  Rows with a = b or a null end link nothing.
    """
    e = scratch.put(
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    kind = links.schema["a"].dataType
    roots: DataFrame | None = None
    while not e.isEmpty():
        ends = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        step = scratch.put(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        last, e = e, scratch.put(
            e.join(left, "a")
            .join(right, "b")
            .where(F.col("ra") != F.col("rb"))
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        scratch.drop(last)
        if roots is None:
            roots = step.toDF("node", "root")
        else:
            nxt = step.toDF("root", "to")
            roots = scratch.put(
                roots.join(nxt, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            )
            scratch.drop(step)
    if roots is None:
        return scratch.spark.createDataFrame([], "node string, root string").select(
            F.col("node").cast(kind), F.col("root").cast(kind)
        )
    return roots
