"""Connected components of a links table, by contraction; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _shortened(parents: DataFrame) -> DataFrame:
    """Pointer jumping until every ``p`` is a root; a root is its own parent or has none."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("higher"))
        parents = cut(parents.join(up, "p", "left").select("v", F.coalesce("higher", "p").alias("p"), (F.col("higher") < F.col("p")).alias("moved")))
        if parents.where("moved").isEmpty():
            return parents.select("v", "p")


def components(links: DataFrame) -> DataFrame:
    """(v, c) for every vertex of ``links`` (a, b): c is the smallest vertex reachable from v.

    Each round points every vertex at its smallest neighbour, shortens the chains and contracts
    the links to their roots, so the vertices at least halve. Links of a vertex with itself are
    ignored; an empty table has no vertices. A vertex with very many links is aggregated
    map-side and its joins are plain equi-joins, which adaptive execution splits.
    """
    links = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found: DataFrame | None = None
    while not links.isEmpty():
        ends = links.union(links.select("b", "a")).toDF("v", "w")
        roots = _shortened(cut(ends.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p"))))
        up = roots.select(F.col("v").alias("c"), F.col("p").alias("higher"))
        found = roots.withColumnRenamed("p", "c") if found is None else cut(found.join(up, "c", "left").select("v", F.coalesce("higher", "c").alias("c")))
        of_a = roots.select(F.col("v").alias("a"), F.col("p").alias("ra"))
        of_b = roots.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        contracted = links.join(of_a, "a").join(of_b, "b").where("ra != rb")
        links = cut(contracted.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return found if found is not None else links.toDF("v", "c")
