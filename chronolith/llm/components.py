"""Connected components of a table of links, by hooking and shortcutting on parent pointers.

Every vertex keeps a parent f and a grandparent g, both never larger than itself. A round hooks, over each link (u, v),
u and u's parent onto v's grandparent where that is smaller, then shortcuts g to the parent's parent. Both steps are
joins of written tables, in which hubs and roots with more than a thousandth of the rows are broadcast (join_hot), and
one minimum per vertex that is taken before the shuffle too, so that a component with a third of all vertices neither
meets in one task nor at the driver; the number of rounds grows with the logarithm of
the longest path. What comes to the driver is one row of sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import FEW, Workspace, join_hot, sized


def connected_components(links: DataFrame, work: Workspace, name: str = "components", few: int = FEW) -> DataFrame:
    """links (a long, b long) -> (v, component), one row per vertex that has a link to another vertex.

    component is the smallest vertex that can be reached. Links to itself and links with a null end count for nothing;
    repeated links do no harm; no links give no rows.
    """
    clean = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    both = clean.union(clean.select("b", "a")).toDF("u", "v")
    edges = work.write(f"{name}-edges", both)
    if not sized(edges):
        return edges.selectExpr("v", "u component").limit(0)
    state = work.write(f"{name}-0", edges.select(F.col("u").alias("v")).distinct().selectExpr("v", "v f", "v g"))
    before, n = None, 0
    while True:
        n += 1
        pointers = state
        ends = join_hot(join_hot(edges, pointers.selectExpr("v u", "f fu"), ["u"], few=few), pointers.selectExpr("v", "g gv"), ["v"], few=few)
        near = ends.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("gv").alias("f")), F.struct(F.col("fu").alias("v"), F.col("gv").alias("f")))).alias("x")).select("x.v", "x.f")
        own = pointers.selectExpr("v", "least(f, g) f")
        parents = work.write(f"{name}-p{n}", near.union(own).groupBy("v").agg(F.min("f").alias("f")))
        state = work.write(f"{name}-{n}", join_hot(parents, parents.selectExpr("v f", "f g"), ["f"], few=few).select("v", "f", "g"))
        sums = state.select(F.sum(F.col("f").cast("decimal(38,0)")).alias("f"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).first()
        work.drop(f"{name}-{n - 1}")
        work.drop(f"{name}-p{n}")
        if before == (sums.f, sums.g):  # pointers only fall, so equal sums mean that none has changed
            return state.selectExpr("v", "f component")
        before = (sums.f, sums.g)
