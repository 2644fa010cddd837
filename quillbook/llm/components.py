"""Connected components of an edge table, by random hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbook.llm.common import cut, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label, equal for the nodes of a component, for every node of an edge.

    Each round maps every node to the one of smallest hash (another hash each round) among itself and its neighbours, and
    goes on with the images of the edges, loops and repeats left out. That keeps components apart and together, and leaves
    a fraction of the nodes, so rounds grow with the logarithm of the size. A node with very many edges is a hot key of
    plain equi-joins, which adaptive execution splits, and is gone after a round or two.
    """
    with scratch(edges.sparkSession) as keep:
        side = lambda e, x, y: e.select(F.col(x).alias("x"), F.col(y).alias("y"))
        rest = cut(side(edges, a, b).union(side(edges, b, a)).where("x <> y").distinct(), "edges")
        maps: list[DataFrame] = []
        while not rest.isEmpty():
            order = lambda c, k=len(maps): F.struct(F.xxhash64(F.lit(k), c).alias("o"), F.col(c).alias("n"))
            hook = rest.groupBy("x").agg(F.least(F.min(order("y")), F.first(order("x")))["n"].alias("to"))
            hook = cut(hook.select(F.col("x").alias("node"), "to"), "hooks")
            half = rest.join(hook.withColumnRenamed("node", "x"), "x").select(F.col("to").alias("x"), "y").distinct()
            rest = cut(half.join(hook.withColumnRenamed("node", "y"), "y").select("x", F.col("to").alias("y")).where("x <> y").distinct(), "edges")
            maps.append(hook)
        if not maps:
            return edges.select(F.col(a).alias("node"), F.col(a).alias("label")).limit(0)
        out = maps[0].withColumnRenamed("to", "label")
        for hook in maps[1:]:
            out = out.join(hook.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        return keep(cut(out, "labels"))
