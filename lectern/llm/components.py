"""Connected components over a table of links, without collecting any of it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_settled, settle


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Returns (node, component) for every node of ``links``; component is the smallest node reachable.

    Hook and compress: every round looks up both ends' roots, hooks the larger root to the smallest neighbouring one
    (a partial aggregation), then halves the paths among the hooked roots until they are flat. All joins are on
    settled tables, so a component of any size is split by adaptive execution rather than met by one task. Links with
    a null end and loops are ignored; repeated links do no harm. An empty table gives an empty result.
    """
    ends = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges = settle(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    # the first hook needs no look-up: every node is its own root
    hooks = edges.groupBy(F.col("a").alias("hi")).agg(F.min("b").alias("lo"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    roots = None
    for _ in range(max_rounds):
        flat = _flatten(settle(hooks, "hooks"))
        if roots is None:
            step = settle(nodes, "nodes").join(flat, F.col("node") == F.col("hi"), "left")
            new = settle(step.select("node", F.coalesce("lo", "node").alias("root")), "roots")
        else:
            step = roots.join(flat, F.col("root") == F.col("hi"), "left")
            new = settle(step.select("node", F.coalesce("lo", "root").alias("root")), "roots")
            drop_settled(roots)
        roots = new
        at = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        bt = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = settle(edges.join(at, "a").select("b", "ra").join(bt, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("hi"), F.least("ra", "rb").alias("lo")), "across")
        if across.isEmpty():
            return roots.select("node", F.col("root").alias("component"))
        hooks = across.groupBy("hi").agg(F.min("lo").alias("lo"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _flatten(hooks: DataFrame) -> DataFrame:
    """Every hook (hi, lo) with lo replaced by the end of its chain; lo < hi always, so chains end."""
    while True:
        nxt = hooks.select(F.col("hi").alias("mid"), F.col("lo").alias("end"))
        step = settle(hooks.join(nxt, F.col("lo") == F.col("mid"), "left").select("hi", F.coalesce("end", "lo").alias("lo"), F.col("end").isNotNull().alias("moved")), "hooks")
        drop_settled(hooks)
        hooks = step.select("hi", "lo")
        if step.where("moved").isEmpty():
            return hooks
