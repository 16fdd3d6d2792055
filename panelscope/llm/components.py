"""Connected components of a link table: distributed union-find by rounds of
hooking and contraction.

Each round gives every node a random priority, hooks it to the neighbour (or
itself) of least priority, and replaces the links by links between hooks.
Random priorities make the graph shrink by a constant share a round whatever
the ids are (chains included). The hooks of all rounds are then composed back
and the smallest member names the component.

Hooks are minima (pre-aggregated before the shuffle), so a node with a third
of all links costs no single task more; links are looked up by joins that
adaptive execution can split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelscope.llm.common import discard, table


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node in ``links``; component: the smallest
    node reachable. Null ends and self links are ignored. Node columns may be
    of any orderable type. No links: no rows."""
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b")
    edges = table(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        seed = F.lit(len(hooks))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(seed, c).alias("p"), F.col(c).alias("n"))
        least = both.select("a", F.least(rank("a"), rank("b")).alias("r")).groupBy("a").agg(F.min("r").alias("r"))
        hook = table(least.select(F.col("a").alias("node"), F.col("r.n").alias("to")), "hooks")
        hooks.append(hook)
        left = hook.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = hook.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x != y")
        done, edges = edges, table(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        discard(done)
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("component"))
    label = hooks[0].select("node", F.col("to").alias("root"))
    for hook in hooks[1:]:
        # a root that lost its links in an earlier round stays as it is
        label = label.join(hook.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    if len(hooks) > 1:
        label = table(label, "roots")
        discard(*hooks)
    first = label.groupBy("root").agg(F.min("node").alias("component"))
    return label.join(first, "root").select("node", "component")
