"""Connected components of an edge table by repeated contraction.

In each round every vertex picks the vertex of highest priority among itself
and its neighbours; edges and assignments move to the picks.  Priorities are
hashes, so the number of vertices falls by a constant factor in expectation
and the number of rounds is logarithmic.  Nothing is collected: the driver sees
one count per round.  Tables are written to the shared folder between rounds,
which lets Spark split a hub's rows in the joins that follow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has a and b.

    Edges may repeat, go either way or be loops.  Roots are nodes of the
    component, one for each; which one is fixed by a hash of the node.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = scratch.write(both.filter("a <> b").distinct(), "edges0")
    known, held, k = None, "", 0
    while not live.isEmpty():
        prior = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)), F.col(c))  # noqa: B023, E731
        best = live.groupBy("a").agg(F.min(prior("b")).alias("p"))
        best = best.select(
            F.col("a").alias("node"), F.when(F.col("p") < prior("a"), F.col("p.b")).otherwise(F.col("a")).alias("root")
        )
        picks = scratch.write(best, f"picks{k}")
        to = lambda c: picks.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        moved = live.join(to("a"), "a").join(to("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        nxt = scratch.write(moved.filter("a <> b").distinct(), f"edges{k + 1}")
        if known is None:
            known, held = picks, f"picks{k}"
        else:
            step = picks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            known = scratch.write(
                known.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), f"known{k}"
            )
            scratch.drop(held, f"picks{k}")
            held = f"known{k}"
        scratch.drop(f"edges{k}")
        live, k = nxt, k + 1
    return known if known is not None else live.select(F.col("a").alias("node"), F.col("b").alias("root"))
