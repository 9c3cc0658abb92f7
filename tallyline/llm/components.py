"""Connected components of a link table by randomised contraction.

Each round every node joins the neighbour (or itself) with the least hash of
that round; links are redrawn between the chosen nodes and those inside one
node vanish. A constant share of the nodes vanishes per round whatever the
shape of the graph, chains included. Every round is a partial aggregate and
two joins of written tables: no node's neighbours are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import col, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns a, b): nodes
    of one component share their root, which is one of them."""
    both = links.select("a", "b").unionAll(links.select(col("b").alias("a"), col("a").alias("b")))
    live = written(both.filter("a != b").distinct(), "cc-links")
    chosen = []
    while not live.isEmpty():
        turn = F.lit(len(chosen))
        own = F.struct(F.xxhash64("a", turn).alias("h"), col("a").alias("id"))
        best = live.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), col("b").alias("id"))).alias("best"))
        best = written(best.select(col("a").alias("node"), F.least(own, col("best"))["id"].alias("root")), "cc-chosen")
        chosen.append(best)
        left = best.select(col("node").alias("a"), col("root").alias("ra"))
        right = best.select(col("node").alias("b"), col("root").alias("rb"))
        live = written(live.join(left, "a").join(right, "b").filter("ra != rb")
                       .select(col("ra").alias("a"), col("rb").alias("b")).distinct(), "cc-links")
    if not chosen:
        return live.select(col("a").alias("node"), col("b").alias("root"))
    out = chosen[0]
    for later in chosen[1:]:
        step = later.select(col("node").alias("root"), col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return written(out, "cc-roots")
