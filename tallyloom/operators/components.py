"""Connected components of an edge list by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import cut_lineage


def connected_components(edges: DataFrame) -> DataFrame:
    """Return ``node, component`` for every endpoint; the component is its least node.

    ``edges`` has two columns, ``a`` and ``b``, of one orderable type; self loops only add their node.
    Each round links all neighbours of a node to the least one (large star, then small star), which
    halves path lengths and keeps the edge count linear. Rounds stop when nothing changes.
    """
    clean = edges.select("a", "b").where("a is not null and b is not null")
    nodes = clean.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    current = cut_lineage(
        clean.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    previous, n_edges = None, current.count()
    while n_edges:
        large = cut_lineage(_star(current.union(current.select("b", "a")), 2 * n_edges, larger_only=True))
        current = cut_lineage(_star(large, n_edges, larger_only=False))
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == previous:
            break
        previous, n_edges = now, now[0]
    roots = current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


#: A hub of more neighbours than this, and than one in MOST_HEAVY edges, is joined by broadcast: there are at most
#: MOST_HEAVY of them, and no task gets more edges of one hub by the shuffled join.
HEAVY, MOST_HEAVY = 1000, 100_000


def _star(pairs: DataFrame, n_pairs: int, larger_only: bool) -> DataFrame:
    """Point each node's neighbours at the least of the node and its neighbours; ``n_pairs`` is a bound of the rows.

    The least neighbour comes from a map-side combined aggregate. It goes back to the edges of ordinary hubs by a
    shuffled join and to those of large hubs by a broadcast one, so no hub's edges meet in one task.
    """
    least = pairs.groupBy("a").agg(F.min("b").alias("least_b"), F.count("*").alias("n")).select(
        F.col("a").alias("hub"), F.least("a", "least_b").alias("least"), "n"
    )
    heavy = least.where(F.col("n") > max(HEAVY, n_pairs // MOST_HEAVY)).select(F.col("hub").alias("heavy_hub"), F.col("least").alias("heavy_least"))
    marked = pairs.join(F.broadcast(heavy), F.col("a") == F.col("heavy_hub"), "left")
    ordinary = marked.where("heavy_hub is null").select("a", "b").join(least, F.col("a") == F.col("hub")).select("a", "b", "least")
    linked = ordinary.union(marked.where("heavy_hub is not null").select("a", "b", "heavy_least"))
    if larger_only:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("least").alias("b")).union(
            least.select(F.col("hub").alias("a"), F.col("least").alias("b"))
        )
    return out.where("a <> b").distinct()
