"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents are dealt into blocks of a random permutation (a hash of ``doc_id``). A source's target
fixes how often its blocks are used: so many whole passes, then blocks in permuted order until the target is met; the
block on the boundary gives only its first documents. The exact block counts of all sources are then split over the
output shards: at each node of a binary tree the left half draws its blocks without replacement from the node's
(a multivariate hypergeometric draw), so each shard's composition is that of a random shuffle of all blocks while every
quota is met exactly. A shard takes disjoint runs of each source's permuted blocks and shuffles its rows locally.

The tree works on GROUPS hash groups of sources: their totals meet on the driver, and inside each group a task draws the
sources' blocks for each shard from what is left, which has the same distribution. Any number of sources is weighed; targets
come from running totals over ranges of the table of sources.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated rows
(equal doc_id, source and size, also null) are numbered and planned one by one, so a source of one id only meets its target
like any other; empty tables give no rows; other columns pass through ``mix``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.columns import set_aside
from tallyloom.llm.ranks import identity, meet_places, number_peers, running_totals
from tallyloom.plans.lineage import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE, MAX_EPOCHS = 1.5, 2
ROWS_PER_BLOCK, BLOCKS_PER_GROUP = 64, 4096
GROUPS = 1024
#: Up to so many sources their table is broadcast; beyond it the join is shuffled.
BROADCAST_SOURCES = 100_000
SEED = 20_240_607


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``weight`` and ``target`` to a table of ``source, source_size``.

    The cap is met by water filling: sources in order of cap per weight; one is capped if the level that the ones not
    yet capped would share reaches its cap.
    """
    by_name = F.col("source").asc_nulls_last()
    ranked = running_totals(sources, [by_name], {"rank": F.lit(1)}).withColumn(
        "weight", F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    ranked = ranked.drop("rank").withColumn("cap", (F.col("source_size") * max_epochs).cast("long"))
    levels = running_totals(ranked, [F.col("cap") / F.col("weight"), by_name], {"k": F.lit(1), "caps": F.col("cap"), "weights": F.col("weight")})
    words, weight = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(share * (words or 0)) - F.col("caps")) / (F.lit(weight or 1) - F.col("weights"))
    levels = levels.withColumn("level", level)
    free = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("k"))
    settled = levels.agg(F.min_by("level", free)).first()[0]
    cap = F.col("cap").cast("double")
    target = cap if settled is None else F.least(cap, F.lit(float(settled)) * F.col("weight"))
    return levels.withColumn("target", target).drop("cap", "level", "k", "caps", "weights")


def splitting_tree(blocks: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns); every row sums to the source's blocks."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(blocks), n_shards), np.int64)
    nodes = [(0, n_shards, np.asarray(blocks, np.int64))]
    while nodes:
        low, high, counts = nodes.pop()
        if high - low == 1:
            out[:, low] = counts
            continue
        middle = (low + high) // 2
        take = int(counts.sum()) * (middle - low) // (high - low)
        left = rng.multivariate_hypergeometric(counts, take, method="marginals")
        nodes += [(middle, high, counts - left), (low, middle, left)]
    return out


def plan_mix(slim: DataFrame, n_shards: int = 8, seed: int = SEED, rows_per_block: int = ROWS_PER_BLOCK, **targets) -> DataFrame:
    """Add ``peer, source_size, target, passes, shards`` to rows with ``doc_id, source, size``, which must be materialised.

    ``peer`` numbers rows that agree in these; ``passes`` is how often the row is taken; ``shards`` names the output shard
    of each time.
    """
    n_rows = slim.count()
    rows_per_block = max(rows_per_block, n_rows // 200_000_000)
    keyed = number_peers(slim, ["source", "doc_id", "size"]).withColumn("_s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    keyed = cut_lineage(keyed)
    sources = keyed.groupBy("source", "_s").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    sources = cut_lineage(
        with_targets(sources, **targets)
        .withColumn("n_blocks", F.ceil(F.col("rows") / rows_per_block))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("extra", F.col("target") - F.col("epochs") * F.col("source_size"))
        .drop("rows", "weight")
    )
    few = sources.count() <= BROADCAST_SOURCES
    small = F.broadcast(sources.drop("source")) if few else sources.drop("source")
    order = F.xxhash64(F.lit(seed), "doc_id", "size", "peer")
    dealt = keyed.join(small, "_s").withColumn("_order", order).withColumn("block", F.pmod("_order", "n_blocks"))
    dealt = dealt.withColumn("_group", (F.col("block") / BLOCKS_PER_GROUP).cast("long"))

    blocks = dealt.groupBy("_s", "_group", "block").agg(F.sum("size").alias("words"))
    groups = blocks.groupBy("_s", "_group").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    over = lambda *keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    groups = groups.select(
        "_s", "_group",
        F.coalesce(F.sum("words").over(over("_s", by="_group")), zero).alias("group_w0"),
        F.coalesce(F.sum("n").over(over("_s", by="_group")), zero).alias("group_n0"),
    )
    in_group = over("_s", "_group", by="block")
    blocks = cut_lineage(
        blocks.join(groups, ["_s", "_group"]).select(
            "_s", "_group", "block", "words",
            (F.coalesce(F.sum("words").over(in_group), zero) + F.col("group_w0")).alias("block_w0"),
            (F.row_number().over(Window.partitionBy("_s", "_group").orderBy("block")) - 1 + F.col("group_n0")).alias("ordinal"),
        )
    )
    used = (
        blocks.join(small, "_s")
        .groupBy("_s")
        .agg(F.count("*").alias("n"), F.count_if(F.col("block_w0") < F.col("extra")).alias("part"), F.first("epochs").alias("epochs"))
        .select("_s", "n", (F.col("epochs") * F.col("n") + F.col("part")).alias("quota"), F.pmod(F.xxhash64("_s"), F.lit(GROUPS)).alias("_g"))
    )
    used = cut_lineage(used)
    ends = used.groupBy("_g").applyInPandas(_source_ends(_group_quotas(used, n_shards, seed), seed), "_s string, _n long, _ends array<long>")
    ends = cut_lineage(ends)
    row = Window.partitionBy("_s", "block").orderBy("_order", "doc_id", "size", "peer").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum("size").over(row) - F.col("size") + F.col("block_w0")
    again = (start + F.col("size") / 2 <= F.col("extra")) & (F.col("extra") > 0) & (F.col("size") > 0)
    placed = (
        dealt.join(blocks.select("_s", "block", "block_w0", "ordinal"), ["_s", "block"])
        .withColumn("passes", F.when(F.col("size") > 0, F.col("epochs") + again.cast("int")).otherwise(0))
        .join(F.broadcast(ends) if few else ends, "_s")
    )
    shards = F.expr("transform(sequence(0, passes - 1), p -> size(filter(_ends, e -> e <= p * _n + ordinal)))")
    return placed.withColumn("shards", F.when(F.col("passes") > 0, shards).otherwise(F.lit([]).cast("array<int>"))).select(
        *slim.columns, "peer", "source_size", "target", "passes", "shards"
    )


def _group_quotas(used: DataFrame, n_shards: int, seed: int) -> dict[int, np.ndarray]:
    """Blocks of each group of sources for each shard."""
    totals = used.groupBy("_g").agg(F.sum("quota").alias("quota")).orderBy("_g").collect()  # at most GROUPS rows
    quotas = splitting_tree(np.array([r["quota"] for r in totals], np.int64), n_shards, seed)
    return {r["_g"]: q for r, q in zip(totals, quotas, strict=True)}


def _source_ends(quotas: dict[int, np.ndarray], seed: int):
    """For each source of a group, how many of its blocks go to the first shard, the first two, and so on."""

    def run(key: tuple, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("_s", key=lambda s: s.map(str.encode))
        rng, left, taken = np.random.default_rng([seed, int(key[0])]), sources["quota"].to_numpy(np.int64), []
        for share in quotas[int(key[0])].tolist():
            drawn = rng.multivariate_hypergeometric(left, share, method="marginals")
            left = left - drawn
            taken.append(drawn)
        return pd.DataFrame({"_s": sources["_s"], "_n": sources["n"], "_ends": list(np.cumsum(np.stack(taken, axis=1), axis=1))})

    return run


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, n_shards: int = 8, seed: int = SEED) -> DataFrame:
    """The mixture itself: a row for each time a document is taken, with ``mix_shard`` and ``mix_order``.

    ``write_mix`` stores it by shard, each shard in ``mix_order``.
    """
    rows, restore = set_aside(docs.drop("mix_shard", "mix_order"), ("doc_id", "source", "text"))
    rows = rows.withColumns(identity(rows))
    slim = cut_lineage(rows.select("doc_id", "source", word_count().alias("size"), "__k1", "__k2"))
    plan = plan_mix(slim, n_shards, seed).where("passes > 0").select("__k1", "__k2", "peer", "shards")
    taken = meet_places(rows, plan, F.struct("peer", "shards")).select("*", F.posexplode("place.shards").alias("pass", "mix_shard"))
    return restore(taken.withColumn("mix_order", F.xxhash64(F.lit(seed + 1), "doc_id", "__k1", "place.peer", "pass")), "mix_shard", "mix_order")


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows by shard, each shard in its shuffled order."""
    return mixed.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def write_mix(mixed: DataFrame, path: str) -> None:
    """One folder a shard, each in its shuffled order; large shards may hold several files, in order."""
    in_mixed_order(mixed).write.partitionBy("mix_shard").parquet(path)


def op7_mixing(docs: DataFrame) -> DataFrame:
    slim = cut_lineage(docs.select("doc_id", "source", word_count().alias("size")))
    return plan_mix(slim).select(
        "doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).cast("long").alias("taken"), "shards"
    )
