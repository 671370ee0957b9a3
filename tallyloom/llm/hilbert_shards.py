"""Sharding along a Hilbert curve, with DataFrame operations only.

Three metadata dimensions (language, source, text size) are quantised to 16 steps each; rows are ordered by
the Hilbert index of their cell, and the order is cut into runs of near-equal bytes. Neighbouring cells are
neighbours in all three dimensions, so a shard covers a compact box and files can be pruned on any of them.

Text dimensions are cut at quantiles of their distinct values, in byte order, alike at every number of values. Rows are
never sorted as a whole. Every cell is dealt into sub-bins by a hash of doc_id, size, crc32 and the number among rows that
agree in these, so that a hot source, a group of copies or an id that all rows share spreads over many tasks; running totals
go cells -> sub-bins -> rows, and rows of one sub-bin follow ``doc_id``.

Edge cases: a null text counts 0 bytes (size 1, crc32 of nothing is 0); null dimensions have a step of their own
(the first); repeated rows, also with the same doc_id, are placed one by one (ties are ordered by doc_id, size and crc
and are interchangeable beyond that); an empty table gives no rows; further columns pass through ``attach_shards``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.columns import set_aside
from tallyloom.llm.ranks import identity, meet_places, number_peers, running_totals
from tallyloom.plans.lineage import cut_lineage

BITS, STEPS = 4, 16
ROWS_PER_BIN = 50_000
LEAST_BINS = 32


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Position of ``point`` on the Hilbert curve (the transpose form undone by Gray coding)."""
    x = list(point)
    n = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            if x[i] & level:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = 0
    level = 1 << (bits - 1)
    while level > 1:
        if x[n - 1] & level:
            flip ^= level - 1
        level >>= 1
    x = [v ^ flip for v in x]
    index = 0
    for bit in reversed(range(bits)):
        for v in x:
            index = index << 1 | (v >> bit & 1)
    return index


def curve_table() -> list[int]:
    """Hilbert index of every cell (4,096 of them), at ``a * 256 + b * 16 + c``."""
    return [hilbert_index((a, b, c), BITS) for a in range(STEPS) for b in range(STEPS) for c in range(STEPS)]


def text_steps(df: DataFrame, column: str) -> Column:
    """An order-preserving step 0..15 for a string column; null is 0, and each other step has as many distinct values."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    ranked = running_totals(values, [F.col("value")], {"rank": F.lit(1)})
    n = ranked.count()
    step = F.expr(f"1 + rank * {STEPS - 1} div {max(n, 1)}")
    firsts = [r["first"] for r in ranked.groupBy(step.alias("step")).agg(F.min("value").alias("first")).orderBy("step").collect()]  # 15 at most
    if not firsts:
        return F.lit(0)
    # fewer values than steps leave steps out
    steps = sorted({1 + k * (STEPS - 1) // n for k in range(n)}) if n < STEPS else list(range(1, STEPS))
    cut = F.lit(steps[0])
    for low, number in zip(firsts[1:], steps[1:], strict=True):
        cut = F.when(F.col(column) >= low, number).otherwise(cut)
    return F.when(F.col(column).isNull(), 0).otherwise(cut)


def size_steps(size: Column) -> Column:
    """Powers of two from 16 bytes on."""
    return F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), F.floor(F.log2(size)).cast("int") - 4))


def place(slim: DataFrame, n_shards: int) -> DataFrame:
    """Add ``peer, shard, slot`` to rows with ``doc_id, size, text_crc32`` and the dimensions ``lang, source``, which must be materialised."""
    cell = F.get(
        F.split(F.lit(",".join(map(str, curve_table()))), ",").cast("array<int>"),  # one literal, folded to an array
        text_steps(slim, "lang") * STEPS * STEPS + text_steps(slim, "source") * STEPS + size_steps(F.col("size")),
    )
    n_rows = slim.count()
    n_bins = max(LEAST_BINS, -(-n_rows // (ROWS_PER_BIN * 64)))
    same = ["doc_id", "size", "text_crc32"]
    binned = number_peers(slim, same).withColumn("cell", cell).withColumn("bin", F.pmod(F.xxhash64(*same, "peer"), F.lit(n_bins)).cast("int"))
    binned = cut_lineage(binned)

    bins = binned.groupBy("cell", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    inside = Window.partitionBy("cell").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(
        "cell", "bin", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(inside), F.lit(0)).alias("b0")
    )
    # at most 4,096 cells: a window without keys over them is one small task
    cells = binned.groupBy("cell").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        "cell",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cell_n0"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("cell_b0"),
        F.sum("bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    row = Window.partitionBy("cell", "bin").orderBy(*same, "peer")
    running = (
        binned.join(bins, ["cell", "bin"])
        .withColumn("rank", F.col("n0") + F.row_number().over(row) - 1)
        .withColumn("start", F.col("b0") + F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(F.broadcast(cells), "cell")
        .withColumn("rank", F.col("rank") + F.col("cell_n0"))
        .withColumn("shard", F.expr(f"int(least({n_shards - 1}, (start + cell_b0) * {n_shards} div all_bytes))"))
        .drop("cell", "bin", "n0", "b0", "cell_n0", "cell_b0", "start", "all_bytes")
    )
    running = cut_lineage(running)
    firsts = running.groupBy("shard").agg(F.min("rank").alias("first"))  # one row a shard
    return running.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("rank") - F.col("first")).drop("rank", "first")


def slim_columns(docs: DataFrame, *more: str) -> DataFrame:
    """What placing needs of each row, without its text."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.select(
        "doc_id", "lang", "source", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), *more
    )


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs``."""
    return place(cut_lineage(slim_columns(docs)), n_shards).select("doc_id", "size", "text_crc32", "shard", "slot")


def attach_shards(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` (which replace columns of these names); texts are shuffled once.

    Rows that agree in everything are interchangeable: one of them meets the lists of their places and is repeated.
    """
    docs, restore = set_aside(docs.drop("shard", "slot"), ("doc_id", "text", "lang", "source"))
    rows = docs.withColumns(identity(docs))
    places = place(cut_lineage(slim_columns(rows, "__k1", "__k2")), n_shards)
    joined = meet_places(rows, places, F.struct("shard", "slot"))
    return restore(joined.withColumns({"shard": F.col("place.shard"), "slot": F.col("place.slot")}), "shard", "slot")


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """One folder a shard; a file holds runs of consecutive slots, in order."""
    run = F.floor(F.col("slot") / rows_per_file)
    sharded.repartition("shard", run).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op9_hilbert_shards(docs: DataFrame) -> DataFrame:
    placed = shard_documents(docs)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
