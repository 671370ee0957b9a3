"""A Merkle tree over the rows of a dataset: subtrees by language, a proof for each row, and what tampering does to it.

Leaves are numbered inside their group and cut into superblocks of BLOCK consecutive ones. A superblock is reduced to one
node, and these nodes are the leaves of the next layer, until each group is one node; the groups' nodes are a tree of their
own. On the way back each superblock is cogrouped with the outer nodes that its leaves need (the siblings from its own node up to
the root, one row a superblock): there the inside of the superblock is reduced again, inner and outer siblings are joined
into proofs, and tampered leaves are folded up to a root. No task holds more than a superblock, no path more than the tree
is high, and the driver sees the size of the largest group only.

Defined results: null fields are ``-``; a null language is a group of its own and comes first; rows without id come first in
their group and are not tampered with; rows that agree in all fields are equal leaves with places, and so proofs, of
their own; a group of one leaf is that leaf; an empty table has no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.lineage import cut_lineage

#: Leaves of a superblock; a power of two.
BLOCK = 1024
#: Rows with a checksum divisible by this have ``n_chars`` raised by one.
TAMPERED_EVERY = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(fields: dict[str, Column]) -> Column:
    """Lower-case hex SHA-256 of all fields, each ``-`` if null, else its length in bytes, ``:`` and itself."""
    shown = []
    for value in fields.values():
        text = value.cast("string")
        shown.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*shown).cast("binary"), 256)


def reduce_level(nodes: list[str]) -> list[str]:
    """Every two consecutive nodes, or the last one alone, become the digest of their text."""
    return [sha256((nodes[k] + nodes[k + 1] if k + 1 < len(nodes) else nodes[k]).encode()).hexdigest() for k in range(0, len(nodes), 2)]


def levels_of(nodes: list[str], whole: bool, block: int) -> list[list[str]]:
    """All levels of a superblock up to its one node. One of several in its group has as many levels as a full one."""
    levels, most = [nodes], block.bit_length() - 1
    while len(levels[-1]) > 1 or (not whole and len(levels) <= most):
        levels.append(reduce_level(levels[-1]))
    return levels


def siblings_of(levels: list[list[str]], k: int) -> Iterator[tuple[str, str]]:
    """What node ``k`` of the lowest level is joined with on its way up: ``(side, digest)``.

    The side is ``l`` or ``r``, or ``-`` without a digest where a node is alone.
    """
    for level in levels[:-1]:
        other = k ^ 1
        yield ("-", "") if other >= len(level) else ("l" if other < k else "r", level[other])
        k >>= 1


def fold(leaf: str, sides: str, digests: str) -> str:
    """The root that a leaf and its siblings lead to."""
    at = 0
    for side in sides:
        if side != "-":
            other = digests[at : at + 64]
            at += 64
            leaf = other + leaf if side == "l" else leaf + other
        leaf = sha256(leaf.encode()).hexdigest()
    return leaf


def deal(df: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Checkpointed ``df`` in ranges of group and order, and how many rows of a group lie in ranges before each.

    Equal rows are told apart by a row number, so neither a large group nor many equal rows meet in one task.
    """
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order, "__tie")]
    dealt = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    dealt = cut_lineage(dealt.withColumn("__row", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__row", 33)))
    counts = dealt.groupBy(*group, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))  # a row per group and range
    same = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__n").over(same.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt, counts.select(*group, "__part", "__first", before.alias("__before"), F.sum("__n").over(same).alias("size"))


def place(dealt: DataFrame, ranges: DataFrame, group: list[str]) -> DataFrame:
    """The rows of ``deal`` with ``pos`` (0, 1, 2, ... inside each group) and what else ``ranges`` has."""
    own = [*group, "__part", "__first", "__before"]
    more = [c for c in ranges.columns if c not in own]
    other = ranges.select(*(F.col(c).alias(f"__of_{c}") for c in (*group, "__part")), "__first", "__before", *more)
    meet = F.col("__part") == F.col("__of___part")
    for g in group:
        meet = meet & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    columns = [c for c in dealt.columns if c not in ("__row", "__part")]
    return dealt.join(other, meet).select(*columns, (F.col("__row") - F.col("__first") + F.col("__before")).alias("pos"), *more)


def with_paths(nodes: DataFrame, largest: int, block: int = BLOCK) -> DataFrame:
    """For each node (``grp, pos, size, node``): ``grp, pos, top, sides, digests``, its group's topmost node and the way there.

    ``sides`` has a letter a level (see ``siblings_of``) and ``digests`` the siblings' digests end to end.
    """
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / block))
    made = "grp long, block long, size long, node string"

    def top(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        size = int(rows["size"].iloc[0])
        last = levels_of(rows["node"].tolist(), size <= block, block)[-1][0]
        return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "size": [size], "node": [last]})

    above = blocks.groupBy("grp", "block").applyInPandas(top, made)
    if largest > block:
        upper = above.select("grp", F.col("block").alias("pos"), F.ceil(F.col("size") / block).alias("size"), "node")
        upper = cut_lineage(upper)
        outer = with_paths(upper, -(-largest // block), block).withColumnRenamed("pos", "block")
    else:
        outer = above.select("grp", "block", F.col("node").alias("top"), F.lit("").alias("sides"), F.lit("").alias("digests"))

    def exchange(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        inner, way = inner.sort_values("pos"), outer.iloc[0]
        levels = levels_of(inner["node"].tolist(), int(inner["size"].iloc[0]) <= block, block)
        found = [list(siblings_of(levels, k)) for k in range(len(inner))]
        return pd.DataFrame({
            "grp": inner["grp"].to_numpy(), "pos": inner["pos"].to_numpy(), "top": way["top"],
            "sides": ["".join(s for s, _ in f) + way["sides"] for f in found], "digests": ["".join(d for _, d in f) + way["digests"] for f in found],
        })

    return blocks.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(exchange, "grp long, pos long, top string, sides string, digests string")


def merkle_manifest(leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """For leaves (``lang``, ``doc_id``, ``leaf``, and ``changed``: the leaf as found, or null where it is unchanged) their proofs.

    Returns ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: digests of the untampered tree, and the root
    that the leaf as found leads to.
    """
    dealt, ranges = deal(leaves, ["lang"], ["doc_id", "leaf"])
    # groups by number: the place of their language (null first, then by bytes)
    firsts = place(*deal(ranges.where("__before = 0").select("lang", F.lit(0).alias("all")), ["all"], ["lang"]), ["all"])
    names = firsts.select(F.col("lang").alias("_lang"), F.col("pos").alias("grp"), F.col("size").alias("groups"))
    ranges = ranges.join(names, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
    # ids as text: in pandas, integers among nulls would be floats
    rows = place(dealt, ranges, ["lang"]).select("grp", "groups", "pos", "size", F.col("doc_id").cast("string").alias("doc_id"), F.col("leaf").alias("node"), "changed")
    rows = cut_lineage(rows)
    largest, groups = rows.agg(F.max("size"), F.max("groups")).first()
    if largest is None:
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(True).alias("verified"))
    blocks = rows.withColumn("block", F.floor(F.col("pos") / block))

    def top(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        size = int(part["size"].iloc[0])
        return pd.DataFrame({"grp": [key[0]], "pos": [key[1]], "size": [-(-size // block)], "node": [levels_of(part["node"].tolist(), size <= block, block)[-1][0]]})

    nodes = cut_lineage(blocks.select("grp", "block", "pos", "size", "node").groupBy("grp", "block").applyInPandas(top, "grp long, pos long, size long, node string"))
    up = with_paths(nodes, -(-largest // block), block).withColumnRenamed("pos", "block")
    up = cut_lineage(up.select("grp", "block", F.col("top").alias("subroot"), "sides", "digests"))
    # the tree over the groups' nodes; group numbers are its places
    tops = up.where("block = 0").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(groups).alias("size"), F.col("subroot").alias("node"))
    over = with_paths(tops, groups, block).select(F.col("pos").alias("grp"), F.col("top").alias("root"), F.col("sides").alias("more"), F.col("digests").alias("others"))
    outer = up.join(over, "grp").select("grp", "block", "subroot", "root", F.concat("sides", "more").alias("sides"), F.concat("digests", "others").alias("digests"))

    def exchange(inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        inner, way = inner.sort_values("pos"), outer.iloc[0]
        nodes, sides, digests = inner["node"].tolist(), way["sides"], way["digests"]
        levels = levels_of(nodes, int(inner["size"].iloc[0]) <= block, block)
        proofs, roots = [], []
        for k, (leaf, changed) in enumerate(zip(nodes, inner["changed"], strict=True)):
            own = list(siblings_of(levels, k))
            path = "".join(d for _, d in own) + digests
            proofs.append(sha256(path.encode()).hexdigest())
            roots.append(fold(changed if isinstance(changed, str) else leaf, "".join(s for s, _ in own) + sides, path))
        return pd.DataFrame({
            "doc_id": inner["doc_id"].to_numpy(), "leaf": nodes, "subroot": way["subroot"], "root": way["root"],
            "proof_sha256": proofs, "folded_root": roots, "verified": [r == way["root"] for r in roots],
        })

    made = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.groupBy("grp", "block").cogroup(outer.groupBy("grp", "block")).applyInPandas(exchange, made).withColumn("doc_id", F.col("doc_id").cast("long"))


def op13_merkle_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``; where a checksum of the id is divisible by TAMPERED_EVERY, ``n_chars`` is found one higher."""
    fields = {c: F.col(c) for c in FIELDS}
    touched = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED_EVERY == 0) & F.col("n_chars").isNotNull()
    changed = F.when(touched, digest_of(fields | {"n_chars": F.col("n_chars") + 1}))
    return merkle_manifest(docs.select("lang", "doc_id", digest_of(fields).alias("leaf"), changed.alias("changed")))
