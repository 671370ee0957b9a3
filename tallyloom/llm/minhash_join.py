"""N-gram Jaccard join: MinHash buckets, Bayesian pruning, exact verification.

Texts are sets of five-word shingles. Equal word sequences form a class at once and are represented by one member. For
representatives:

1. 128 MinHash values of 16 bits each, in 32 bands of four. Two sets of similarity 0.8 miss all bands with a
   probability below 1e-7. Buckets of a single member are dropped by a count.
2. Inside a bucket MinHash values are compared 32 at a time; a pair is dropped once the posterior probability (uniform
   prior) that its similarity reaches the threshold is below ``tolerance``. With 1e-9 a pair of similarity exactly 0.8 is
   dropped with a probability of 5.8e-9, one of 0.82 with 4.8e-10; with the bands, a pair at the threshold is missed with a
   probability below 1e-7. A pair is looked at only in the first band it shares, so it is counted once.
3. Only members with a surviving pair get their shingle sets, and the pairs are verified exactly.

Pairs never leave a task: a bucket yields for each member the number of its links and the least member it hangs together
with, so a group of n near copies gives n rows, not n^2. Buckets beyond BLOCK members are cut into blocks by a hash, and
every pair of blocks is a task of its own; for the exact check the blocks of a bucket are also as many as keep the shingles
of one below BLOCK_SHINGLES. A bucket of n members is shuffled ceil(n / BLOCK) times, once up to BLOCK members.
Inside a task, tiles of pairs are compared as matrices: a pair that shares an earlier band costs one comparison of two keys.

Edge cases: a null or empty text, or one without words, has no shingles and no links; a text of one to four words is one
shingle; repeated rows are members of one class; different texts under one doc_id are told apart by their fingerprints, and
texts without doc_id are compared like others (an id is null in the result where no text of a class has one); texts of any
length are used whole; empty tables give no rows; other columns pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import bound_batches, set_aside
from tallyloom.llm.textbatch import hashed_words, mix, pieces, utf8_column
from tallyloom.operators.components import connected_components
from tallyloom.plans.lineage import cut_lineage

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-9
HASHES, BAND_ROWS = 128, 4
BANDS, STEP = HASHES // BAND_ROWS, 32
#: Members of a bucket in one block, and the shingles that a block of the exact check holds (a longer text is a block of its own).
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
PIECE_BYTES = 1 << 19
#: Members of a tile whose pairs are compared at a time, bands compared as matrices, bytes of bits for the exact check.
TILE, DENSE_BANDS, BITS_AT_ONCE = 512, 4, 1 << 25
#: Up to so many rows of two numbers a list of documents is broadcast (some 40 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 200_000

_WEIGHTS = mix(np.arange(1001, 1001 + SHINGLE, dtype=np.uint64)) | np.uint64(1)
_MULTIPLY = (mix(np.arange(1, HASHES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_ADD = (mix(np.arange(5001, 5001 + HASHES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def row_words(view: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows end to end, and the number of words of each row."""
    words, rows, _ = hashed_words(view, offsets)
    return words, np.bincount(rows, minlength=len(offsets) - 1)


def shingles(words: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all rows end to end, and the offsets of each row's."""
    counts = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    ends = np.concatenate(([0], np.cumsum(counts)))
    first_word = np.concatenate(([0], np.cumsum(n_words)))[:-1]
    start = np.arange(ends[-1]) + np.repeat(first_word - ends[:-1], counts)
    padded = np.concatenate((words, np.zeros(SHINGLE, np.uint64)))
    width = np.repeat(np.minimum(n_words, SHINGLE), counts)
    total = np.zeros(len(start), np.uint64)
    for k in range(SHINGLE):
        total += np.where(k < width, padded[start + k] * _WEIGHTS[k], np.uint64(0))
    return mix(total + width.astype(np.uint64)), ends


def signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """MinHash values (rows by HASHES, 16 bits); rows without shingles are zero."""
    out = np.zeros((len(ends) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(ends) > 0)
    if not len(full):
        return out
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    starts = ends[:-1][full]
    for k in range(HASHES):
        value = low * _MULTIPLY[k] + _ADD[k]
        value ^= value >> np.uint32(15)
        value *= np.uint32(0x85EBCA6B)
        least = np.minimum.reduceat(value, starts)
        out[full, k] = ((least ^ (least >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(16)
    return out


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the fewest matches with which P(similarity >= threshold) is not below ``tolerance``."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(log - log.max())
            if density[s >= threshold].sum() / density.sum() >= tolerance:
                out[n] = m
                break
    return out


def surviving_pairs(sig: np.ndarray, rows: np.ndarray, columns: np.ndarray, band: int, least: dict[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row and a column (of later ones, if both are the ``same`` members) that have ``band`` as their first common band and are not pruned."""
    keys = sig.view(np.uint64).reshape(len(sig), BANDS)
    fresh = keys[rows, band][:, None] == keys[columns, band][None, :]
    if same:
        fresh &= np.arange(len(rows))[:, None] < np.arange(len(columns))[None, :]
    for earlier in range(min(band, DENSE_BANDS)):
        fresh &= keys[rows, earlier][:, None] != keys[columns, earlier][None, :]
    left, right = np.nonzero(fresh)
    left, right = rows[left], columns[right]
    for earlier in range(DENSE_BANDS, band):
        if not len(left):
            break
        apart = keys[left, earlier] != keys[right, earlier]
        left, right = left[apart], right[apart]
    matches = np.zeros(len(left), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        if not len(left):
            break
        matches = matches + (sig[left, n - STEP : n] == sig[right, n - STEP : n]).sum(axis=1, dtype=np.int32)
        good = matches >= least[n]
        left, right, matches = left[good], right[good], matches[good]
    return left, right


@dataclass
class Task:
    """A bucket, or a pair of blocks of one: its members and where the second block starts (0: one block)."""

    key: tuple[int, int, int, int]  # band, bucket, first and second block
    ids: np.ndarray
    sig: np.ndarray
    second: int
    weight: np.ndarray | None = None
    sets: list[np.ndarray] | None = None

    def tiles(self, size: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Rows and columns of members whose pairs are to be compared, and whether both are the same members."""
        n = len(self.ids)
        for a in range(0, self.second or n, size):
            rows = np.arange(a, min(a + size, self.second or n))
            for b in range(self.second or a, n, size):
                columns = np.arange(b, min(b + size, n))
                yield rows, columns, not self.second and a == b


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[Task]:
    """Rows come sorted by (band, bucket, first and second block, block); a task may span batches, and holds two blocks at most."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = _task_keys(held)
        edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        if len(edges):
            yield from _split(held.slice(0, edges[-1]), keys[: edges[-1]], edges[:-1])
            held = held.slice(edges[-1])
    if held is not None and held.num_rows:
        keys = _task_keys(held)
        yield from _split(held, keys, np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1)


def _task_keys(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy().astype(np.int64) for c in ("band", "bucket", "lo", "hi")], axis=1)


def _split(table: pa.Table, keys: np.ndarray, edges: np.ndarray) -> Iterator[Task]:
    table = table.combine_chunks()
    ids, block = table["node"].to_numpy(), table["block"].to_numpy()
    view, _ = utf8_column(table["sig"])
    sig = np.frombuffer(view, np.uint16).reshape(-1, HASHES)
    weight = table["weight"].to_numpy() if "weight" in table.column_names else None
    sets = utf8_column(table["shingles"]) if "shingles" in table.column_names else None
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
        if b - a < 2:
            continue
        second = int(np.searchsorted(block[a:b], keys[a, 3], side="left")) if keys[a, 2] != keys[a, 3] else 0
        if keys[a, 2] != keys[a, 3] and second in (0, b - a):
            continue  # one of the two blocks is empty
        task = Task(tuple(keys[a].tolist()), ids[a:b], sig[a:b], second)
        if weight is not None and sets is not None:
            task.weight = weight[a:b]
            task.sets = [np.frombuffer(sets[0][sets[1][i] : sets[1][i + 1]], np.uint64) for i in range(a, b)]
        yield task


def _candidates(least: dict[int, int]):
    """Members that have a surviving pair in their task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _tasks(batches):
            hit = np.zeros(len(task.ids), bool)
            for rows, columns, same in task.tiles():
                left, right = surviving_pairs(task.sig, rows, columns, task.key[0], least, same)
                hit[left] = hit[right] = True
            if hit.any():
                n, (band, bucket, _, _) = int(hit.sum()), task.key
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array(task.ids[hit], pa.int64()),
                        "band": pa.array(np.full(n, band), pa.int32()),
                        "bucket": pa.array(np.full(n, bucket), pa.int64()),
                    }
                )

    return run


def verified(task: Task, least: dict[int, int], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Exactly verified pairs of a task, a tile at a time: a bit for each shingle that two members of a tile share, and one count of bits a pair."""
    sizes = np.array([len(s) for s in task.sets])
    for rows, columns, same in task.tiles():
        left, right = surviving_pairs(task.sig, rows, columns, task.key[0], least, same)
        if not len(left):
            continue
        members, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        packed = _shared_bits([task.sets[m] for m in members.tolist()])
        at_once = max(1, (1 << 22) // max(1, packed.shape[1]))
        for at in range(0, len(left), at_once):
            a, b = left[at : at + at_once], right[at : at + at_once]
            i, j = place[: len(left)][at : at + at_once], place[len(left) :][at : at + at_once]
            common = np.bitwise_count(packed[i] & packed[j]).sum(axis=1, dtype=np.int64)
            good = common >= threshold * (sizes[a] + sizes[b] - common) - 1e-9
            yield a[good], b[good]


def _shared_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Sets by words of 64 bits; each bit stands for a value that two sets or more hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    keep = times[inverse] > 1
    owner, column = owner[keep], column[inverse[keep]]
    width = -(-max(int((times > 1).sum()), 1) // 64) * 64
    packed = np.zeros((len(sets), width // 64), np.uint64)
    step = max(1, BITS_AT_ONCE // width)
    for a in range(0, len(sets), step):
        lo, hi = np.searchsorted(owner, (a, a + step))
        bits = np.zeros((min(step, len(sets) - a), width), np.uint8)
        bits[owner[lo:hi] - a, column[lo:hi]] = 1
        packed[a : a + step] = np.packbits(bits, axis=1).view(np.uint64)
    return packed


def _least_linked(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first member that each hangs together with."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            return label


def _links(least: dict[int, int], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task in _tasks(batches):
            n = len(task.ids)
            links, distinct, root = np.zeros(n), np.zeros(n, np.int64), np.arange(n)
            for left, right in verified(task, least, threshold):
                links += np.bincount(left, task.weight[right], n) + np.bincount(right, task.weight[left], n)
                distinct += np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
                # what hung together before stays together
                root = _least_linked(n, np.concatenate([left, np.arange(n)]), np.concatenate([right, root]))
            linked = np.flatnonzero(distinct)
            if len(linked):
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array(task.ids[linked], pa.int64()),
                        "root": pa.array(task.ids[root[linked]], pa.int64()),
                        "links": pa.array(links[linked].astype(np.int64), pa.int64()),
                        "text_links": pa.array(distinct[linked], pa.int64()),
                    }
                )

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        view, offsets = utf8_column(batch["text"])
        for a, b in pieces(offsets, PIECE_BYTES):
            cut = offsets[a : b + 1] - offsets[a]
            part = view[offsets[a] : offsets[b]]
            words, n_words = row_words(part, cut)
            hashes, ends = shingles(words, n_words)
            prints = _fingerprints(words, n_words)
            sig = signatures(hashes, ends)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].slice(a, b - a),
                    "print": batch["print"].slice(a, b - a),
                    "n_words": pa.array(n_words, pa.int64()),
                    "f1": pa.array(prints[0], pa.int64()),
                    "f2": pa.array(prints[1], pa.int64()),
                    "sig": pa.array([row.tobytes() for row in sig], pa.binary()),
                }
            )


def _fingerprints(words: np.ndarray, n_words: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each row's word sequence."""
    place = np.arange(len(words)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    full = np.flatnonzero(n_words > 0)
    out = []
    for salt in (1, 2):
        value = mix(words * np.uint64(2 * salt + 1) + mix(place.astype(np.uint64) + np.uint64(salt << 40)))
        sums = np.zeros(len(n_words), np.uint64)
        if len(full):
            sums[full] = np.add.reduceat(value, (np.cumsum(n_words) - n_words)[full])
        out.append(sums.view(np.int64))
    return out


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        view, offsets = utf8_column(batch["text"])
        for a, b in pieces(offsets, PIECE_BYTES):
            hashes, ends = shingles(*row_words(view[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            sets = [np.unique(hashes[s:e]).tobytes() for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"node": batch["node"].slice(a, b - a), "shingles": pa.array(sets, pa.binary())})


#: What makes texts the same: their number of words and two fingerprints of the sequence.
SAME = ["n_words", "f1", "f2"]


def similarity_classes(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """``doc_id, rep_id, class_id, n_links, n_text_links`` for every row of ``docs`` (``doc_id, text``).

    ``rep_id``: the least doc_id with the same words; ``class_id``: the least doc_id of all that links connect;
    ``n_links``: other documents of similarity >= ``threshold``, copies included; ``n_text_links``: other texts.
    """
    placed = _placed_texts(docs, threshold, tolerance, block)
    worded, zero = F.col("node").isNotNull(), F.lit(0).cast("long")
    return placed.select(
        "doc_id",
        F.when(worded, F.col("rep")).otherwise(F.col("doc_id")).alias("rep_id"),
        F.when(worded, F.col("least_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("weight") - 1 + F.col("links")).otherwise(zero).alias("n_links"),
        F.when(worded, F.col("text_links")).otherwise(zero).alias("n_text_links"),
    )


def _placed_texts(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """Each row's ``doc_id, print`` (a hash of its text), and of its class of same words ``node, rep, weight, links, text_links``,
    and of all that links connect ``least_id, kept_id, kept_print`` (the row to keep; null ids come last). ``node`` is null without words.
    """
    least = least_matches(threshold, tolerance)
    texts = bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("print"))
    sketch = cut_lineage(texts.mapInArrow(_sketch, "doc_id long, print long, n_words long, f1 long, f2 long, sig binary"))
    worded = sketch.where("n_words > 0")
    last = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print")
    # a class has a number of its own: a doc_id may stand for several texts
    classes = cut_lineage(
        worded.groupBy(*SAME)
        .agg(F.min(last).alias("first"), F.count("*").alias("weight"))
        .select(*SAME, "weight", "first.*", F.monotonically_increasing_id().alias("node"))
    )
    keys = classes.select(*SAME, "node", "weight", F.col("doc_id").alias("rep"), F.col("print").alias("rep_print"))
    # the representative may be a repeated row: its signature is taken once
    reps = cut_lineage(
        worded.join(keys, SAME).where(F.col("print").eqNullSafe(F.col("rep_print")) & F.col("doc_id").eqNullSafe(F.col("rep")))
        .select("node", "weight", "sig").dropDuplicates(["node"])
    )

    banded = reps.select("node", F.posexplode(_band_values("sig")).alias("band", "bucket"))
    crowded = banded.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    crowded = crowded.select("band", "bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    order = ["band", "bucket", "lo", "hi", "block", "node"]
    tasks = _dealt(banded.join(crowded, ["band", "bucket"])).join(reps.select("node", "sig"), "node").select(*order, "sig")
    hits = tasks.repartition(*order[:4]).sortWithinPartitions(*order).mapInArrow(_candidates(least), "node long, band int, bucket long")
    hits = cut_lineage(hits.distinct())

    # node, doc_id and print lead back to one text of each node that has a surviving pair
    needed = hits.select("node").distinct().join(keys.select("node", "rep", "rep_print"), "node")
    needed = cut_lineage(needed)
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_IDS else needed
    found = F.col("print").eqNullSafe(F.col("rep_print")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    sets = texts.join(needed, found).select("node", "text").mapInArrow(_shingle_sets, "node long, shingles binary")
    sets = sets.dropDuplicates(["node"]).join(reps, "node")
    sized = hits.join(sets.select("node", F.floor(F.octet_length("shingles") / 8).alias("n_shingles")), "node")
    heavy = sized.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    heavy = heavy.select("band", "bucket", F.ceil(F.greatest(F.col("n") / block, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    linked = (
        _dealt(hits.join(heavy, ["band", "bucket"]))
        .join(sets, "node")
        .select(*order, "sig", "weight", "shingles")
        .repartition(*order[:4])
        .sortWithinPartitions(*order)
        .mapInArrow(_links(least, threshold), "node long, root long, links long, text_links long")
    )
    linked = cut_lineage(linked)

    links = linked.groupBy("node").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    parts = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    first = F.struct("no_id", "doc_id", "print")
    grouped = classes.join(parts, "node").groupBy("component").agg(F.min(first).alias("kept"))
    parts = parts.join(grouped, "component").select("node", "kept")
    zero = F.lit(0).cast("long")
    whole = (
        classes.join(links, "node", "left").join(parts, "node", "left").withColumn("kept", F.coalesce("kept", first))
        .select(
            *SAME, "node", F.col("doc_id").alias("rep"), "weight", F.coalesce("links", zero).alias("links"), F.coalesce("text_links", zero).alias("text_links"),
            F.col("kept.doc_id").alias("least_id"), F.col("kept.doc_id").alias("kept_id"), F.col("kept.print").alias("kept_print"),
        )
    )
    return sketch.select("doc_id", "print", *SAME).join(whole, SAME, "left")


def _dealt(members: DataFrame) -> DataFrame:
    """Rows of ``node, band, bucket, blocks`` for every pair of blocks that a member's own block is in."""
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = members.select("node", "band", "bucket", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return members.select("node", "band", "bucket", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def _band_values(sig: str):
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring(F.col(sig), b * 8 + 1, F.lit(8))))


def drop_near_duplicates(docs: DataFrame, **join) -> DataFrame:
    """Keep the document of least doc_id of each class (one without doc_id only if none has one).

    Of rows with equal doc_id and text one stays; documents without words stay. Different texts under one doc_id are judged apart.
    """
    placed = _placed_texts(docs, **join)
    leads = F.col("node").isNull() | (F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.col("print").eqNullSafe(F.col("kept_print")))
    judged = placed.groupBy("doc_id", "print").agg(F.count("*").alias("n"), F.bool_or(leads).alias("stays")).where("not stays or n > 1")
    judged = cut_lineage(judged.select(F.col("doc_id").alias("its_id"), F.col("print").alias("its_print"), "stays"))
    listed = F.broadcast(judged) if judged.count() <= BROADCAST_IDS else judged
    rows, restore = set_aside(docs, ("doc_id", "text"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    same = F.col("print").eqNullSafe(F.col("its_print")) & F.col("doc_id").cast("long").eqNullSafe(F.col("its_id"))
    single = rows.join(listed, same, "left_anti")
    repeated = rows.join(listed.where("stays"), same, "left_semi").dropDuplicates(["doc_id", "print"])
    return restore(single.unionByName(repeated))


def op2_ngram_join(docs: DataFrame) -> DataFrame:
    return similarity_classes(docs.select("doc_id", "text"))
