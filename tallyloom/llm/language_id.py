"""Language identification by prediction by partial matching (PPM) with frozen statistics.

Each language has a context tree over bytes, of variable order up to ``max_order``. The cost of a byte after a context
is exact: -log2 of its share among the context's counts plus escapes (method C: an escape weighs the number of distinct
successors); an unseen byte pays the escape and asks the context one byte shorter, down to one of 256 equally likely
bytes. (A context's counts are used whole: bytes that a longer context has ruled out are not excluded from them.) A text
belongs to the language that codes it in the fewest bits.

Because the statistics are frozen, the costs of LANGUAGES_AT_ONCE languages are tables over the union of their contexts, and
the longest context is the state of a small automaton: scoring is a few table look-ups per byte, on whole batches in numpy.
Each language has a tree of its own (its ``contexts`` most frequent contexts, with their suffixes), however many languages
there are. Beyond PASS_LANGUAGES languages the texts are scored in several passes, each holding the tables of so many.

All labelled rows are counted, and every text is scored whole. (``fit`` takes fewer rows a language on demand; no query asks for that.)
``keep_identified`` also rejects texts that even their best language codes badly: the limit is calibrated on all labelled rows, each
scored by a model that has not learned from it.

A letter is a character of Unicode's category L. Edge cases: a null text or one without a letter is ``und`` with score 0; a text that is all foreign bytes still gets the
language of least cost; without labelled rows everything is ``und``; ties go to the first language in order; repeated
rows are scored one by one; other columns pass through ``identify`` and clashing names are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.columns import bound_batches, set_aside
from tallyloom.llm.textbatch import pieces, utf8_column
from tallyloom.plans.lineage import cut_lineage

UNKNOWN = "und"
MAX_ORDER, CONTEXTS = 3, 2048
#: Languages that share tables, and languages whose tables a worker holds.
LANGUAGES_AT_ONCE, PASS_LANGUAGES = 4, 64
#: A text is rejected beyond so many times the worst rate of the labelled rows, and beyond the bits of a byte without any
#: model; so many bits are free, as short texts cost more.
MARGIN, NO_MODEL, FREE_BITS = 1.25, 8.0, 128.0
PIECE_BYTES = 1 << 20
#: Counts that a task collects before it merges them, and that it keeps merged before it passes them on.
MERGE_COUNTS, KEEP_COUNTS = 1 << 20, 1 << 19
COUNTS = "lang string, half int, n int, gram long, times long"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class ContextTrees:
    """``step[state, class]`` and ``bits[state, class, language]`` over the union of contexts."""

    languages: list[str]
    classes: np.ndarray
    step: np.ndarray
    bits: np.ndarray
    order: int

    def costs(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each row (rows by languages)."""
        n, c = len(data), self.classes[data]
        state = np.zeros(n, np.int32)
        place = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))
        for back in range(self.order, 0, -1):
            moved = np.zeros(n, np.int32)
            moved[back:] = self.step[state[back:], c[:-back]]
            state = np.where(place >= back, moved, 0)
        spent = self.bits[state, c]
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            out[full] = np.add.reduceat(spent, offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([t for _, t in parts]), len(keys)).astype(np.int64)


def _grams(order: int):
    """Counts of (context, next byte) of all orders: a gram is its bytes as a number, with its length.

    Only grams of the highest order are counted at every byte: those of an order below are their ends, and one more at each
    text's begin. A task merges the counts of its batches as long as they are few.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def passed_on(held: list[list], owners: list[tuple[str, int]]) -> Iterator[pa.RecordBatch]:
        longer = none
        for n in range(order, -1, -1):
            keys, times = _merged([*held[n], longer])
            longer = keys >> 40 << 40 | keys & ((1 << 8 * n) - 1), times
            for at in range(0, len(keys), 1 << 16):
                some = keys[at : at + (1 << 16)]
                who = pa.array(some >> 40)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([x for x, _ in owners], pa.string()).take(who),
                        "half": pa.array([x for _, x in owners], pa.int32()).take(who),
                        "n": pa.array(np.full(len(some), n), pa.int32()),
                        "gram": pa.array(some & ((1 << 40) - 1), pa.int64()),
                        "times": pa.array(times[at : at + (1 << 16)], pa.int64()),
                    }
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, int], int] = {}
        held, waiting = [[] for _ in range(order + 1)], 0
        for batch in batches:
            pairs = zip(batch["lang"].to_pylist(), batch["half"].to_pylist(), strict=True)
            owners = np.array([numbers.setdefault(x, len(numbers)) for x in pairs], np.int64)
            view, offsets = utf8_column(batch["text"])
            data = np.frombuffer(view, np.uint8)
            for start in range(0, len(data), PIECE_BYTES):
                end, lead = min(len(data), start + PIECE_BYTES), min(order, start)
                first, last = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, end)
                lengths = np.diff(np.clip(offsets[first : last + 1], start, end))
                place = np.arange(start, end) - np.repeat(offsets[first:last], lengths)
                window = np.concatenate([np.zeros(order - lead, np.uint8), data[start - lead : end]])
                gram = np.zeros(end - start, np.int64)
                for at in range(order + 1):
                    gram = gram << 8 | window[at : at + end - start]
                keys = np.repeat(owners[first:last], lengths) << 40 | gram
                held[order].append(np.unique(keys[place >= order], return_counts=True))
                for n in range(order):
                    begins = keys[place == n]
                    held[n].append(np.unique(begins >> 40 << 40 | begins & ((1 << 8 * (n + 1)) - 1), return_counts=True))
                waiting += sum(len(part[-1][0]) for part in held)
                if waiting > MERGE_COUNTS:
                    held = [[_merged(part)] for part in held]
                    waiting = sum(len(part[0][0]) for part in held)
                    if waiting > KEEP_COUNTS:
                        yield from passed_on(held, list(numbers))
                        held, waiting = [[] for _ in range(order + 1)], 0
        yield from passed_on(held, list(numbers))

    return count


def _sample(labelled: DataFrame, fit_rows: int) -> DataFrame:
    """About ``fit_rows`` rows of each language, from one end of a hash of the row.

    The row at that end is always among them, so no language is left out, whatever its ids are.
    """
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(6)), F.lit(1 << 20)) / float(1 << 20)
    ends = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.min(place).alias("least"))
    shares = ends.select(F.col("lang").alias("its_lang"), F.greatest(F.lit(float(fit_rows)) / F.col("count"), "least").alias("share"))
    # a row a language: far less than the tables that the model holds of each
    return labelled.join(F.broadcast(shares), (F.col("lang") == F.col("its_lang")) & (place <= F.col("share"))).select(*labelled.columns)


def _half() -> Column:
    """Labelled rows fall into two halves, equal texts into one, so that each half can be scored by what the other one taught."""
    return F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2)).cast("int")


def _count(labelled: DataFrame, max_order: int = MAX_ORDER, fit_rows: int | None = None, half: Column | None = None) -> DataFrame:
    """How often each language has each gram (COUNTS), by ``half``; equal texts count once."""
    labelled = labelled.where("lang is not null and text is not null")
    if fit_rows is not None:
        labelled = _sample(labelled, fit_rows)
    rows = labelled.select("lang", "text").distinct().withColumn("half", F.lit(0) if half is None else half)
    counts = bound_batches(rows).mapInArrow(_grams(max_order), COUNTS)
    return cut_lineage(counts.groupBy("lang", "half", "n", "gram").agg(F.sum("times").alias("times")))


def fit(labelled: DataFrame, max_order: int = MAX_ORDER, contexts: int = CONTEXTS, fit_rows: int | None = None) -> list[ContextTrees]:
    """Fit on all labelled rows (``doc_id, text, lang``); equal texts count once.

    With ``fit_rows``, only about so many rows of each language are taken, picked by a hash of id and text.
    Order 4 is the most that a gram's number holds. Of each language the ``contexts`` most frequent ones are kept, each with
    all its suffixes; the tables of LANGUAGES_AT_ONCE languages take at most that many times contexts x 256 x languages x 4
    bytes, which bounds a broadcast. An empty list without labelled rows.
    """
    if not 1 <= max_order <= 4:
        raise ValueError("max_order is 1 to 4")
    return _learn(_count(labelled, max_order, fit_rows), max_order, contexts)


def _learn(counts: DataFrame, max_order: int = MAX_ORDER, contexts: int = CONTEXTS) -> list[ContextTrees]:
    frequent = counts.where("n > 0").groupBy("lang", "n", F.shiftright("gram", 8).alias("context")).agg(F.sum("times").alias("times"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "n", "context"))
    own: dict[str, set[tuple[int, int]]] = {r["lang"]: set() for r in counts.select("lang").distinct().collect()}
    for r in frequent.withColumn("rank", rank).where(F.col("rank") <= contexts).select("lang", "n", "context").toLocalIterator():
        own[r["lang"]].add((r["n"], r["context"]))
    out, names = [], sorted(own)
    for at in range(0, len(names), LANGUAGES_AT_ONCE):
        languages = names[at : at + LANGUAGES_AT_ONCE]
        chosen = set().union(*(own[x] for x in languages))
        chosen |= {(k, c & ((1 << 8 * k) - 1)) for n, c in chosen for k in range(1, n)}
        kept = F.broadcast(counts.sparkSession.createDataFrame([(0, 0), *sorted(chosen)], "n int, context long"))
        mine = counts.where(F.col("lang").isin(languages)).withColumn("context", F.shiftright("gram", 8))
        rows = mine.join(kept, ["n", "context"]).select("lang", "n", "context", "gram", "times").toArrow()
        out.append(_tables(languages, sorted(chosen), rows, max_order))
    return out


def _tables(languages: list[str], chosen: list[tuple[int, int]], rows: pa.Table, order: int) -> ContextTrees:
    states = {(0, 0): 0} | {key: i + 1 for i, key in enumerate(chosen)}
    at = np.array([states[k] for k in zip(rows["n"].to_pylist(), rows["context"].to_pylist(), strict=True)])
    byte = rows["gram"].to_numpy() & 255
    seen = np.unique(np.concatenate([byte, [c & 255 for _, c in chosen]])).astype(np.int64)
    classes = np.full(256, len(seen), np.uint16)  # all bytes that no language has seen cost the same
    classes[seen] = np.arange(len(seen))
    width = len(seen) + 1
    counts = np.zeros((len(languages), len(states), width), np.float32)
    tongue = np.searchsorted(np.array(languages), np.array(rows["lang"].to_pylist()))
    np.add.at(counts, (tongue, at, classes[byte]), rows["times"].to_numpy())

    bits = np.full((len(states), width, len(languages)), 8.0, np.float32)
    step = np.zeros((len(states), width), np.int32)
    suffix = np.array([0] + [states[(n - 1, c & ((1 << 8 * (n - 1)) - 1))] if n > 1 else 0 for n, c in chosen])
    for s, (n, context) in enumerate([(0, 0), *chosen]):  # by length, so the shorter context is done
        here = counts[:, s]
        total, kinds = here.sum(axis=1, keepdims=True), (here > 0).sum(axis=1, keepdims=True)
        below = bits[suffix[s]].T if n else np.full((len(languages), width), 8.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
            bits[s] = np.where(here > 0, np.log2((total + kinds) / np.maximum(here, 1)), escape + below).T
        for k, b in enumerate(seen.tolist()):
            longer = (context << 8) | b
            step[s, k] = states.get((n + 1, longer), step[suffix[s], k] if n else 0)
    return ContextTrees(languages, classes, step, bits, order)


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


OUT = ("lang_pred", "score", "bits_per_byte")


#: What one pass tells the next: the best language, its bits, and the likelihood of all relative to it.
STATE = ("__lang", "__bits", "__mass")


def _scorer(shared: Sequence, drop: tuple[str, ...], first: bool, last: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: list[ContextTrees] = [s.value for s in shared]
        for batch in batches:
            view, offsets = utf8_column(batch["text"])
            n_rows = batch.num_rows
            names = np.full(n_rows, UNKNOWN, object) if first else np.array(batch["__lang"].to_pylist(), object)
            bits = np.full(n_rows, np.inf) if first else batch["__bits"].to_numpy(zero_copy_only=False).copy()
            mass = np.zeros(n_rows) if first else batch["__mass"].to_numpy(zero_copy_only=False).copy()
            known = np.zeros(n_rows, bool)
            for a, b in pieces(offsets, PIECE_BYTES):
                cut = offsets[a : b + 1] - offsets[a]
                data = np.frombuffer(view[offsets[a] : offsets[b]], np.uint8)
                for t in trees:
                    sums = _costs(t, data, cut)
                    best = sums.argmin(axis=1)
                    least = np.minimum(bits[a:b], sums[np.arange(len(sums)), best])
                    old = np.where(mass[a:b] > 0, mass[a:b] * np.exp2(-np.minimum(np.where(mass[a:b] > 0, bits[a:b] - least, 0), 1000)), 0)
                    mass[a:b] = old + np.exp2(-np.minimum(sums - least[:, None], 1000)).sum(axis=1)
                    names[a:b] = np.where(least < bits[a:b], np.array(t.languages, object)[best], names[a:b])
                    bits[a:b] = least
                if last and trees:
                    known[a:b] = [has_letter(bytes(data[cut[i] : cut[i + 1]])) for i in range(b - a)]
            columns = {c: batch[c] for c in batch.schema.names if c not in (*drop, *STATE)}
            if last:
                columns |= {
                    OUT[0]: pa.array(np.where(known, names, UNKNOWN), pa.string()),
                    OUT[1]: pa.array(np.where(known, 1 / np.maximum(mass, 1), 0.0), pa.float64()),
                    OUT[2]: pa.array(np.where(known, bits / np.maximum(np.diff(offsets), 1), 0.0), pa.float64(), mask=~known),
                }
            else:
                columns |= dict(zip(STATE, (pa.array(names, pa.string()), pa.array(bits), pa.array(mass)), strict=True))
            yield pa.RecordBatch.from_pydict(columns)

    return score


def _costs(trees: ContextTrees, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A very long row is taken in parts that overlap by a context, so memory stays bounded."""
    if len(offsets) > 2 or len(data) <= PIECE_BYTES:
        return trees.costs(data, offsets)
    total = np.zeros((1, len(trees.languages)))
    for start in range(0, len(data), PIECE_BYTES):
        lead = min(trees.order, start)
        end = min(len(data), start + PIECE_BYTES)
        both = trees.costs(data[start - lead : end], np.array([0, end - start + lead]))
        total += both - (trees.costs(data[start - lead : start], np.array([0, lead])) if lead else 0)
    return total


def identify(docs: DataFrame, trees: Sequence[ContextTrees], keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (``text`` on demand), with ``lang_pred``, ``score`` (its share of the likelihood) and ``bits_per_byte``."""
    kept = [c for c in docs.columns if c not in OUT]
    shared = [docs.sparkSession.sparkContext.broadcast(t) for t in trees]
    each = PASS_LANGUAGES // LANGUAGES_AT_ONCE
    passes = [shared[at : at + each] for at in range(0, len(shared), each)] or [[]]
    state = bound_batches(docs).select(*kept)
    for k, some in enumerate(passes):
        last = k == len(passes) - 1
        drop = () if keep_text or not last else ("text",)
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(c for c in kept if c not in drop)).schema]
        fields += [f"{OUT[0]} string", f"{OUT[1]} double", f"{OUT[2]} double"] if last else [f"{STATE[0]} string", f"{STATE[1]} double", f"{STATE[2]} double"]
        state = state.mapInArrow(_scorer(some, drop, not k, last), ", ".join(fields))
        if not last:
            state = cut_lineage(state)
    return state


def worst_rate(labelled: DataFrame, trees: Sequence[ContextTrees], halves: Sequence[Sequence[ContextTrees]]) -> float | None:
    """The most bits a byte, beyond FREE_BITS, that any labelled row takes, by a model that has not learned from it or an equal text.

    That is the other half's (``halves``); rows of a language that only one half has are scored by ``trees``, learned from all.
    """
    rows = labelled.where("lang is not null and text is not null").withColumn("n_bytes", F.octet_length("text"))
    first, second = ({x for t in half for x in t.languages} for half in halves)
    lone = F.col("lang").isin(sorted(first ^ second))
    parts = [(rows.where(~lone & (_half() == k)), halves[1 - k]) for k in (0, 1)] if first & second else []
    if first ^ second:
        parts.append((rows.where(lone), trees))
    rate = F.col("bits_per_byte") - FREE_BITS / F.col("n_bytes")
    worst = [identify(part, by).where((F.col("lang_pred") != UNKNOWN) & (F.col("n_bytes") > 0)).agg(F.max(rate)).first()[0] for part, by in parts]
    return max((x for x in worst if x is not None), default=None)


def keep_identified(docs: DataFrame, least_score: float = 0.5, margin: float = MARGIN) -> DataFrame:
    """The rows of ``docs`` whose language is told: not ``und``, with a score of at least ``least_score``, and coded by it in
    no more than FREE_BITS and NO_MODEL or ``margin`` times the ``worst_rate`` a byte (other scripts, and encoded data, take more).

    Learns from the labelled rows of ``docs`` that are not held out; without any, all rows with a letter stay.
    """
    labelled = docs.select("doc_id", "text", "lang").where(~held_out())
    counts = _count(labelled, half=_half())
    trees = _learn(counts)
    if not trees:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    worst = worst_rate(labelled, trees, [_learn(counts.where(F.col("half") == k)) for k in (0, 1)])
    rows, restore = set_aside(docs, ("doc_id", "text"))
    told = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)
    if worst is not None:
        told &= F.col("bits_per_byte") <= max(NO_MODEL, margin * worst) + FREE_BITS / F.greatest(F.octet_length("text"), F.lit(1))
    return restore(identify(rows, trees, keep_text=True).where(told))


def held_out(doc_id: str = "doc_id"):
    """A quarter of the ids is never learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op6_language_id(docs: DataFrame) -> DataFrame:
    trees = fit(docs.select("doc_id", "text", "lang").where(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), trees)
