"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton holds every run of words of every item. Document words stream through it; the longest match that
ends at each word is tracked, and where it reaches the window length (or a whole item shorter than that) those words
are hit. ``decontaminate`` cuts hit spans out of the text and drops documents that are hit beyond a limit.

Items are taken in blocks of bounded size, so the automaton that is broadcast never grows with the benchmark. One block, the
usual case, takes one pass over the documents. More of them take a pass each, over documents that are written once: a pass
only leaves the rows that are hit, and a last one puts their spans together.

Edge cases: null or empty texts have no words and stay; empty items are ignored, repeated items count once per
item_id, items without id hit words but are not listed; repeated documents are judged one by one; columns that
clash with the added ones (or ``__row``) are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyloom.llm.columns import bound_batches, set_aside
from tallyloom.llm.textbatch import utf8_rows, words_of
from tallyloom.plans.lineage import cut_lineage

WINDOW = 10
#: Bytes of item texts whose automaton is built and broadcast at a time.
BLOCK_BYTES = 2_000_000
_NEVER = 1 << 60


class ItemAutomaton:
    """A suffix automaton over words; ``items`` are (id or None, words)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        short: dict[int, dict[int, set[str]]] = {}
        self.owners: dict[int, set[str]] = {}
        for name, words in items:
            state = 0
            for w in words:
                state = self.next[state][w]
                if len(words) >= window:
                    self._own(state, name)
            if 0 < len(words) < window:
                short.setdefault(state, {}).setdefault(len(words), set()).update([name] if name is not None else [])
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        self.alarm = [_NEVER] * len(self.length)
        self.wide = [0] * len(self.length)  # the state of the last `window` words
        for s in order:
            up = self.link[s]
            whole = sorted([*short.get(s, {}).items(), *self.short.get(up, [])], key=lambda x: x[0])
            if whole:
                self.short[s] = whole
                self.alarm[s] = whole[0][0]
            if self.length[s] >= window:
                self.wide[s] = self.wide[up] or s
                if self.owners.get(self.wide[s]) is not None:
                    self.alarm[s] = min(self.alarm[s], window)

    def _extend(self, last: int, word: bytes) -> int:
        if (known := self.next[last].get(word)) is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._add({}, self.length[last] + 1)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last < 0:
            self.link[state] = 0
        else:
            known = self.next[last][word]
            self.link[state] = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        return state

    def _add(self, edges: dict[bytes, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, last: int, word: bytes, known: int) -> int:
        """A state for the shorter of ``known``'s strings."""
        twin = self._add(dict(self.next[known]), self.length[last] + 1)
        self.link[twin], self.link[known] = self.link[known], twin
        while last >= 0 and self.next[last].get(word) == known:
            self.next[last][word] = twin
            last = self.link[last]
        return twin

    def _own(self, state: int, name: str | None) -> None:
        while state > 0 and self.length[state] >= self.window:
            owners = self.owners.setdefault(state, set())
            if name in owners:
                return
            if name is not None:
                owners.add(name)
            state = self.link[state]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word spans (end exclusive, in order, apart), and the ids of items with occurring windows."""
        following, link, length, alarm, window = self.next, self.link, self.length, self.alarm, self.window
        hit: bytearray | None = None
        names: set[str] = set()
        state = matched = 0
        for i, w in enumerate(words):
            to = following[state].get(w)
            if to is None:
                if not state:
                    continue
                state = link[state]
                while state and w not in following[state]:
                    state = link[state]
                matched = length[state]
                to = following[state].get(w)
                if to is None:
                    continue
            state = to
            matched += 1
            if matched >= alarm[state]:
                hit = hit if hit is not None else bytearray(len(words))
                reach = 0
                for n, owners in self.short.get(state, ()):
                    if n <= matched:
                        reach = max(reach, n)
                        names |= owners
                if matched >= window and self.wide[state]:
                    reach = window
                    names |= self.owners[self.wide[state]]
                hit[i + 1 - reach : i + 1] = b"\1" * reach
        return ([m.span() for m in re.finditer(b"\1+", hit)] if hit else []), names


FOUND = StructType(
    [
        StructField("_n_words", LongType()),
        StructField("_spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))),
        StructField("_items", ArrayType(StringType())),
    ]
)
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items in blocks of bounded size; the driver holds one block (and one partition of items) at a time."""
    block: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").where("text is not null").toLocalIterator():
        data = text.encode()
        if words := words_of(data):
            block.append((name, words))
            size += len(data)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    yield block


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of ``spans`` and what stands between them."""
    bounds = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
    out, at = [], 0
    for start, end in spans:
        out.append(text[at : bounds[start][0]])
        at = bounds[end - 1][1]
    return b"".join([*out, text[at:]]).decode("utf-8", "replace")


def _found(columns: dict, texts: Iterator[bytes], leaks: Iterator[tuple[list[tuple[int, int]], list[str]]], clean: bool) -> pa.RecordBatch:
    """``columns`` with what was found in each text."""
    n_words, spans, items, cleaned = [], [], [], []
    for text, (here, names) in zip(texts, leaks, strict=True):
        n_words.append(len(words_of(text)))
        spans.append([{"start": s, "end": e} for s, e in here])
        items.append(names)
        if clean:
            cleaned.append(_cut(text, here) if here else None)
    columns |= {"_n_words": pa.array(n_words, pa.int64()), "_spans": pa.array(spans, _ARROW_SPANS), "_items": pa.array(items, pa.list_(pa.string()))}
    if clean:
        columns["_cut"] = pa.array(cleaned, pa.string())
    return pa.RecordBatch.from_pydict(columns)


def _scan_all(shared, clean: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every row, with what one automaton finds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: ItemAutomaton = shared.value
        for batch in batches:
            leaks = ((here, sorted(names)) for here, names in (machine.scan(words_of(t)) for t in utf8_rows(batch["text"])))
            yield _found({c: batch[c] for c in batch.schema.names}, utf8_rows(batch["text"]), leaks, clean)

    return scan


def _scan_hits(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Only rows that one automaton hits: their number, spans and items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine: ItemAutomaton = shared.value
        for batch in batches:
            rows, spans, items = [], [], []
            for row, text in zip(batch["__row"].to_pylist(), utf8_rows(batch["text"]), strict=True):
                here, names = machine.scan(words_of(text))
                if here:
                    rows.append(row)
                    spans.append([{"start": s, "end": e} for s, e in here])
                    items.append(sorted(names))
            columns = {"__row": pa.array(rows, pa.int64()), "_spans": pa.array(spans, _ARROW_SPANS), "_items": pa.array(items, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def _put_together(clean: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch["_spans"].to_pylist(), batch["_items"].to_pylist(), strict=True)
            leaks = ((_merged([(s["start"], s["end"]) for s in spans or ()], []), sorted(set(items or ()))) for spans, items in both)
            kept = {c: batch[c] for c in batch.schema.names if c not in ("_spans", "_items")}
            yield _found(kept, utf8_rows(batch["text"]), leaks, clean)

    return merge


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, clean: bool = False) -> DataFrame:
    """Add ``_n_words``, ``_spans`` (hit word spans), ``_items`` and, if ``clean``, ``_cut`` (the text without its spans)."""
    docs = bound_batches(docs).drop("_n_words", "_spans", "_items", "_cut")
    schema = StructType([*docs.schema, *FOUND] + [StructField("_cut", StringType())] * clean)
    send = lambda block: docs.sparkSession.sparkContext.broadcast(ItemAutomaton(block, window))
    blocks = _blocks(benchmark)
    first, second = next(blocks), next(blocks, None)
    if not second:
        return docs.mapInArrow(_scan_all(send(first), clean), schema)
    numbered = cut_lineage(docs.withColumn("__row", F.monotonically_increasing_id()))
    hits = None
    for block in chain([first, second], blocks):
        if block:
            found = numbered.select("__row", "text").mapInArrow(_scan_hits(send(block)), StructType([StructField("__row", LongType()), *FOUND.fields[1:]]))
            found = cut_lineage(found)
            hits = found if hits is None else hits.unionByName(found)
    together = hits.groupBy("__row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.flatten(F.collect_list("_items")).alias("_items"))
    joined = numbered.join(together, "__row", "left").select(*docs.columns, "_spans", "_items")
    return joined.mapInArrow(_put_together(clean), schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.0, cut: bool = True
) -> DataFrame:
    """Drop documents of which more than ``max_coverage`` of the words is hit; cut the spans out of the others.

    At the default every document with a hit goes. Returns the columns of ``docs``; where spans are cut, ``n_chars``
    (if present) follows the text.
    """
    length = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    rows, restore = set_aside(docs, ("text", "n_chars"))
    found = find_leaks(rows, benchmark, window, clean=cut and max_coverage > 0)
    hit = F.expr("aggregate(_spans, 0L, (n, s) -> n + s.end - s.start)")
    kept = found.where(hit <= max_coverage * F.col("_n_words"))
    if cut and max_coverage > 0:
        kept = kept.withColumn("text", F.coalesce("_cut", "text"))
        if length:
            kept = kept.withColumn("n_chars", F.when(F.col("_cut").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(length))
    return restore(kept)


def op3_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), benchmark).drop("text")
    n_hit = F.expr("aggregate(_spans, 0L, (n, s) -> n + s.end - s.start)")
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

