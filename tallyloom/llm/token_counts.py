"""Token counts of every prefix of a text, by dynamic programming over a byte-pair vocabulary.

A tokenizer of words drops white space, so a text's tokens are those of its runs between ASCII spaces. Inside a word, the last
token of a prefix's encoding is the one vocabulary entry that ends there and may follow the last token of what is before it;
whether two tokens may stand side by side follows from the merges alone. So the count of each prefix is one more than that
of an earlier prefix, and one walk over a word yields the exact counts of all its prefixes. Counts at the ends of runs add
up, and questions about any prefix are answered from the stored counts, without encoding anything again.

Defined results: null text counts as empty (0 tokens, 0 bytes); white space alone has no tokens; a special token's string is
one token, and a part of it is ordinary text; repeated rows and equal or null ids keep a row each; further columns stay.
A prefix ends between characters: a mark that composes with the letter before it belongs to that letter, and positions
inside such a character hold the count of its end. Texts are read in pieces of bounded size, so a text may be of any
length; a single word of n bytes, which is walked as a whole, takes some 20 n bytes of memory.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tallyloom.llm.columns import bound_batches, set_aside
from tallyloom.llm.textbatch import utf8_column

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
#: Bytes of text that are cut into runs at once, and runs or pairs whose results a worker keeps.
PIECE_BYTES, KEPT_RUNS, KEPT_PAIRS = 4 << 20, 200_000, 2_000_000
#: Words beyond so many symbols are walked one by one, and not remembered.
LONG_WORD = 64
_NEVER = 1 << 60
# The pattern of the vocabulary (as its file writes it) and the same for lower-case ASCII.
WORDS_OF = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def vocabulary_path(name: str) -> str:
    """A file of the public vocabularies by its name, or any path."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Merges:
    """Which tokens may stand side by side, told by the order of merges.

    Each token is made by one merge of two earlier tokens, so merges run in the order of their ranks, equal ones from the left.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]) -> None:
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        used: set[int] = set()
        for rank, (left, right) in enumerate(merges):
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            if whole in self.parts or whole in used or whole in (a, b):
                raise ValueError("a token that several merges make, or that is used before it is made")
            self.rank[a << 32 | b] = rank
            self.parts[whole] = (a, b, rank)
            used |= {a, b}
        self.fits: dict[int, bool] = {}
        self.whole = {t: True for t in vocab.values() if t not in self.parts}
        for token, (a, b, rank) in self.parts.items():  # in the order of ranks: parts come first
            self.whole[token] = self.whole[a] and self.whole[b] and self._walk(a, b, rank)
        self._as_arrays(max(vocab.values()) + 1)

    def _as_arrays(self, n: int) -> None:
        """The same for many pairs at once: what lies at a token's right and left edge, by depth, and when it is merged away."""
        edges = []
        for side in (1, 0):
            chains = {t: [t] for t in range(n)}
            for token in self.parts:  # parts come first
                chains[token] = [token, *chains[self.parts[token][side]]]
            depth = max(map(len, chains.values()))
            nodes, gone = np.zeros((n, depth), np.int32), np.full((n, depth), _NEVER, np.int64)
            for token, chain in chains.items():
                nodes[token, : len(chain)] = chain
                gone[token, 1 : len(chain)] = [self.parts[x][2] for x in chain[:-1]]
            edges.append((nodes, gone, np.array([len(c) - 1 for c in chains.values()], np.int8)))
        self.edges = edges
        self.pair_keys = np.array(sorted(self.rank), np.int64)
        self.pair_ranks = np.array([self.rank[k] for k in self.pair_keys.tolist()], np.int64)

    def fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``fit`` for many pairs."""
        keys, back = np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)
        left, right = keys >> 32, keys & 0xFFFFFFFF
        (ends, end_gone, end_depth), (starts, start_gone, start_depth) = self.edges
        i, j = end_depth[left].astype(np.int64), start_depth[right].astype(np.int64)
        good, open_ = np.ones(len(keys), bool), np.arange(len(keys))
        while len(open_):
            x, y, ix, jy = left[open_], right[open_], i[open_], j[open_]
            gone_left, gone_right = end_gone[x, ix], start_gone[y, jy]
            key = ends[x, ix].astype(np.int64) << 32 | starts[y, jy]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NEVER)
            crossed = (across < gone_left) & (across <= gone_right) & (across < _NEVER)
            good[open_[crossed]] = False
            up_left = (ix > 0) & ((gone_left <= gone_right) | (jy == 0))
            i[open_] -= up_left
            j[open_] -= ~up_left & (jy > 0)
            open_ = open_[~crossed & ((ix > 0) | (jy > 0))]
        return good[back]

    def _walk(self, a: int, b: int, end: int) -> bool:
        """No merge crosses the border of ``a`` and ``b`` before rank ``end``."""
        ends, starts = [a], [b]  # what the border touches, from the whole token to its single symbol
        while ends[-1] in self.parts:
            ends.append(self.parts[ends[-1]][1])
        while starts[-1] in self.parts:
            starts.append(self.parts[starts[-1]][0])
        i, j = len(ends) - 1, len(starts) - 1
        while True:
            gone_left = self.parts[ends[i - 1]][2] if i else end
            gone_right = self.parts[starts[j - 1]][2] if j else end
            across = self.rank.get(ends[i] << 32 | starts[j], _NEVER)
            # of equal merges the left one comes first
            if across < gone_left and across <= gone_right and across < _NEVER:
                return False
            if i and (gone_left <= gone_right or not j):
                i -= 1
            elif j:
                j -= 1
            else:
                return True

    def fit(self, pair: int) -> bool:
        """Encoding the text of the two tokens of ``pair`` yields just these two; remembered in ``fits``."""
        if len(self.fits) >= KEPT_PAIRS:
            self.fits.clear()
        found = self.fits[pair] = self._walk(pair >> 32, pair & 0xFFFFFFFF, _NEVER)
        return found


def _backward_composing() -> frozenset[str]:
    """Characters of combining class 0 that may compose with one before them."""
    seconds = set(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))  # fixed values: Hangul vowels and finals
    for c in range(0x300, 0x20000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


class PrefixCounter:
    """Counts of all prefixes under one vocabulary file (of a BPE over words whose white space is dropped)."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, normalizers

        stored = json.loads(Path(path).read_text(encoding="utf-8"))
        model, self._library = stored["model"], Tokenizer.from_file(path)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
        added = stored.get("added_tokens") or []
        if model.get("type", "BPE") != "BPE" or odd or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is no plain BPE vocabulary")
        if [x[0] for x in self._library.pre_tokenizer.pre_tokenize_str(" a\n b")] != ["a", "b"]:
            raise ValueError(f"{path} keeps white space in its tokens")
        specials = sorted((t["content"] for t in added if t["special"]), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, specials))) if specials else None
        suffix, vocab = model.get("end_of_word_suffix") or "", model["vocab"]
        self._merges = Merges(vocab, [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]])
        #: A tree of token texts; a node is [children, id of the token inside a word, id of the token that ends one].
        self._tree: list = [{}, None, None]
        for text, token in vocab.items():
            if not self._merges.whole[token]:
                continue
            ends = bool(suffix) and text.endswith(suffix)
            node = self._tree
            for c in text[: len(text) - len(suffix)] if ends else text:
                node = node[0].setdefault(c, [{}, None, None])
            for slot in (1, 2) if not suffix else (2,) if ends else (1,):
                node[slot] = token
        self._longest = max(map(len, vocab))
        #: The tree for many words at once: a child by node and symbol, and the tokens of each node (-1: none).
        nodes, edges = [self._tree], {}
        for k, node in enumerate(nodes):  # grows while it runs
            for c, child in node[0].items():
                edges[k << 16 | ord(c)] = len(nodes)
                nodes.append(child)
        self._edges = np.array(sorted(edges), np.int64)
        self._children = np.array([edges[k] for k in self._edges.tolist()], np.int64)
        self._ids = np.array([[-1 if t is None else t for t in node[1:]] for node in nodes], np.int64)
        #: Printable ASCII is its own symbols and is cut alike by any reading of the vocabulary's pattern.
        self._plain_ascii = re.compile(WORDS) if WORDS_OF in Path(path).read_text(encoding="utf-8") else None
        self._compose = normalizers.NFC()
        self._characters: dict[str, str] = {}
        self._totals: dict[str, int] = {}
        self._seconds: frozenset[str] | None = None

    def word(self, symbols: str) -> array:
        """For a word in the vocabulary's symbols: the token counts of its prefixes, each read as a word of its own."""
        n, tree, fits, fit = len(symbols), self._tree, self._merges.fits, self._merges.fit
        # no token reaches further than the longest one, so what was before it is written over
        ring = self._longest + 1
        counts, inner, last = array("i", bytes(4 * (n + 1))), [0] * ring, [0] * ring
        for start in range(n):
            here = start % ring
            before, tokens, end, node = last[here] << 32, inner[here] + 1, start, tree
            if start and tokens == 1:
                raise ValueError("a symbol that the vocabulary lacks")
            inner[here] = 0
            for c in symbols[start : start + self._longest]:
                node = node[0].get(c)
                if node is None:
                    break
                end += 1
                # each prefix has one encoding, so an end that is reached needs no further tries
                token = node[1]
                if token is not None and not inner[end % ring]:
                    if start and (fitting := fits.get(before | token)) is None:
                        fitting = fit(before | token)
                    if not start or fitting:
                        last[end % ring], inner[end % ring] = token, tokens
                token = node[2]
                if token is not None and not counts[end]:
                    if start and (fitting := fits.get(before | token)) is None:
                        fitting = fit(before | token)
                    if not start or fitting:
                        counts[end] = tokens
        return counts

    def words(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``word`` for many words at once: all their counts end to end, and where each word's begin."""
        sizes = np.array([len(w) for w in batch], np.int64)
        flat = np.frombuffer("".join(batch).encode("utf-16-le"), np.uint16).astype(np.int64)
        first = np.cumsum(sizes) - sizes
        begin = first + np.arange(len(batch))  # a word of n symbols has n + 1 counts
        counts, inner, last = (np.zeros(len(flat) + len(batch), np.int64) for _ in range(3))
        for start in range(int(sizes.max(initial=0))):
            word = np.flatnonzero(sizes > start)
            if start and not inner[begin[word] + start].all():
                raise ValueError("a symbol that the vocabulary lacks")
            node, end = np.zeros(len(word), np.int64), start
            while len(word):
                key = node << 16 | flat[first[word] + end]
                at = np.minimum(np.searchsorted(self._edges, key), len(self._edges) - 1)
                found = self._edges[at] == key
                word, node, end = word[found], self._children[at[found]], end + 1
                place, origin = begin[word] + end, begin[word] + start
                # each prefix has one encoding, so an end that is reached needs no further tries
                tries = [(np.flatnonzero((self._ids[node, slot] >= 0) & (reached[place] == 0)), slot) for slot, reached in ((0, inner), (1, counts))]
                if start:
                    pairs = [(last[origin[t]], self._ids[node[t], slot]) for t, slot in tries]
                    good = self._merges.fit_all(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
                    cut = len(tries[0][0])
                    tries = [(t[g], slot) for (t, slot), g in zip(tries, (good[:cut], good[cut:]), strict=True)]
                (t, _), (u, _) = tries
                last[place[t]], inner[place[t]] = self._ids[node[t], 0], inner[origin[t]] + 1
                counts[place[u]] = inner[origin[u]] + 1
                more = sizes[word] > end
                word, node = word[more], node[more]
        return counts, begin

    def _split(self, text: str) -> list[str]:
        """``text`` in characters: single code points, or a letter with all that composes with it."""
        if text.isascii() or self._compose.normalize_str(text) == text:
            return list(text)
        if self._seconds is None:
            self._seconds = _backward_composing()
        out: list[str] = []
        start = 0
        for k, c in enumerate(text):
            if k and not unicodedata.combining(c) and c not in self._seconds:
                out.append(text[start:k])
                start = k
        out.append(text[start:])
        return out

    def _plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a run without special tokens, by code points (0 first)."""
        if text.isascii():
            read, ends = text.lower(), None
        else:
            pieces = self._split(text)
            normal, known = self._library.normalizer.normalize_str, self._characters
            for c in {p for p in pieces if p not in known}:
                if len(known) >= KEPT_RUNS:
                    known.clear()
                known[c] = normal(c)
            shown = [known[p] if p in known else normal(p) for p in pieces]
            read, ends = "".join(shown), np.cumsum([len(x) for x in shown])
        counts, total, at = np.zeros(len(read) + 1, np.int32), 0, 0
        for symbols, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(read):
            counts[at : a + 1] = total
            piece = read[a:b]
            if len(symbols) == len(piece):
                counts[a + 1 : b + 1] = self.word(symbols)[1:]
            else:
                sizes = np.cumsum([len(c.encode()) for c in piece])
                counts[a + 1 : b + 1] = np.frombuffer(self.word(symbols), np.int32)[sizes]
            if piece[0] == "'" and len(piece) > 2 and piece[1:].isalpha():  # part of a contraction is a sign and a word
                tail = self.word(symbols[1:])
                counts[a + 2 : b] = self.word("'")[1] + np.frombuffer(tail, np.int32)[1 : len(piece) - 1]
            counts[a + 1 : b + 1] += total
            total, at = int(counts[b]), b
        counts[at:] = total
        if ends is None:
            return counts
        owners = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        return np.concatenate(([0], counts[ends[owners]])).astype(np.int32)

    def run(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a run between spaces, by code points."""
        parts, total, at = [np.zeros(1, np.int32)], 0, 0
        for found in self._special.finditer(text) if self._special else ():
            # until its last character, a special token is ordinary text
            parts.append(self._plain(text[at : found.end() - 1])[1:] + total)
            total += int(self._plain(text[at : found.start()])[-1]) + 1
            parts.append(np.array([total], np.int32))
            at = found.end()
        if at < len(text):
            parts.append(self._plain(text[at:])[1:] + total)
        return np.concatenate(parts)

    def _words_of(self, run: str) -> list[str] | None:
        """The words of a run, in the vocabulary's symbols; None where special tokens may be in it."""
        if self._special and self._special.search(run):
            return None
        if self._plain_ascii is not None and run.isascii() and run.isprintable():
            return self._plain_ascii.findall(run.lower())
        return [w for w, _ in self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(run))]

    def totals(self, runs: list[str]) -> list[int]:
        """The counts of whole runs between spaces."""
        parts = [self._words_of(r) for r in runs]
        fresh = {w for p in parts if p for w in p if w not in self._totals}
        if len(self._totals) + len(fresh) > KEPT_RUNS:
            self._totals.clear()
            fresh = {w for p in parts if p for w in p}
        short = [w for w in fresh if len(w) <= LONG_WORD]
        counts, begin = self.words(short)
        self._totals.update(zip(short, counts[begin + [len(w) for w in short]].tolist(), strict=True) if short else ())
        known = self._totals
        return [
            int(self.run(r)[-1]) if p is None else sum([known[w] if w in known else self.word(w)[-1] for w in p])
            for r, p in zip(runs, parts, strict=True)
        ]

    def table(self, text: str) -> np.ndarray:
        """The token counts of ``text[:0]``, ``text[:1]``, ... ``text``."""
        counts, total = np.zeros(len(text) + 1, np.int32), 0
        for found in re.finditer(r"[^\t-\r ]+", text):
            counts[found.start() + 1 : found.end() + 1] = self.run(found.group())[1:] + total
            total = int(counts[found.end()])
            counts[found.end() :][: 1 + len(text) - found.end()] = total
        return counts


_counters: dict[str, PrefixCounter] = {}


def counter(vocabulary: str) -> PrefixCounter:
    """The counter of a vocabulary, one a worker."""
    if vocabulary not in _counters:
        _counters[vocabulary] = PrefixCounter(vocabulary_path(vocabulary))
    return _counters[vocabulary]


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE_BYTES that end at a row's end or before a space."""
    start, size = 0, len(raw)
    while start < size:
        end = min(start + PIECE_BYTES, size)
        while end < size:
            border = int(offsets[min(np.searchsorted(offsets, end), len(offsets) - 1)])
            spaces = np.flatnonzero(_SPACES[raw[end : min(end + 65536, border)]])
            if len(spaces) or border <= end + 65536:
                end = end + int(spaces[0]) if len(spaces) else border
                break
            end += 65536
        yield start, end
        start = end


class RunTotals:
    """Token totals of runs, remembered while there are not too many."""

    def __init__(self, counts: PrefixCounter) -> None:
        self.counts, self.known = counts, {}

    def of(self, runs: list[bytes]) -> np.ndarray:
        if len(self.known) + len(runs) > KEPT_RUNS:
            self.known.clear()
        known = self.known
        fresh = [r for r in runs if r not in known]
        found = dict(zip(fresh, self.counts.totals([r.decode() for r in fresh]), strict=True))
        known.update((r, n) for r, n in found.items() if len(r) <= LONG_WORD)
        return np.fromiter((known[r] if r in known else found[r] for r in runs), np.int64, len(runs))


def _batch_counts(column: pa.Array, totals: RunTotals, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, tokens and code points within ``limit`` tokens of each row."""
    data, offsets = utf8_column(column)
    raw, rows = np.frombuffer(data, np.uint8), len(offsets) - 1
    tokens, kept = np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    for first, end in _pieces(raw, offsets):
        word = ~_SPACES[raw[first:end]]
        cut = edge[first : end + 1]
        starts = np.flatnonzero(word & (cut[:-1] | ~np.concatenate(([False], word[:-1]))))
        if not len(starts):
            continue
        stops = np.flatnonzero(word & (cut[1:] | ~np.concatenate((word[1:], [False])))) + 1
        packed = np.concatenate(([0], np.cumsum(stops - starts)))
        runs = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(packed), pa.py_buffer(raw[first:end][word])])
        coded = runs.dictionary_encode()
        each = totals.of(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        owner = np.searchsorted(offsets, starts + first, side="right") - 1
        sums = np.concatenate(([0], np.cumsum(each)))
        here, begin = np.unique(owner, return_index=True)
        bounds = np.append(begin, len(starts))
        for row, a, b in zip(here.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            before = int(tokens[row])
            tokens[row] += int(sums[b] - sums[a])
            if kept[row] < 0 and tokens[row] > limit:
                # the last run that something of may still fit
                k = a + int(np.searchsorted(sums[a:b] - sums[a] + before, limit, side="right")) - 1
                spent = before + int(sums[k] - sums[a])
                inside = totals.counts.run(bytes(raw[first + starts[k] : first + stops[k]]).decode()) + spent
                # the run before may leave out spaces at a piece's start: they belong to the prefix
                head = bytes(raw[offsets[row] : first + starts[k]]).decode()
                kept[row] = len(head) + int(np.flatnonzero(inside <= limit)[-1])
    for row in np.flatnonzero(kept < 0).tolist():
        kept[row] = int(np.count_nonzero((raw[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80))
    return np.diff(offsets), tokens, kept


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens``, ``over_limit`` and ``kept_chars``: the longest prefix of at most ``limit`` tokens.

    Its other columns stay, but for those of these names, which give way.
    """
    made = ("n_bytes", "n_tokens", "over_limit", "kept_chars")
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made))
    aside, restore = set_aside(docs, (text,))
    schema = StructType([*aside.schema.fields, *(StructField(n, LongType()) for n in ("n_bytes", "n_tokens", "kept_chars"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = RunTotals(counter(vocabulary))
        for batch in batches:
            found = _batch_counts(batch.column(text), totals, limit)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=[*batch.schema.names, "n_bytes", "n_tokens", "kept_chars"])

    counted = bound_batches(aside).mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    return restore(counted, *made)


def with_prefix_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with ``prefix_steps``: per code point the change of the token count, as 32-bit integers (null text: none)."""

    @F.udf(BinaryType(), useArrow=True)
    def steps(value: str | None) -> bytes:
        return np.diff(counter(vocabulary).table(value or "")).astype("<i4").tobytes()

    return docs.withColumn("prefix_steps", steps(F.col(text)))


def tokens_of_prefix(steps: Column, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points, from stored ``prefix_steps``; more than there are means all."""

    @F.udf(LongType(), useArrow=True)
    def answer(stored: bytes | None, most: int | None) -> int | None:
        return None if stored is None or most is None else int(np.frombuffer(stored, "<i4")[: max(most, 0)].sum())

    return answer(steps, F.lit(chars) if isinstance(chars, int) else chars)


def chars_within(steps: Column, budget: Column | int) -> Column:
    """The longest prefix, in code points, of at most ``budget`` tokens, from stored ``prefix_steps``; a negative budget has none."""

    @F.udf(LongType(), useArrow=True)
    def answer(stored: bytes | None, most: int | None) -> int | None:
        if stored is None or most is None:
            return None
        fits = np.flatnonzero(np.concatenate(([0], np.cumsum(np.frombuffer(stored, "<i4")))) <= most)
        return int(fits[-1]) if len(fits) else None

    return answer(steps, F.lit(budget) if isinstance(budget, int) else budget)


def op12_token_counts(docs: DataFrame) -> DataFrame:
    """Token counts of every whole text, under the contract of the query."""
    counted = count_tokens(docs.select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "kept_chars")
