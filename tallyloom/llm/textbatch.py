"""Raw UTF-8 bytes of Arrow string columns, and word hashes of whole batches in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[memoryview, np.ndarray]:
    """All bytes of a string or binary column end to end, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"").cast(column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return memoryview(b""), np.zeros(len(column) + 1, np.int64)
    where = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    where = where.astype(np.int64)
    return memoryview(data or b"")[where[0] : where[-1]], where - where[0]


def utf8_rows(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    data, offsets = utf8_column(column)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield bytes(data[start:end])


#: Words are runs of 0-9, a-z and all that is not ASCII, after A-Z became a-z; anything else separates them.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def folded(text: bytes) -> bytes:
    """``text`` in lower case, with a space for each byte that separates words."""
    return text.translate(_FOLD)


def words_of(text: bytes) -> list[bytes]:
    return folded(text).split()


_MULTIPLIER, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_FOLDED = np.frombuffer(_FOLD, np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def hashed_words(data: memoryview, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, the row of each word, and the first byte of each word.

    A word's hash is a polynomial in its byte values: a difference of running sums, scaled back to position 0.
    """
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    plain = _FOLDED[raw]
    inside = plain != 32
    edge = np.zeros(len(raw) + 1, bool)
    edge[0] = edge[-1] = True
    edge[offsets] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = _power_table(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[plain] * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins])
    rows = np.searchsorted(offsets, begins, side="right") - 1
    return hashes, rows, begins


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer row is a range of its own)."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = end
