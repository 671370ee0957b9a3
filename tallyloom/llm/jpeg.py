"""Media columns: baseline JPEG in numpy.

``encode_payloads`` stores bytes losslessly as grey baseline JPEGs: one 8x8 block a byte, flat, so that its DC level is
the byte; a row of 64 blocks is a restart interval. ``decode_dc`` is a decoder for any baseline JPEG (8 bit, Huffman, up
to 4 components, any sampling): it parses the markers, Huffman-decodes the scan and keeps the DC levels, which are the
image scaled down by 8. The AC symbols are decoded only to be skipped. All restart intervals of all images of a batch
are decoded side by side, one symbol at a time, by table look-ups; an image without restart intervals is one such lane,
and where few lanes are left they are walked one by one.

Edge cases: a null text is the empty payload, which is stored as 64 zero bytes; payloads beyond 65,528 lines of pixels
continue in further JPEGs, end to end; bytes that are no JPEG, are truncated or use another process (progressive,
12 bit, arithmetic) are not decoded, which ``describe_media`` shows as null dimensions; repeated rows give equal values.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import bound_batches
from tallyloom.llm.textbatch import pieces, utf8_column

BLOCKS = 64
MAX_ROWS = 8191
PIECE_BYTES = 1 << 19

#: Code lengths of the DC categories 0 to 8 of what is written here; the one AC symbol (end of block) has one bit.
DC_LENGTHS = (4, 4, 3, 3, 3, 4, 4, 2, 5)


class JpegError(ValueError):
    """Not a baseline JPEG, or broken off."""


def canonical_codes(lengths: list[int]) -> list[int]:
    """Codes given in order of length, as JPEG assigns them."""
    codes, code, last = [], 0, 0
    for n in lengths:
        code <<= n - last
        codes.append(code)
        code, last = code + 1, n
    return codes


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, symbols: list[int], lengths: list[int]) -> bytes:
    return _segment(0xC4, bytes([kind]) + bytes(lengths.count(n) for n in range(1, 17)) + bytes(symbols))


_DC_SYMBOLS = sorted(range(len(DC_LENGTHS)), key=lambda s: (DC_LENGTHS[s], s))
_DC_CODES = dict(zip(_DC_SYMBOLS, canonical_codes([DC_LENGTHS[s] for s in _DC_SYMBOLS]), strict=True))
_DIFF = np.arange(-255, 256)
_CATEGORY = np.array([int(abs(d)).bit_length() for d in _DIFF])
#: For each difference + 255: the code, the bits of the difference and the end of the block, and how many bits that is.
_WORDS = np.array(
    [((_DC_CODES[c] << c | (d if d >= 0 else d + (1 << c) - 1)) << 1) for d, c in zip(_DIFF.tolist(), _CATEGORY.tolist(), strict=True)],
    np.uint32,
)
_SIZES = np.array([DC_LENGTHS[c] + c + 1 for c in _CATEGORY.tolist()], np.int64)


def _head(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0]) + bytes([8] * 64))
        + _segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (BLOCKS * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + _table(0x00, _DC_SYMBOLS, [DC_LENGTHS[s] for s in _DC_SYMBOLS])
        + _table(0x10, [0], [1])
        + _segment(0xDD, BLOCKS.to_bytes(2, "big"))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def encode_payloads(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """JPEGs of payloads, each a multiple of 64 bytes, end to end in ``data``; all rows of blocks are coded at once."""
    grid = data.reshape(-1, BLOCKS).astype(np.int16) - 128
    diff = np.diff(grid, axis=1, prepend=np.int16(0)) + 255
    words, sizes = _WORDS[diff], _SIZES[diff]
    bits = sizes.sum(axis=1)
    n_bytes = (bits + 7) >> 3
    first = np.concatenate(([0], np.cumsum(n_bytes)))
    at = (first[:-1] * 8)[:, None] + np.cumsum(sizes, axis=1) - sizes
    # a word has at most 14 bits, so it touches at most three bytes; all are added into place
    out = np.zeros(int(first[-1]) + 4, np.uint8)
    shifted = words.astype(np.uint64).ravel() << (32 - (at & 7) - sizes).astype(np.uint64).ravel()
    byte = (at >> 3).ravel()
    for k in range(3):
        part = ((shifted >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64)
        out += np.bincount(byte + k, part, len(out)).astype(np.uint8)
    out = out[: first[-1]]
    pad = (n_bytes * 8 - bits).astype(np.uint8)
    out[first[1:] - 1] |= (np.uint8(1) << pad) - np.uint8(1)

    stuffed = np.flatnonzero(out == 0xFF)
    full = np.insert(out, stuffed + 1, 0) if len(stuffed) else out
    edges = first + np.searchsorted(stuffed, first)
    coded, images = full.tobytes(), []
    for a, b in zip((offsets[:-1] // BLOCKS).tolist(), (offsets[1:] // BLOCKS).tolist(), strict=True):
        image = []
        for low in range(a, b, MAX_ROWS):
            high = min(b, low + MAX_ROWS)
            image.append(_head(high - low))
            for k, row in enumerate(range(low, high)):
                if k:
                    image.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
                image.append(coded[edges[row] : edges[row + 1]])
            image.append(b"\xff\xd9")
        images.append(b"".join(image))
    return images


@dataclass
class Frame:
    """What the markers say, and where each restart interval's bytes are."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of the DC level
    tables: dict[int, bytes] = field(default_factory=dict)
    interval: int = 0
    order: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC and AC table
    scan: tuple[int, int] = (0, 0)

    def units(self) -> list[int]:
        """Component of each block of an MCU."""
        if len(self.order) == 1:
            return [self.order[0][0]]
        return [c for c, _, _ in self.order for _ in range(self.components[c][1] * self.components[c][2])]

    def mcus(self) -> tuple[int, int]:
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        if len(self.order) == 1:
            _, ch, cv, _ = self.components[self.order[0][0]]
            return -(-(-(-self.width * ch // h)) // 8), -(-(-(-self.height * cv // v)) // 8)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))


def parse(data: bytes, at: int = 0) -> tuple[Frame, int]:
    """The frame that starts at ``at``, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise JpegError("no start of image")
    frame, at = Frame(), at + 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("broken marker")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if n < 2 or len(body) != n - 2:
            raise JpegError("broken segment")
        if marker == 0xC0 or marker == 0xC1:
            if len(body) < 6 or body[0] != 8 or len(body) != 6 + 3 * body[5] or not 1 <= body[5] <= 4:
                raise JpegError("not 8 bit")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.components = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, len(body), 3)]
            if not frame.width or not frame.height or any(not 1 <= x <= 4 for c in frame.components for x in c[1:3]):
                raise JpegError("bad frame")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise JpegError("not baseline")
        elif marker == 0xC4:
            i = 0
            while i < len(body):
                size = 17 + sum(body[i + 1 : i + 17])
                if len(body) < i + size:
                    raise JpegError("broken Huffman table")
                frame.tables[body[i]] = bytes(body[i + 1 : i + size])
                i += size
        elif marker == 0xDB:
            i = 0
            while i < len(body):
                wide = body[i] >> 4
                if len(body) < i + 1 + 64 * (1 + wide):
                    raise JpegError("broken quantiser")
                frame.quantisers[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                i += 1 + 64 * (1 + wide)
        elif marker == 0xDD:
            frame.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            names = {c[0]: k for k, c in enumerate(frame.components)}
            n_scan = body[0] if body else 0
            if not names or len(body) < 1 + 2 * n_scan or any(body[1 + 2 * i] not in names for i in range(n_scan)) or not n_scan:
                raise JpegError("bad scan")
            frame.order = [(names[body[1 + 2 * i]], body[2 + 2 * i] >> 4, 16 | (body[2 + 2 * i] & 15)) for i in range(n_scan)]
            break
    end = at
    while True:
        end = data.find(b"\xff", end)
        if end < 0 or end + 1 >= len(data):
            raise JpegError("no end of scan")
        if data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7:
            break
        end += 2
    frame.scan = (at, end)
    tail = data.find(b"\xff\xd9", end)
    return frame, (tail + 2 if tail >= 0 else len(data))


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For the next 16 bits: symbol * 32 + code length; length 0 where there is no code."""
    if (got := _lookups.get(table)) is None:
        got = np.zeros(1 << 16, np.int32)
        lengths = [n + 1 for n, times in enumerate(table[:16]) for _ in range(times)]
        for symbol, n, code in zip(table[16:], lengths, canonical_codes(lengths), strict=True):
            if code >> n:
                raise JpegError("too many codes")
            got[code << (16 - n) : (code + 1) << (16 - n)] = symbol * 32 + n
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[table] = got
    return got


def decode_dc(images: list[bytes]) -> list[list[tuple[Frame, np.ndarray]] | None]:
    """For each stream, its frames with the first component's DC levels as samples (rows by columns, 0..255).

    Only frames whose first component is in the scan are decoded; None marks a stream that can't be.
    """
    jobs: list[tuple[int, Frame, bytes]] = []
    out: list[list[tuple[Frame, np.ndarray]] | None] = []
    for k, data in enumerate(images):
        at, frames = 0, []
        try:
            while at < len(data):
                frame, at = parse(data, at)
                for _, dc, ac in frame.order:
                    _lookup(frame.tables[dc]), _lookup(frame.tables[ac])
                frames.append(frame)
            if not frames:
                raise JpegError("empty")
            jobs += [(k, f, data) for f in frames]
            out.append([])
        except (JpegError, KeyError, IndexError, ValueError):
            out.append(None)
    for signature in dict.fromkeys(_signature(f) for _, f, _ in jobs):
        group = [j for j in jobs if _signature(j[1]) == signature]
        for (k, frame, _), samples in zip(group, _decode_group(group), strict=True):
            if out[k] is not None:
                out[k] = None if samples is None else [*out[k], (frame, samples)]
    return out


def _signature(frame: Frame) -> tuple:
    """Frames with equal tables and units can be decoded side by side."""
    return (tuple(frame.units()), tuple((c, frame.tables[dc], frame.tables[ac]) for c, dc, ac in frame.order))


#: Up to so many lanes (an image without restart intervals is one) are walked one by one, symbol by symbol; more go side by side.
FEW_LANES = 16


def _finish_lane(data: bytes, limit: int, bit: int, done: int, place: int, last: list[int], units: list[int], dc_tables: np.ndarray, ac_tables: np.ndarray, levels: np.ndarray) -> bool:
    """Walk a lane from ``bit`` to its end, filling ``levels`` (one a block); False if its codes run wrong."""
    dc, ac = [memoryview(t) for t in dc_tables], [memoryview(t) for t in ac_tables]
    n_units, total, found = len(units), len(levels), levels.tolist()
    while done < total:
        unit, at, shift = units[done % n_units], bit >> 3, bit & 7
        window = int.from_bytes(data[at : at + 5], "big")
        code = (ac if place else dc)[unit][window >> (24 - shift) & 0xFFFF]
        length, symbol = code & 31, code >> 5
        extra = symbol & 15
        bit += length + extra
        if not length or bit > limit:
            return False
        if place == 0:
            if extra:
                value = window >> (40 - shift - length - extra) & ((1 << extra) - 1)
                last[unit] += value if value >> (extra - 1) else value - (1 << extra) + 1
            found[done] = last[unit]
            place = 1
        else:
            place = 64 if symbol == 0 else place + (symbol >> 4) + 1
        if place >= 64:
            done, place = done + 1, 0
    levels[:] = found
    return True


def _decode_group(group: list[tuple[int, Frame, bytes]]) -> list[np.ndarray | None]:
    frame = group[0][1]
    units = np.array(frame.units())
    dc_tables = np.zeros((max(units) + 1, 1 << 16), np.int32)
    ac_tables = np.zeros_like(dc_tables)
    for c, dc, ac in frame.order:
        dc_tables[c], ac_tables[c] = _lookup(frame.tables[dc]), _lookup(frame.tables[ac])

    parts, lane_first, lane_mcus, owners, base = [], [], [], [], 0
    for n, (_, f, data) in enumerate(group):
        raw = np.frombuffer(data, np.uint8, f.scan[1] - f.scan[0], f.scan[0])
        marks = np.flatnonzero(raw[:-1] == 0xFF) if len(raw) else np.zeros(0, np.int64)
        stuffed = marks[raw[marks + 1] == 0]
        restarts = marks[raw[marks + 1] != 0]
        drop = np.zeros(len(raw), bool)
        drop[stuffed + 1] = drop[restarts] = drop[restarts + 1] = True
        starts = np.concatenate(([0], restarts + 2))
        starts = starts - np.concatenate(([0], np.cumsum(drop)))[starts]
        clean = raw[~drop]
        across, down = f.mcus()
        total, step = across * down, f.interval or across * down
        lanes = -(-total // step)
        first = np.full(lanes, len(clean))
        first[: min(lanes, len(starts))] = starts[:lanes]
        lane_first.append(base + first)
        lane_mcus.append(np.minimum(step, total - step * np.arange(lanes)))
        owners.append(np.full(lanes, n))
        parts.append(clean)
        base += len(clean)
    flat = np.concatenate([*parts, np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    window = np.zeros(len(flat) - 4, np.uint64)  # 40 bits from each byte on
    for k in range(5):
        window = window << np.uint64(8) | flat[k : len(flat) - 4 + k]
    bit = np.concatenate(lane_first) * 8
    left = np.concatenate(lane_mcus) * len(units)
    owner = np.concatenate(owners)
    lane0 = np.concatenate(([0], np.cumsum(left)))
    levels = np.zeros(int(lane0[-1]), np.int32)
    bad = np.zeros(len(group), bool)
    limit = (len(flat) - 8) * 8 + 24

    done = np.zeros(len(bit), np.int64)  # blocks of each lane
    place = np.zeros(len(bit), np.int64)  # coefficient within the block
    last = np.zeros((len(bit), len(dc_tables)), np.int32)
    live = np.flatnonzero(left > 0)
    while len(live) > FEW_LANES:
        at = bit[live]
        bits = (window[at >> 3] >> (np.uint64(8) - (at & 7).astype(np.uint64))) & np.uint64(0xFFFFFFFF)  # the next 32
        unit = units[done[live] % len(units)] if len(units) > 1 else np.full(len(live), units[0])
        is_dc = place[live] == 0
        top = (bits >> np.uint64(16)).astype(np.int64)
        code = np.where(is_dc, dc_tables[unit, top], ac_tables[unit, top])
        length, symbol = code & 31, code >> 5
        extra = symbol & 15
        value = ((bits << length.astype(np.uint64)) & np.uint64(0xFFFFFFFF)) >> (np.uint64(32) - extra.astype(np.uint64))
        bit[live] = at + length + extra
        dc = np.flatnonzero(is_dc)
        if len(dc):
            size = extra[dc]
            v = value[dc].astype(np.int32)
            v = np.where((size > 0) & (v < (1 << np.maximum(size - 1, 0))), v - (1 << size) + 1, v)
            v = np.where(size == 0, 0, v)
            rows = live[dc]
            last[rows, unit[dc]] += v
            levels[lane0[rows] + done[rows]] = last[rows, unit[dc]]
        run = symbol >> 4
        skip = np.where(is_dc, 1, np.where(symbol == 0, 64, run + 1))
        place[live] += skip
        over = place[live] >= 64
        ended = live[over]
        done[ended] += 1
        place[ended] = 0
        wrong = (length == 0) | (bit[live] > limit)
        if wrong.any():
            bad[owner[live[wrong]]] = True
            left[live[wrong]] = 0
        live = live[done[live] < left[live]]
    plain = flat.astype(np.uint8).tobytes()
    for k in live.tolist():
        lane = levels[lane0[k] : lane0[k + 1]]
        if not _finish_lane(plain, limit, int(bit[k]), int(done[k]), int(place[k]), last[k].tolist(), units.tolist(), dc_tables, ac_tables, lane):
            bad[owner[k]] = True

    results: list[np.ndarray | None] = []
    at = 0
    for n, (_, f, _) in enumerate(group):
        across, down = f.mcus()
        count = across * down * len(units)
        block, at = levels[at : at + count], at + count
        if bad[n] or 0 not in [c for c, _, _ in f.order]:
            results.append(None)
            continue
        first = np.flatnonzero(units == 0)
        _, h, v, quantiser = f.components[0]
        grid = block.reshape(down, across, len(units))[:, :, first]
        if len(f.order) > 1:
            grid = grid.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        else:
            grid = grid[:, :, 0]
        wide, tall = -(-f.width * h // max(c[1] for c in f.components)), -(-f.height * v // max(c[2] for c in f.components))
        grid = grid[: -(-tall // 8), : -(-wide // 8)]
        scale = f.quantisers.get(quantiser, 1)
        results.append(np.clip((grid * scale + 4) // 8 + 128, 0, 255).astype(np.uint8))
    return results


def thumbnail_hash(image: np.ndarray) -> str:
    """64-bit difference hash: means of a 8 x 9 grid, each compared with its right neighbour."""
    rows = np.linspace(0, image.shape[0], 9).astype(int)
    columns = np.linspace(0, image.shape[1], 10).astype(int)
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1), np.int64)
    sums[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    low_r, high_r = rows[:-1], np.maximum(rows[1:], rows[:-1] + 1).clip(max=image.shape[0])
    low_c, high_c = columns[:-1], np.maximum(columns[1:], columns[:-1] + 1).clip(max=image.shape[1])
    low_r, low_c = np.minimum(low_r, high_r - 1), np.minimum(low_c, high_c - 1)
    area = (high_r - low_r)[:, None] * (high_c - low_c)[None]
    total = sums[high_r][:, high_c] - sums[low_r][:, high_c] - sums[high_r][:, low_c] + sums[low_r][:, low_c]
    means = total / area
    return np.packbits(means[:, 1:] > means[:, :-1]).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        view, offsets = utf8_column(batch["text"])
        kept = [c for c in batch.schema.names if c not in ("text", "n_bytes", "media")]
        for a, b in pieces(offsets, PIECE_BYTES):
            sizes = np.diff(offsets[a : b + 1])
            padded = np.maximum(64, -(-sizes // 64) * 64)
            ends = np.concatenate(([0], np.cumsum(padded)))
            data = np.zeros(int(ends[-1]), np.uint8)
            raw = np.frombuffer(view[offsets[a] : offsets[b]], np.uint8)
            data[np.arange(len(raw)) + np.repeat(ends[:-1] - (offsets[a:b] - offsets[a]), sizes)] = raw
            columns = {c: batch[c].slice(a, b - a) for c in kept}
            columns |= {"n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(encode_payloads(data, ends), pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)


def store_as_media(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by its UTF-8 ``n_bytes`` and ``media``, JPEGs that hold its bytes padded to 64."""
    kept = docs.select(*(c for c in docs.columns if c not in ("text", "n_bytes", "media")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["n_bytes bigint", "media binary"])
    return bound_batches(docs).select(*kept.columns, "text").mapInArrow(_store, schema)


MEDIA = ("width", "height", "thumbnail_hash", "payload", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "payload_bytes")


def _describe(with_payload: bool):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = [x or b"" for x in batch["media"].to_pylist()]
            kept = [c for c in batch.schema.names if c not in ("media", *MEDIA)]
            edges = np.concatenate(([0], np.cumsum([len(x) for x in blobs])))
            for a, b in pieces(edges, PIECE_BYTES):
                rows = []
                for blob, frames in zip(blobs[a:b], decode_dc(blobs[a:b]), strict=True):
                    stored = {"media_bytes": len(blob), "media_sha256": hashlib.sha256(blob).hexdigest()}
                    if frames:
                        payload = b"".join(x.tobytes() for _, x in frames)
                        tall = frames[0][1] if len(frames) == 1 else np.concatenate([x for _, x in frames if x.shape[1] == frames[0][1].shape[1]])
                        stored |= {
                            "width": frames[0][0].width, "height": sum(f.height for f, _ in frames), "thumbnail_hash": thumbnail_hash(tall),
                            "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "payload_bytes": len(payload),
                        }
                        if with_payload:
                            stored["payload"] = payload
                    rows.append(stored)
                types = {"width": pa.int64(), "height": pa.int64(), "thumbnail_hash": pa.string(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "payload_bytes": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
                if with_payload:
                    types["payload"] = pa.binary()
                columns = {c: batch[c].slice(a, b - a) for c in kept}
                columns |= {c: pa.array([r.get(c) for r in rows], t) for c, t in types.items()}
                yield pa.RecordBatch.from_pydict(columns)

    return describe


def describe_media(stored: DataFrame, with_payload: bool = False) -> DataFrame:
    """Read ``media`` back: dimensions, thumbnail hash and digests of the DC thumbnail's samples (and the samples)."""
    kept = [f for f in stored.schema if f.name not in ("media", *MEDIA)]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    fields += ["width bigint", "height bigint", "thumbnail_hash string", "payload_sha256 string", "tail_crc32 bigint", "payload_bytes bigint", "media_bytes bigint", "media_sha256 string"]
    fields += ["payload binary"] * with_payload
    return stored.select(*(f.name for f in kept), "media").mapInArrow(_describe(with_payload), ", ".join(fields))


def op8_jpeg(docs: DataFrame) -> DataFrame:
    media = describe_media(store_as_media(docs.select("doc_id", "text")))
    return media.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.format_string("%dx%d:%s", "width", "height", "thumbnail_hash").alias("feature"), "width", "height", "thumbnail_hash",
    )
