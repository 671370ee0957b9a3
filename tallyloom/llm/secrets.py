"""Secret scanning with structural confirmation.

Simple patterns find assignments, access keys and hex runs. Beyond them, base64 and hex candidates are decoded and
reported only if the bytes have the structure of a key: nested DER lengths that add up, the length-prefixed fields of
an OpenSSH private key, a PEM frame around such bytes, or a signed token whose header is a JSON object with an ``alg``.
What everyone may see is no secret: public keys (DER, PEM or SSH) and certificates are parsed and left out.

A candidate is a run of base64 or hex characters. Runs that line breaks cut (written as such or as backslash-n, as in JSON)
into lines of one length and a shorter last one are one candidate, too; hex may follow ``0x``.

Everything works on UTF-8 bytes (all patterns are ASCII) and is converted to code points at the end.

Edge cases: null and empty texts have no spans; very long texts are scanned whole, in time linear in their length (each run
is read and decoded a bounded number of times); repeated rows are
scanned one by one; other columns pass through ``find_secrets`` and clashing names are replaced.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.columns import bound_batches
from tallyloom.llm.textbatch import utf8_rows

#: Kinds in the order in which they are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "der", "pem", "ssh", "token")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ASSIGN_MARKS = (b"passw", b"secret", b"token", b"api")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX_ONLY = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_BASE64_ONLY = bytes(120 if chr(c).isalnum() and c < 128 or c in b"+/_-=" else 32 for c in range(256))
#: A frame, header lines such as those of an encrypted key, and base64; line breaks may be written as backslash-n.
PEM = re.compile(
    rb"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----(?:\s|\\[nrt])*+"
    rb"((?:[A-Za-z-]{1,40}: (?:[^\n\\]|\\(?!n)){0,100}+(?:\s|\\[nrt])++){0,9}+)((?:[A-Za-z0-9+/=\s]|\\[nrt])++)-----END \1-----"
)
_BREAK = re.compile(rb"(?:\\r)?\\n|\r?\n")
#: Looked for at the start of each run; whatever follows is read once as header, payload and signature.
TOKEN = re.compile(rb"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+))")
#: A brace and what may follow it, in base64.
_TOKEN_MARK = re.compile(rb"ey[A-DI-L]")
LEAST_HEX, LEAST_CODED, LEAST_HEADER = 24, 40, 10
SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_SSH_MAGIC = b"openssh-key-v1\0"


def runs(mask: bytes, least: int) -> Iterator[tuple[int, int]]:
    """Maximal runs of ``x`` of at least ``least`` bytes."""
    needle, at = b"x" * least, 0
    while (at := mask.find(needle, at)) >= 0:
        start = mask.rfind(b" ", 0, at) + 1
        end = mask.find(b" ", at)
        end = len(mask) if end < 0 else end
        yield start, end
        at = end


def is_der(data: bytes) -> bool:
    """Whether ``data`` is exactly one DER SEQUENCE whose nested lengths add up and which holds an INTEGER or OID, and not a public one."""
    parsed = _der_items(data, 0, len(data), 0)
    if parsed is None or len(parsed) != 1 or data[0] != 0x30 or len(data) < 24:
        return False
    return bool({2, 6} & _der_tags(data)) and not _is_public_der(data, parsed[0])


def _is_public_der(data: bytes, whole: tuple[int, int, int]) -> bool:
    """A public key with its algorithm, an RSA public key by itself, or a certificate (also a request for one)."""
    inside = _der_items(data, whole[1], whole[2], 1) or []
    tags = [t for t, _, _ in inside]
    if tags == [2, 2]:
        return True
    first = [t for t, _, _ in _der_items(data, inside[0][1], inside[0][2], 2) or []] if tags[:1] == [0x30] else []
    return tags == [0x30, 3] and first[:1] == [6] or tags == [0x30, 0x30, 3]


def _der_items(data: bytes, at: int, end: int, depth: int) -> list[tuple[int, int, int]] | None:
    if depth > 12:
        return None
    items = []
    while at < end:
        if end - at < 2:
            return None
        tag, n, body = data[at], data[at + 1], at + 2
        if n >= 0x80:
            more = n & 0x7F
            if not 1 <= more <= 4 or body + more > end:
                return None
            n, body = int.from_bytes(data[body : body + more], "big"), body + more
        if body + n > end or tag & 0x1F == 0x1F:
            return None
        if tag & 0x20 and _der_items(data, body, body + n, depth + 1) is None:
            return None
        items.append((tag, body, body + n))
        at = body + n
    return items


def _der_tags(data: bytes) -> set[int]:
    tags: set[int] = set()
    todo = [(0, len(data), 0)]
    while todo:
        start, end, depth = todo.pop()
        for tag, a, b in _der_items(data, start, end, depth) or ():
            tags.add(tag)
            if tag & 0x20:
                todo.append((a, b, depth + 1))
    return tags


def _fields(data: bytes, at: int, most: int) -> tuple[list[bytes], int] | None:
    """Up to ``most`` length-prefixed fields from ``at`` on, and where they end; None if a length does not fit."""
    found: list[bytes] = []
    while at < len(data) and len(found) < most:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if n > len(data) - at - 4:
            return None
        found.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return found, at


def is_ssh(data: bytes) -> bool:
    """An OpenSSH private key: cipher, derivation, its options, a count, so many public keys, and one private part fill it."""
    if not data.startswith(_SSH_MAGIC):
        return False
    head = _fields(data, len(_SSH_MAGIC), 3)
    if head is None or len(head[0]) < 3 or head[1] + 4 > len(data):
        return False
    (cipher, derivation, options), at = head
    count = int.from_bytes(data[at : at + 4], "big")
    if not re.fullmatch(rb"[a-z0-9@.-]{1,64}", cipher) or derivation not in (b"none", b"bcrypt") or not 1 <= count <= 16:
        return False
    rest = _fields(data, at + 4, count + 1)
    if rest is None or len(rest[0]) != count + 1 or rest[1] != len(data):
        return False
    *public, private = rest[0]
    for key in public:
        parts = _fields(key, 0, 8)
        if parts is None or len(parts[0]) < 2 or parts[0][0] not in SSH_NAMES or parts[1] != len(key):
            return False
    if not private or len(private) % 8:
        return False
    if cipher != b"none":
        return bool(options)
    named = _fields(private, 8, 1)
    return len(private) > 16 and private[:4] == private[4:8] and named is not None and named[0][0] in SSH_NAMES


def decode_base64(run: bytes) -> bytes | None:
    body = run.rstrip(b"=").replace(b"-", b"+").replace(b"_", b"/")
    if len(body) % 4 == 1 or b"=" in body:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: bytes, payload: bytes, signature: bytes) -> bool:
    """Header and payload are JSON objects; the header names an algorithm, and a signature follows unless it is none."""
    parts = []
    for part in (header, payload):
        try:
            value = json.loads(decode_base64(part) or b"")
        except (ValueError, UnicodeDecodeError, RecursionError):
            return False
        if not isinstance(value, dict):
            return False
        parts.append(value)
    algorithm = parts[0].get("alg")
    return isinstance(algorithm, str) and (bool(signature) or algorithm.lower() == "none")


def structure_of(data: bytes | None) -> str | None:
    return None if not data else "ssh" if is_ssh(data) else "der" if is_der(data) else None


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the simple patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(mark in low for mark in ASSIGN_MARKS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(a, 2, b) for a, b in runs(text.translate(_HEX_ONLY), LEAST_HEX)]
    return sorted(found)


def _structure_of_run(run: bytes) -> tuple[str | None, int]:
    """What a run of base64 or hex characters holds, and where in it that begins.

    It may follow a name and an equals sign; hex may also follow ``0x`` or the last slash of a path.
    """
    name = run.rstrip(b"=").rfind(b"=") + 1
    for start in sorted({0, name}):
        if kind := structure_of(decode_base64(run[start:])):
            return kind, start
    for start in sorted({0, name, run.rfind(b"/") + 1}):
        start += 2 * (run[start : start + 2] in (b"0x", b"0X"))
        if (len(run) - start) % 2 == 0 and _HEX.fullmatch(run, start) and (kind := structure_of(bytes.fromhex(run[start:].decode()))):
            return kind, start
    return None, 0


_HEX = re.compile(rb"[0-9A-Fa-f]+")


def _wrapped(text: bytes, found: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """Runs that only line breaks part, all of one length but the last, which may be shorter: start, end and the joined bytes."""
    k = 0
    while k < len(found):
        start, end = found[k]
        if not text[end - 1 : end] == b"=":  # name=value written without a space
            start = max(start, text.rfind(b"=", start, end) + 1)
        lines, n = [text[start:end]], k + 1
        while m := _BREAK.match(text, end):
            a = m.end()
            b = found[n][1] if n < len(found) and found[n][0] == a else a
            if b == a:  # a short last line is no run of its own
                while b < len(text) and b - a < len(lines[0]) and _BASE64_ONLY[text[b]] == 120:
                    b += 1
            if b == a or b - a > len(lines[0]):
                break
            lines.append(text[a:b])
            end, n = b, n + (n < len(found) and found[n][0] == a)
            if b - a < len(lines[0]):
                break
        if len(lines) > 1:
            yield start, end, b"".join(lines)
        k = max(n, k + 1)


def _escaped_starts(text: bytes, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs without the n or r of an escaped line break that they seem to begin with."""
    return [(a + 1 if a and text[a - 1 : a] == b"\\" and text[a] in b"nr" else a, b) for a, b in found]


def confirmed_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded bytes are confirmed."""
    found = []
    coded = _escaped_starts(text, list(runs(text.translate(_BASE64_ONLY), LEAST_CODED)))
    for start, end in coded:
        kind, skip = _structure_of_run(text[start:end])
        if kind:
            found.append((start + skip, KINDS.index(kind), end))
    alone = {start for start, _, _ in found}
    for start, end, joined_lines in _wrapped(text, coded):
        if start not in alone and (kind := structure_of(decode_base64(joined_lines))):
            found.append((start, KINDS.index(kind), end))
    if b"-----BEGIN " in text:
        for m in PEM.finditer(text):
            data = decode_base64(re.sub(rb"\s|\\[nrt]", b"", m[3]))
            # under an encrypting header the bytes have no structure, but must fill whole blocks
            sealed = b"ENCRYPTED" in m[2] and data and len(data) >= 64 and len(data) % 8 == 0
            if structure_of(data) or sealed:
                found.append((m.start(), KINDS.index("pem"), m.end()))
    if _TOKEN_MARK.search(text):
        taken = 0
        for m in TOKEN.finditer(text):
            at = m[1].find(b"ey")
            if at >= 0 and len(m[1]) - at >= LEAST_HEADER and m.start() + at >= taken and is_signed_token(m[1][at:], m[2], m[3]):
                found.append((m.start() + at, KINDS.index("token"), m.end(3)))
                taken = m.end(3)
    return found


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets of (start, kind, end) as code points: one pass over the text."""
    if not spans or text.isascii():
        return spans
    cuts = sorted({x for a, _, b in spans for x in (a, b)})
    at = points = 0
    where = {}
    for cut in cuts:
        points += len(text[at:cut].decode("utf-8", "surrogatepass"))
        where[cut] = points
        at = cut
    return [(where[a], k, where[b]) for a, k, b in spans]


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[list[int]] = [[], [], []]
        digests, spans, confirmed = [], [], []
        for text in utf8_rows(batch["text"]):
            base = in_code_points(text, base_spans(text))
            more = in_code_points(text, confirmed_spans(text))
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(sorted([*base, *more])))
            confirmed.append(len(more))
        columns = {c: batch[c] for c in batch.schema.names if c not in ("text", *OUT)}
        values = [*counts, confirmed]
        columns |= {c: pa.array(v, pa.int64()) for c, v in zip(OUT[:4], values, strict=True)}
        columns |= {OUT[4]: pa.array(digests, pa.string()), OUT[5]: pa.array(spans, pa.string())}
        yield pa.RecordBatch.from_pydict(columns)


OUT = ("n_assign", "n_access", "n_hex", "n_confirmed", "base_sha256", "spans")


def find_secrets(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but ``text``, with counts, the digest of the base spans and all spans."""
    kept = [c for c in docs.columns if c not in OUT]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(c for c in kept if c != "text")).schema]
        + [f"{c} bigint" for c in OUT[:4]] + [f"{c} string" for c in OUT[4:]]
    )
    return bound_batches(docs).select(*kept).mapInArrow(_scan, schema)


def op5_secrets(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")
