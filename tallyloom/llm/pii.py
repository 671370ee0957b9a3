"""Personal data: high-recall candidates scored by gradient boosted trees.

Strict patterns (email, ip, card, phone) give the base spans, which always stay. Loose generators propose further,
overlapping spans: obfuscated emails, digit groups that look like phone, card or account numbers, colon-separated
addresses. Boosted regression trees score every candidate from its format and context; the probability is calibrated on
candidates held out from the trees, and a threshold per kind, chosen for precision on the same held-out set, selects what
is added. The features leave out what makes a strict pattern strict (the plus sign, the checksum), so a candidate that
looks and stands like personal data is found though it fails the strict rule.

The labels do not come from the strict patterns alone. EXAMPLES personal data of each loose kind, and as many look-alikes
(dates, versions, prices, order and book numbers, times, ratios, other hex groups, words around an "at"), are planted
between words of a sample of documents (parameter ``fit_rows``), so what they are is known. The candidates that the sample
itself holds join them: those that a strict pattern confirms are positive, other numbers negative (of other emails and
addresses it is not known what they are, so they are left out). Three fifths train, one
fifth calibrates, and ``quality`` tells precision and recall of each kind on the planted candidates of the last fifth.
All documents are scored.

Edge cases: null and empty texts have no spans; without documents nothing is added; texts
of any length are scanned whole, in time linear in their length; numbers with any count of leading zeros are read; repeated
rows are scanned one by one; other columns pass through ``find_pii`` and clashing names are replaced.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import bound_batches
from tallyloom.llm.secrets import in_code_points
from tallyloom.llm.textbatch import utf8_rows

#: The first four are the base.
KINDS = ("email", "ip", "card", "phone", "email_like", "number_like", "ip_like")
_EMAIL_TAIL = re.compile(rb"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_HEAD_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts where its run of digits does, and no digits are given back: each run is read a bounded number of times.
_IP = re.compile(rb"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER_LIKE = re.compile(rb"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}")
_IP_LIKE = re.compile(rb"(?:[0-9A-Fa-f]{1,4}|:(?=:))(?::[0-9A-Fa-f]{0,4}){1,6}(?::[0-9A-Fa-f]{1,4}|:(?<=::))")
_MAC = re.compile(rb"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}")
_EMAIL_LIKE = re.compile(rb"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\}|@)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\[dot\]|\(dot\)|\.)\s?[A-Za-z0-9-]{2,24})+", re.I)
#: Up to a dot and space that may end the sentence.
_EMAIL_TIGHT = re.compile(rb"[A-Za-z0-9._%+-]{1,64}\s?(?:\[at\]|\(at\)|\{at\}|@)\s?[A-Za-z0-9-]{1,63}(?:(?:\s?(?:\[dot\]|\(dot\))\s?|\.|\s\.\s?)[A-Za-z0-9-]{2,24})+", re.I)
_AT = re.compile(rb"[\[({]at[\])}]", re.I)
_DIGIT = re.compile(rb"[0-9]")
#: Planted examples of each loose kind and label.
EXAMPLES = 400
Span = tuple[int, int, int]


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(part: bytes) -> bytes:
    return bytes(c for c in part if 48 <= c <= 57)


def _at_most_255(digits: bytes) -> bool:
    part = digits.lstrip(b"0")
    return len(part) < 3 or len(part) == 3 and part <= b"255"


def emails(text: bytes) -> list[Span]:
    """A match is found from its @; it starts where the run of local-part characters before it does."""
    found, floor = [], 0
    for m in _EMAIL_TAIL.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _HEAD_BYTES:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            floor = m.end()
    return found


def base_spans(text: bytes) -> list[Span]:
    """(start, kind, end) by kind and start."""
    found = emails(text) if b"@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_at_most_255(p) for p in m[0].split(b"."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if b"+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def candidates(text: bytes) -> list[Span]:
    """Spans of the loose generators; they may overlap each other and the base."""
    found = []
    if _DIGIT.search(text):
        found += [(m.start(), 5, m.end()) for m in _NUMBER_LIKE.finditer(text)]
    if b":" in text:
        found += [(m.start(), 6, m.end()) for m in _IP_LIKE.finditer(text)]
    if b"@" in text or _AT.search(text):
        for m in _EMAIL_LIKE.finditer(text):
            found.append((m.start(), 4, (_EMAIL_TIGHT.match(text, m.start(), m.end()) or m).end()))
    return found


def made_examples(seed: int = 10, words: list[bytes] | None = None) -> list[tuple[bytes, int, int, int, bool]]:
    """(text, kind, start, end, whether it is personal data): what is planted lies from start to end, between ``words``."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(2, 9)))
    hexes = lambda n, low, high: [f"{rng.randrange(16 ** rng.randint(low, high)):0{low}x}" for _ in range(n)]
    letters = lambda n: ["".join(rng.choices("abcdef", k=2)) for _ in range(n)]
    digits = lambda n: str(rng.randint(1, 9)) + "".join(rng.choices("0123456789", k=n - 1))

    def address() -> str:
        form = rng.randrange(3)
        if form == 0:
            mac = ":".join(hexes(6, 2, 2) if rng.random() < 0.8 else letters(6))
            return mac if rng.random() < 0.7 else mac.upper()
        groups = hexes(8, 1, 4) if form == 1 else hexes(rng.randint(2, 6), 1, 4)
        cut = rng.randint(0, len(groups))
        groups[0] = rng.choice(("2001", "2a02", "fe80", "fd12", groups[0]))
        return ":".join(groups) if form == 1 else ":".join(groups[:cut]) + "::" + ":".join(groups[cut:])

    def no_address() -> str:
        two = lambda n: ":".join(f"{rng.randrange(60):02d}" for _ in range(n))
        return rng.choice((
            two(3), two(3), two(4), two(5), f"{rng.randint(1, 20)}:{rng.randint(1, 20)}:{rng.randint(1, 20)}", ":".join(hexes(rng.choice((16, 20, 32)), 2, 2)),
            ":".join(hexes(rng.choice((3, 4, 5, 7)), 2, 2)), ":".join(letters(rng.choice((4, 5, 7, 16, 20)))), f"{name()}d::{rng.choice('abcdef')}{name()}", f"{name()}::{name()}e::add", ":".join(hexes(5, 3, 4)),
        ))

    def email() -> str:
        at, dot = rng.choice((("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "."), ("[at]", "."), ("(at)", ".")))
        gap = rng.choice(("", " "))
        local = name() + rng.choice(("", ".", "_")) + rng.choice((name(), str(rng.randrange(99))))
        last = rng.choice(("com", "org", "de", "fr", "info", "net"))
        return f"{local}{gap}{at}{gap}{name()}{(gap if dot != '.' else '') + dot + (gap if dot != '.' else '')}{last}"

    def no_email() -> str:
        at = rng.choice(("@", "(at)", "[at]"))
        return f"{rng.randrange(100)} {at} {rng.randrange(50)}.{rng.randrange(10, 99)}"

    def number() -> str:
        land, area, line = rng.choice(("1", "33", "34", "41", "44", "49")), digits(rng.randint(2, 3)), digits(rng.randint(6, 7))
        return rng.choice((
            f"{land} {area} {line}", f"{land} {area} {line}", f"(0{area}) {line}", f"0{area}-{line}", f"0{area} {line[:3]} {line[3:5]} {line[5:]}", f"00{land} {area} {line}",
            f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)}-{digits(2)}-{digits(4)}", ".".join(digits(4) for _ in range(4)),
        ))

    def no_number() -> str:
        day, month, year = rng.randint(10, 28), rng.randint(10, 12), rng.randint(1900, 2030)
        return rng.choice((
            f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{year}{month}{day}", f"{year}-{month}-{day} {rng.randint(10, 23)}", f"{digits(1)}.{digits(3)}.{digits(3)}",
            digits(rng.randint(7, 15)), digits(rng.randint(7, 15)), f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", ".".join(digits(rng.randint(1, 2)) for _ in range(7)),
            f"{digits(2)}.{digits(6)}", f"{digits(3)}-{digits(3)} {digits(3)}",
        ))

    kinds = (
        (4, email, no_email, ("mail", "contact", "write to", "reach me at"), ("costs", "each", "lot of", "about")),
        (5, number, no_number, ("call", "tel", "phone:", "mobile", "contact", "fax", "card", "account", "ssn"), ("order", "item", "on", "isbn", "version", "page", "total", "build", "from", "no")),
        (6, address, no_address, ("ip", "address", "host", "from"), ("at", "ratio", "time", "in", "key")),
    )
    out = []
    for kind, yes, no, cues, others in kinds:
        for make, label, leads in ((yes, True, cues), (no, False, others)):
            for _ in range(EXAMPLES):
                some = lambda n: [rng.choice(words).decode("utf-8", "replace") for _ in range(n)] if words else [name() for _ in range(n)]
                lead = some(rng.randint(0, 4)) + ([rng.choice(leads)] if rng.random() < 0.75 else [])
                before = (" ".join(lead) + rng.choice((" ", " ", ": ", ", ", "\n", " (", "="))) if lead and rng.random() < 0.95 else ""
                after = rng.choice(("", "", ".", ",", ")", "\n", ":", ";", "?")) + (" " + " ".join(some(rng.randint(1, 3))) if rng.random() < 0.8 else "")
                what = make().encode()
                out.append((before.encode() + what + after.encode(), kind, len(before.encode()), len(before.encode()) + len(what), label))
    rng.shuffle(out)
    return out


_CUES = (b"call", b"tel", b"phone", b"mobile", b"contact", b"fax", b"mail", b"card", b"account", b"iban", b"ssn", b"ip", b"addr")


def _colon_groups(part: bytes) -> tuple[int, int, int]:
    sizes = [len(g) for g in part.split(b":") if g]
    return len(sizes), min(sizes, default=0), max(sizes, default=0)


def _is_address(part: bytes) -> bool:
    if _MAC.fullmatch(part):
        return True
    try:
        return ipaddress.IPv6Address(part.decode()).packed != bytes(16)
    except ValueError:
        return False


def features(text: bytes, span: Span) -> list[float]:
    start, kind, end = span
    part, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 12].lower()
    digits = _digits(part)
    groups = re.findall(rb"[0-9]+", part)
    sizes = [len(g) for g in groups] or [0]
    glued = before[-1:].isalnum() or before[-1:] == b":", after[:1].isalnum() or (after[:1] == b":" and after[1:2].isalnum())
    return [
        float(kind), len(part), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1],
        part.count(b"-"), part.count(b" "), part.count(b"."), part.count(b"("), part.count(b":"),
        sum(65 <= c <= 90 or 97 <= c <= 122 for c in part), len(set(digits)),
        float(any(cue in before for cue in _CUES)), float(before[-1:] in (b" ", b"", b"\n", b"(", b"+")),
        float(before.rstrip(b"+ (")[-1:] in (b":", b",", b".", b"=")), float(after[:1] in (b" ", b"", b".", b",", b"\n", b")")),
        sum(48 <= c <= 57 for c in before + after),
        part.count(b"::"), *_colon_groups(part), float(glued[0]), float(glued[1]), part.count(b"[") + part.count(b"{"),
        sum(65 <= c <= 90 or 97 <= c <= 122 for c in part[-2:]), float(kind == 6 and not any(glued) and _is_address(part)),
    ]


@dataclass
class BoostedTrees:
    """Logistic gradient boosting with trees of fixed depth over quantile bins, then a sigmoid fitted on held-out rows."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    bins: int = 32
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[int, float] = field(default_factory=dict)
    #: Precision and recall of each kind on planted candidates that neither trained nor calibrated.
    quality: dict[str, tuple[float, float]] = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            feature, cut, leaf = self._tree(binned, edges, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append((feature, cut, leaf))
            score += leaf[self._leaf(x, feature, cut)]

    def _tree(self, binned, edges, gradient, hessian):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(binned), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best, pick = 1e-9, None
            if len(rows):
                total_g, total_h = gradient[rows].sum(), hessian[rows].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    g = np.bincount(binned[rows, j], gradient[rows], len(e) + 1).cumsum()[:-1]
                    h = np.bincount(binned[rows, j], hessian[rows], len(e) + 1).cumsum()[:-1]
                    gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, pick = float(gain[k]), (j, k)
            if pick is not None:
                feature[at], cut[at] = pick[0], edges[pick[0]][pick[1]]
                right = binned[rows, pick[0]] > pick[1]
                node[rows] = 2 * at + 1 + right
            else:
                node[rows] = 2 * at + 1
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, hessian, inner + 1)
        return feature, cut, self.rate * g / (h + 1)

    def _leaf(self, x: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        return node - len(feature)

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            score += leaf[self._leaf(x, feature, cut)]
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float) -> None:
        """Fit the sigmoid by Newton steps; per kind take the least probability from which on precision is met."""
        z = self.raw(x)
        w = np.array([1.0, 0.0])
        design = np.stack([z, np.ones(len(z))], axis=1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-design @ w))
            hessian = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.eye(2)
            w = w + np.linalg.solve(hessian, design.T @ (y - p) - (w - [1.0, 0.0]))
        self.slope, self.shift = float(w[0]), float(w[1])
        p = self.probability(x)
        for kind in np.unique(x[:, 0]).astype(int).tolist():
            mine = np.flatnonzero(x[:, 0] == kind)
            order = mine[np.argsort(-p[mine], kind="stable")]
            exact = np.cumsum(y[order]) / np.arange(1, len(order) + 1)
            last_of_tie = np.append(p[order][1:] < p[order][:-1], True)
            good = np.flatnonzero((exact >= precision) & last_of_tie)
            if len(good):
                last = good[-1]
                below = p[order][last + 1] if last + 1 < len(order) else 0.0
                self.thresholds[kind] = max(0.5, float(p[order][last] + below) / 2)  # between what counts and what does not

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))

    def select(self, x: np.ndarray) -> np.ndarray:
        p = self.probability(x)
        return np.array([q >= self.thresholds.get(int(k), 2.0) for q, k in zip(p, x[:, 0], strict=True)], bool)


class Taken:
    """Spans that are taken; asking for an overlap or adding one takes logarithmic time (and a move of the list)."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):  # overlapping spans become one
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, span: Span) -> bool:
        k = bisect_left(self.starts, span[2])
        return k > 0 and self.ends[k - 1] > span[0]

    def add(self, span: Span) -> None:
        """``span`` overlaps nothing."""
        insort(self.starts, span[0])
        insort(self.ends, span[2])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and labels of the candidates of a sample, and some of its words (rows without features)."""
    for batch in batches:
        rows, labels, words = [], [], []
        for text in utf8_rows(batch["text"]):
            taken = Taken(base_spans(text))
            for c in candidates(text):
                confirmed = taken.overlaps(c)
                if confirmed or c[1] == 5:
                    rows.append(features(text, c))
                    labels.append(confirmed)
                    words.append(None)
            for w in text[:WORDS_FROM].split()[1:4]:
                rows.append(None)
                labels.append(None)
                words.append(w.decode("utf-8", "replace"))
        columns = {"x": pa.array(rows, pa.list_(pa.float64())), "y": pa.array(labels, pa.bool_()), "word": pa.array(words, pa.string())}
        yield pa.RecordBatch.from_pydict(columns)


#: Words to plant between are taken from the beginning of sampled texts.
WORDS_FROM = 200


def planted(words: list[bytes], seed: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the candidates that lie where something was planted."""
    rows, labels = [], []
    for text, kind, start, end, label in made_examples(seed, words):
        for c in candidates(text):
            if c[1] == kind and c[0] < end and start < c[2]:
                rows.append(features(text, c))
                # a candidate that holds a part only, or much else, is none
                labels.append(label and abs(c[0] - start) + abs(c[2] - end) <= 2)
    return np.array(rows, float), np.array(labels, float)


def fit_model(docs: DataFrame, fit_rows: int = 4000, fit_candidates: int = 20_000, precision: float = 0.95) -> BoostedTrees | None:
    """Fit on planted examples and on the candidates (at most ``fit_candidates``) of about ``fit_rows`` documents, picked by a hash of id and text.

    None without documents.
    """
    n = docs.count()
    if not n:
        return None
    share = min(1.0, fit_rows / max(n, 1))
    picked = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    found = bound_batches(picked).select("text").mapInArrow(_sample, "x array<double>, y boolean, word string")
    found = found.orderBy(F.xxhash64("x", "word"), "y").limit(fit_candidates).toArrow()
    words = [w.encode() for w in found["word"].to_pylist() if w and not _DIGIT.search(w.encode())]
    own = [(x, y) for x, y in zip(found["x"].to_pylist(), found["y"].to_pylist(), strict=True) if x is not None]
    made_x, made_y = planted(sorted(words))
    x = np.concatenate([made_x, np.array([r for r, _ in own], float).reshape(-1, made_x.shape[1])])
    y = np.concatenate([made_y, np.array([label for _, label in own], float)])
    part = np.arange(len(y)) % 5
    model = BoostedTrees()
    model.fit(x[part < 3], y[part < 3])
    model.calibrate(x[part == 3], y[part == 3], precision)
    last = np.flatnonzero(part[: len(made_y)] == 4)
    chosen, right = model.select(made_x[last]), made_y[last] > 0
    for kind in (4, 5, 6):
        mine = made_x[last, 0] == kind
        hits = float((chosen & right & mine).sum())
        model.quality[KINDS[kind]] = (hits / max(1.0, float((chosen & mine).sum())), hits / max(1.0, float((right & mine).sum())))
    return model


#: Candidates that are scored together.
AT_ONCE = 10_000
OUT = ("n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans")


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _at_once(rows: Iterator[tuple[int, Span]]) -> Iterator[list[tuple[int, Span]]]:
    while some := list(islice(rows, AT_ONCE)):
        yield some


def _scanner(model: BoostedTrees | None):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(utf8_rows(batch["text"]))
            bases = [base_spans(t) for t in texts]
            added: list[list[Span]] = [[] for _ in texts]
            taken = [Taken(base) for base in bases]
            likely: list[tuple[int, float, Span]] = []
            for some in _at_once((i, c) for i, t in enumerate(texts if model else ()) for c in candidates(t) if not taken[i].overlaps(c)):
                x = np.array([features(texts[i], c) for i, c in some])
                chance = model.probability(x)
                likely += [(i, -p, c) for (i, c), p, yes in zip(some, chance.tolist(), model.select(x), strict=True) if yes]
            for i, _, c in sorted(likely):  # of overlapping spans the likeliest is kept; of equal ones the first
                if not taken[i].overlaps(c):
                    added[i].append(c)
                    taken[i].add(c)
            counts = [[sum(x[1] == k for x in b) for b in bases] for k in range(4)]
            digests, spans = [], []
            for text, base, more in zip(texts, bases, added, strict=True):
                moved = in_code_points(text, [*base, *more])
                key = lambda s: (s[1], s[0])
                digests.append(hashlib.sha256(_joined(sorted(moved[: len(base)], key=key)).encode()).hexdigest())
                spans.append(_joined(sorted(moved, key=key)))
            columns = {c: batch[c] for c in batch.schema.names if c not in ("text", *OUT)}
            columns |= {c: pa.array(v, pa.int64()) for c, v in zip(OUT[:5], [*counts, [len(a) for a in added]], strict=True)}
            columns |= {OUT[5]: pa.array(digests, pa.string()), OUT[6]: pa.array(spans, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def find_pii(docs: DataFrame, **fit) -> DataFrame:
    """The columns of ``docs`` but ``text``, with base counts, the digest of the base spans and all spans."""
    kept = [c for c in docs.columns if c not in OUT]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*(c for c in kept if c != "text")).schema]
        + [f"{c} bigint" for c in OUT[:5]] + [f"{c} string" for c in OUT[5:]]
    )
    return bound_batches(docs).select(*kept).mapInArrow(_scanner(fit_model(docs, **fit)), schema)


def op10_pii(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")
