"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over hashed word one- and two-grams scores every line (in parts of at most MAX_WORDS
words) and every window of WINDOWS words of every paragraph. A paragraph is all lines up to a blank one (a line without
words), joined; windows of one length overlap by half, so each notice lies whole in a window at most about twice its
length or in its whole paragraph, wherever lines break. The classifier is trained on notices of each family with random
neighbours and gaps, and in windows of the same lengths, against paragraphs of a bounded sample of documents and windows
of them. ``unknown`` is a class of its own, trained on notices of licences that are no family. Calibration uses examples
that did not train: a temperature for the probabilities; ``licensed``, from which probability on something is a licence
at all, so that at most FALSE_ALARMS of the windows without one pass; and ``sure``, from which on a family counts, so that
at most FALSE_FAMILIES of the notices of further licences, none of which trained, are taken for a family. A family also
needs one of its notices to confirm it by common word pairs; what is a licence otherwise is ``unknown``, and must have one
of TERMS. (The families' own notices both train and confirm: confirmation guards the wording, it is no second opinion.)

Of matches that share words, the one stays that has the largest part of its notice; unknown ones come last. A match is
the whole line where its notice lies in one of at most MAX_WORDS words that has no other match, else it reaches from the
notice's first word to its last. ``n_paragraphs`` counts lines with words, long ones in parts of MAX_WORDS.

All lines and windows of all documents are scored, in numpy on whole batches.

Edge cases: null and empty texts have no paragraphs; blank lines are none; very long lines are scored in windows, whole;
repeated rows are judged one by one; without documents only the notices and fixed phrases train; other columns pass
through ``scan_licenses`` and clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import bound_batches
from tallyloom.llm.secrets import in_code_points
from tallyloom.llm.textbatch import folded, hashed_words, mix, pieces, utf8_column, words_of

NONE, UNKNOWN = "none", "unknown"
#: How each family announces itself.
NOTICES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
        "Distributed under the Apache Software License",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "Released under the GPL version 2",
    ),
    "lgpl": (
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "available under the Creative Commons Attribution-ShareAlike License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC-SA 4.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain",
        "Dedicated to the public domain under CC0 1.0 Universal",
        "The author has waived all copyright and related rights to this work, CC0",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2020. All rights reserved.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited",
        "No part of this publication may be reproduced without prior written permission of the publisher",
    ),
}
#: How licences outside the families announce themselves. The first list trains the unknown class, the second calibrates it.
OTHER_LICENSES = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Distributed under the Boost Software License, Version 1.0",
    "This package is distributed under the terms of the Artistic License 2.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "Licensed under the European Union Public Licence, version 1.2",
    "This source is subject to the Microsoft Public License",
    "Licensed under the terms of the Python Software Foundation license agreement",
    "Licensed under the Open Software License version 3.0",
    "This file may be used under a custom license that grants special rights to licensed users",
)
HELD_OUT_LICENSES = (
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1",
    "This database is made available under the Open Database License",
    "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software",
    "Licensed under the University of Illinois Open Source License",
    "Use is subject to a commercial license with royalty payments",
)
#: Sentences that use the same words and are no licence.
OTHER_PHRASES = (
    "the driver showed his license to the officer", "a public version of the work was released under the bridge",
    "all the rights of the people were reserved for the general", "the software is free for a person to use", "version 2.0",
    "the general public was under the impression", "apache helicopters were modified", "source and binary forms of the work",
)
#: Words of which an unknown licence has one at least.
TERMS = frozenset(
    b"license licence licensed licensing copyright copyrighted redistribution redistribute permission permitted rights warranty proprietary spdx copyleft royalty".split()
)
FAMILIES = (NONE, *NOTICES, UNKNOWN)
BITS, MAX_WORDS, PIECE_BYTES = 16, 64, 1 << 19
#: Lengths of windows in words. Half of the last, and one, is at least the longest notice.
WINDOWS = (8, 16, 32, MAX_WORDS)
#: Windows are scored in runs of so many words.
WORDS_AT_ONCE = 1 << 16
PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Shares of windows without a licence, and of notices of other licences, that calibration lets pass.
FALSE_ALARMS, FALSE_FAMILIES = 0.005, 0.02


def grams(words: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed one-grams and two-grams of rows of words, row after row, and how many each row has."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(n_words), np.int64)
    slot = ((words >> np.uint64(64 - BITS)) | np.uint64(0)).astype(np.int64)
    follow = np.concatenate((words[1:], words[:1]))
    pair = (mix(words * PAIR + follow) >> np.uint64(64 - BITS)).astype(np.int64)
    last = np.cumsum(n_words)[n_words > 0] - 1
    pair[last] = slot[last]  # no pair across rows: the last word counts twice
    return np.stack((slot, pair), axis=1).ravel(), 2 * n_words


@dataclass
class Classifier:
    weights: np.ndarray  # slots by families
    bias: np.ndarray
    temperature: float = 1.0
    licensed: float = 0.5
    sure: float = 0.7
    #: On held-out examples: expected calibration error, and what share of further licences is told to be one, and no family.
    quality: dict[str, float] = field(default_factory=dict)

    def probabilities(self, words: np.ndarray, n_words: np.ndarray) -> np.ndarray:
        """Rows by families; rows must have words."""
        slots, counts = grams(words, n_words)
        starts = np.cumsum(counts) - counts
        return self._softmax(np.add.reduceat(self.weights[slots], starts, axis=0) / np.sqrt(counts)[:, None])

    def of_windows(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Windows, of words ``first`` to before ``last`` (MAX_WORDS at most) and in order of ``first``, by families."""
        out = np.empty((len(first), len(FAMILIES)))
        for at in range(0, len(words), WORDS_AT_ONCE):
            lo, hi = np.searchsorted(first, (at, at + WORDS_AT_ONCE))
            if lo == hi:
                continue
            slots, _ = grams(words[at : at + WORDS_AT_ONCE + MAX_WORDS], np.array([len(words[at : at + WORDS_AT_ONCE + MAX_WORDS])]))
            single, pair = self.weights[slots[::2]], self.weights[slots[1::2]]
            sums = np.zeros((len(single) + 1, len(FAMILIES)))
            np.cumsum(single + pair, axis=0, dtype=np.float64, out=sums[1:])
            a, b = first[lo:hi] - at, last[lo:hi] - at
            # as in grams, the last word counts twice and makes no pair
            z = sums[b] - sums[a] - pair[b - 1] + single[b - 1]
            out[lo:hi] = self._softmax(z / np.sqrt(2 * (b - a))[:, None])
        return out

    def _softmax(self, z: np.ndarray) -> np.ndarray:
        z = (z + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _hashes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    data = [b" ".join(t) for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    words, rows, _ = hashed_words(memoryview(b"".join(data)), offsets)
    return words, np.bincount(rows, minlength=len(texts))


def _noted(notices: tuple[str, ...], copies: int, rng: np.random.Generator, other: list[list[bytes]]) -> list[list[bytes]]:
    """Varied copies of notices: with words left out, random neighbours, and in windows of WINDOWS words."""
    examples = []
    for notice in notices:
        base = words_of(notice.encode())
        for copy in range(copies):
            words = [w for w in base if len(base) < 6 or copy == 0 or rng.random() > 0.08]
            if copy % 2:
                words = [*_filler(other, int(rng.integers(0, 6)), rng), *words, *_filler(other, int(rng.integers(0, 10)), rng)]
            examples.append(words[:MAX_WORDS])  # notices are shorter
            words = [w for w in base if len(base) < 6 or rng.random() > 0.08]
            fits = [n for n in WINDOWS if len(words) <= n and (n == WINDOWS[0] or n < 4 * len(words))]
            more = int(rng.choice(fits)) - len(words)
            before = int(rng.integers(more + 1))
            examples.append([*_filler(other, before, rng), *words, *_filler(other, more - before, rng)])
    return examples


def _filler(other: list[list[bytes]], n: int, rng: np.random.Generator) -> list[bytes]:
    found: list[bytes] = []
    while len(found) < n:
        found += other[rng.integers(len(other))]
    at = rng.integers(len(found) - n + 1)
    return found[at : at + n]


def train(other: list[list[bytes]], rounds: int = 20, copies: int = 40, seed: int = 4) -> Classifier:
    """Fit on varied notices against ``other`` paragraphs (lists of words), both as they are (long ones cut at random) and in
    windows of WINDOWS words. Every fifth example, and the held-out licences, calibrate.
    """
    rng = np.random.default_rng(seed)
    other = [w for w in other if w] + [words_of(p.encode()) for p in OTHER_PHRASES]
    examples: list[list[bytes]] = []
    labels: list[int] = []
    for k, notices in enumerate([*NOTICES.values(), OTHER_LICENSES], 1):
        made = _noted(notices, copies, rng, other)
        examples += made
        labels += [k] * len(made)
    cuts = [w if len(w) <= MAX_WORDS else w[(at := int(rng.integers(len(w) - MAX_WORDS + 1))) : at + MAX_WORDS] for w in other]
    plain = [*cuts, *(_filler(other, int(rng.choice(WINDOWS)), rng) for _ in other), *([words_of(p.encode()) for p in OTHER_PHRASES] * (copies // 4))]
    examples += plain
    labels += [0] * len(plain)
    y = np.array(labels)
    words, n_words = _hashes(examples)
    slots, counts = grams(words, n_words)
    ends = np.cumsum(counts)
    order = rng.permutation(np.flatnonzero(counts > 0))
    held, used = order[::5], np.setdiff1d(order, order[::5])
    model = Classifier(np.zeros((1 << BITS, len(FAMILIES)), np.float32), np.zeros(len(FAMILIES)))
    seen, slots = np.unique(slots, return_inverse=True)
    weights = np.zeros((len(seen), len(FAMILIES)), np.float32)
    spread = np.full(weights.shape, 1e-4, np.float32)
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 192)):
            at = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in batch])
            n, mine = counts[batch], slots[at]
            scale = 1 / np.sqrt(n)
            z = np.add.reduceat(weights[mine], np.cumsum(n) - n, axis=0) * scale[:, None] + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            share = np.repeat(p * scale[:, None] / len(batch), n, axis=0)
            gradient = np.stack([np.bincount(mine, share[:, f], len(seen)) for f in range(share.shape[1])], axis=1).astype(np.float32)
            spread += gradient**2
            weights -= 0.2 * gradient / np.sqrt(spread)
            model.bias -= 0.05 * p.mean(axis=0)
    model.weights[seen] = weights
    _calibrate(model, [examples[i] for i in held], y[held], _noted(HELD_OUT_LICENSES, copies, rng, other))
    return model


def _calibrate(model: Classifier, held: list[list[bytes]], y: np.ndarray, further: list[list[bytes]]) -> None:
    best = None
    for temperature in np.geomspace(0.3, 3.0, 25):
        model.temperature = float(temperature)
        p = model.probabilities(*_hashes(held))
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
        if best is None or loss < best[0]:
            best = (loss, float(temperature))
    model.temperature = best[1]
    p, q = model.probabilities(*_hashes(held)), model.probabilities(*_hashes(further))
    clean = np.sort(1 - p[y == 0, 0])
    model.licensed = min(0.6, max(0.1, float(np.quantile(clean, 1 - FALSE_ALARMS)))) if len(clean) else 0.5
    family = q[:, 1:-1].max(axis=1)
    model.sure = min(0.95, max(0.5, float(np.quantile(family, 1 - FALSE_FAMILIES))))
    told, right = p.max(axis=1), p.argmax(axis=1) == y
    bins = np.minimum((told * 10).astype(int), 9)
    model.quality = {
        "calibration_error": float(sum(abs(told[bins == b].mean() - right[bins == b].mean()) * (bins == b).mean() for b in np.unique(bins))),
        "accuracy": float(right.mean()), "false_alarms": float((clean >= model.licensed).mean()) if len(clean) else 0.0,
        "further_told": float((1 - q[:, 0] >= model.licensed).mean()), "further_as_family": float((family >= model.sure).mean()),
    }


def _pairs(words: list[bytes]) -> set[bytes]:
    words = [w for w in words if not w.isdigit()]
    return {a + b" " + b for a, b in zip(words, words[1:], strict=False)} or set(words)


_TEMPLATES = {f: [_pairs(words_of(n.encode())) for n in notices] for f, notices in NOTICES.items()}


def confirmed(family: str, words: list[bytes], share: float = 0.6) -> bool:
    """Whether one notice of the family has at least ``share`` of its word pairs in the paragraph."""
    return _best_notice(family, words, share) is not None


def _best_notice(family: str, words: list[bytes], share: float = 0.6) -> tuple[float, int, set[bytes]] | None:
    """The share and number of word pairs found of the notice that has the largest share, and its pairs."""
    have = _pairs(words)
    found = [(len(t & have) / len(t), len(t & have), t) for t in _TEMPLATES[family] if len(t & have) >= share * len(t)]
    return max(found, key=lambda f: f[:2], default=None)


def _core(words: list[bytes], pairs: set[bytes]) -> tuple[int, int]:
    """The run of words in which the pairs lie densest, as (first, end)."""
    best, total, start = (0.0, 0, len(words)), 0.0, None
    at = [k for k, w in enumerate(words) if not w.isdigit()]
    for i, j in zip(at, at[1:], strict=False):
        if total <= 0:
            total, start = 0.0, i
        total += 1.0 if words[i] + b" " + words[j] in pairs else -0.5
        if total > best[0]:
            best = (total, start, j + 1)
    return best[1:]


def _paragraph_offsets(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of all rows and line starts."""
    return np.unique(np.concatenate((offsets, np.flatnonzero(raw == 10) + 1)))


OUT = ("n_paragraphs", "n_license", "family", "score", "matches")
_MATCH = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        for batch in batches:
            view, offsets = utf8_column(batch["text"])
            kept = [c for c in batch.schema.names if c not in ("text", *OUT)]
            for a, b in pieces(offsets, PIECE_BYTES):
                part, cut = view[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found, n_paragraphs = _matches(model, bytes(part), cut)
                rows = []
                for i in range(b - a):
                    text, mine = bytes(part[cut[i] : cut[i + 1]]), found.get(i, [])
                    where = in_code_points(text, [(s, k, e) for k, (_, s, e, _) in enumerate(mine)])
                    rows.append([{"family": mine[k][0], "start": s, "end": e, "score": mine[k][3]} for s, k, e in where])
                top = [max(r, key=lambda m: (m["family"] != UNKNOWN, m["score"], m["family"])) if r else None for r in rows]
                columns = {c: batch[c].slice(a, b - a) for c in kept}
                columns |= {
                    "n_paragraphs": pa.array(n_paragraphs, pa.int64()),
                    "n_license": pa.array([len(r) for r in rows], pa.int64()),
                    "family": pa.array([t["family"] if t else NONE for t in top], pa.string()),
                    "score": pa.array([t["score"] if t else None for t in top], pa.float64()),
                    "matches": pa.array(rows, _MATCH),
                }
                yield pa.RecordBatch.from_pydict(columns)

    return scan


def _windows(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (exclusive) words of all windows of paragraphs of ``n_words`` words each, end to end, in order of the first."""
    begin = np.cumsum(n_words) - n_words
    firsts, lasts, least = [], [], 0
    for size in WINDOWS:
        # a paragraph that a shorter window holds whole has none of this size
        mine = np.flatnonzero(n_words > least)
        n, step = n_words[mine], size // 2
        count = np.maximum(n - size + step - 1, 0) // step + 1
        owner = np.repeat(np.arange(len(mine)), count)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = np.minimum(rank * step, np.maximum(n - size, 0)[owner])
        firsts.append(begin[mine][owner] + start)
        lasts.append(begin[mine][owner] + np.minimum(start + size, n[owner]))
        least = size
    first, last = np.concatenate(firsts), np.concatenate(lasts)
    order = np.argsort(first, kind="stable")
    return first[order], last[order]


def _matches(model: Classifier, part: bytes, cut: np.ndarray) -> tuple[dict[int, list[tuple[str, int, int, float]]], np.ndarray]:
    """Matches of each row as (family, first byte, end, probability), and its number of lines with words."""
    lines = _paragraph_offsets(np.frombuffer(part, np.uint8), cut)
    words, owner, begins = hashed_words(memoryview(part), lines)
    n_paragraphs = np.zeros(len(cut) - 1, np.int64)
    found: dict[int, list[tuple[str, int, int, float]]] = {}
    if not len(words):
        return found, n_paragraphs
    row = np.searchsorted(cut, begins, side="right") - 1
    line_first, line_end = np.searchsorted(owner, owner, side="left"), np.searchsorted(owner, owner, side="right")
    starts = np.flatnonzero((np.arange(len(words)) - line_first) % MAX_WORDS == 0)
    ends = np.append(starts[1:], len(words))
    np.add.at(n_paragraphs, row[starts], 1)
    paragraph = np.flatnonzero(np.concatenate(([True], (owner[1:] > owner[:-1] + 1) | (row[1:] != row[:-1]))))
    first, last = _windows(np.diff(np.append(paragraph, len(words))))
    begins_to = np.append(begins, len(part))

    known, unknown = [], []
    for is_line, a, b in ((True, starts, ends), (False, first, last)):
        p = model.of_windows(words, a, b)
        for k in np.flatnonzero(1 - p[:, 0] >= model.licensed).tolist():
            i, j = int(a[k]), int(b[k])
            its_words = words_of(part[begins_to[i] : begins_to[j]])
            best = int(p[k, 1:-1].argmax()) + 1
            chance = float(p[k, best])
            notice = _best_notice(FAMILIES[best], its_words) if chance >= model.sure else None
            if notice:
                c, d = _core(its_words, notice[2])
                known.append((notice[0], notice[1], is_line, chance, i + c, i + d, FAMILIES[best]))
            elif not TERMS.isdisjoint(its_words):
                unknown.append((is_line, j - i, float(1 - p[k, 0]), i, j))
    # the fullest are placed first, and none on words that are taken
    taken = np.zeros(len(words), bool)
    placed = []
    for _, _, _, chance, i, j, family in sorted(known, key=lambda m: (*(-x for x in m[:4]), *m[4:])):
        if not taken[i:j].any():
            taken[i:j] = True
            placed.append((i, j, family, chance))
    for _, _, chance, i, j in sorted(unknown, key=lambda m: (*(-x for x in m[:3]), *m[3:])):
        if not taken[i:j].any():
            taken[i:j] = True
            placed.append((i, j, UNKNOWN, chance))
    placed.sort()
    for k, (i, j, family, chance) in enumerate(placed):
        a, b = int(line_first[i]), int(line_end[i])
        alone = (k == 0 or placed[k - 1][1] <= a) and (k + 1 == len(placed) or placed[k + 1][0] >= b)
        if j <= b and b - a <= MAX_WORDS and alone:
            start = int(begins[a])
            end = start + len(part[start : int(lines[owner[a] + 1])].rstrip())
        else:
            start, tail = int(begins[i]), int(begins[j - 1])
            end = tail + len(folded(part[tail : int(begins_to[j])]).rstrip(b" "))
        at = int(row[i])
        found.setdefault(at, []).append((family, start - int(cut[at]), end - int(cut[at]), chance))
    return found, n_paragraphs


#: The longest piece of a line that is an example of no licence.
PIECE_CHARS = 2000


def fit(docs: DataFrame, fit_rows: int = 400, fit_paragraphs: int = 3000) -> Classifier:
    """Train against at most ``fit_paragraphs`` paragraphs of about ``fit_rows`` documents, picked by a hash of id and text.

    A line is cut into pieces of PIECE_CHARS before it leaves the tasks, so the sample is of bounded size. Sampled paragraphs that a notice confirms are left out: they are not examples of "no licence".
    """
    share = min(1.0, fit_rows / max(docs.count(), 1))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(4)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    pieces = F.regexp_extract_all("text", F.lit(f"[^\n]{{1,{PIECE_CHARS}}}"), F.lit(0))
    lines = picked.select(F.explode(pieces).alias("line")).where("length(trim(line)) > 0").distinct()
    lines = [words_of(r["line"].encode()) for r in lines.orderBy(F.xxhash64("line"), "line").limit(fit_paragraphs).collect()]
    return train([w for w in lines if not any(confirmed(f, w) for f in NOTICES)])


def scan_licenses(docs: DataFrame, model: Classifier) -> DataFrame:
    """The columns of ``docs`` but ``text``, with the number of paragraphs, the licence matches and the surest family."""
    kept = docs.select(*(c for c in docs.columns if c not in OUT))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "text"]
    fields += ["n_paragraphs bigint", "n_license bigint", "family string", "score double"]
    fields += ["matches array<struct<family: string, start: bigint, end: bigint, score: double>>"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return bound_batches(kept).mapInArrow(_scanner(shared), ", ".join(fields))


def op4_licenses(docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", "text")
    return scan_licenses(texts, fit(texts))
