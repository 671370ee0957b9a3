"""URL filtering by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And register. A batch of canonical URLs (``host`` +
``path``) is simulated together in numpy: one step per character position moves every rule on every URL.

Globs: ``*`` matches any run without ``/``, ``**`` any run, ``?`` one character except ``/``; every other
character, and each after a ``\\``, stands for itself; a glob must fit the whole canonical URL. The rule with the longest text wins,
ties go to the rule listed first.

Edge cases: a null URL, or one without ``://``, has an empty host and path, matches no rule and is blocked;
empty tables give empty results; repeated rows are judged one by one; other columns pass through, whatever their names.
A rule's host and path are taken literally, also ``*`` and ``?`` in them; in a table of rules a null path is an empty one, and a
row without host or verdict is no rule. URLs may be of any length: they are simulated in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.columns import bound_batches, set_aside

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of state that URLs simulated together may take, and the most of them: many rules make chunks short, not memory large.
STATE_BYTES, CHUNK = 1 << 25, 8192
#: Characters of a URL whose classes are looked up at once, for a chunk of URLs.
BLOCK = 256


#: The symbol of a glob that fits any character but ``/``.
ANY = "any"


@dataclass(frozen=True)
class Rule:
    """``text`` names the rule in results; each of ``globs`` fits what the rule covers."""

    text: str
    globs: tuple[str, ...]
    verdict: str


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule on ``host`` with all its subdomains, for paths that start with ``path``."""
    literal = re.sub(r"([*?\\])", r"\\\1", host + path)
    return Rule(host + path, (f"{literal}**", f"*.{literal}**"), verdict)


#: The production rules: (host, path) rules first, which outrank the method's own blocklist.
SITE_RULES = (
    site_rule("org", "/", "allow"),
    site_rule("example.org", "/es/", "block"),
    site_rule("example.org", "/en/1", "block"),
    site_rule("com", "/fr/", "allow"),
    site_rule("com", "/de/", "block"),
)
#: The method's blocklist for URLs that no site rule fits.
BLOCK_GLOBS = ("*spam*", "*pills*", "*casino*", "*viagra*", "*payday*", "*porn*")
METHOD_RULES = tuple(Rule(g, (g + "**",), "block") for g in BLOCK_GLOBS)


class ShiftAnd:
    """Globs packed into words of 64 bits; bit i of a glob says that its first i symbols have matched."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parse(g) for g in globs]
        literals = sorted({s for symbols, _ in parsed for s in symbols if s != ANY} | {"/"})
        self.literals = np.array([ord(c) for c in literals], dtype=np.uint32)
        classes, bits = len(literals) + 1, sum(len(symbols) + 1 for symbols, _ in parsed)
        self.words = max(1, -(-bits // 64))
        step, stay = np.zeros((classes, self.words * 64), bool), np.zeros((classes, self.words * 64), bool)
        self.start = np.zeros(self.words * 64, bool)
        ends: list[int] = []
        slash, at = literals.index("/"), 0
        for symbols, loops in parsed:
            self.start[at] = True
            for i, symbol in enumerate(symbols):
                if symbol == ANY:
                    step[:, at + i] = True
                    step[slash, at + i] = False
                else:
                    step[literals.index(symbol), at + i] = True
            for i, loop in loops.items():
                stay[:, at + i] = True
                stay[slash, at + i] = loop == "all"
            at += len(symbols) + 1
            ends.append(at - 1)
        self.step, self.stay, self.start = self._pack(step), self._pack(stay), self._pack(self.start[None])[0]
        self.accept_word = np.array(ends, np.int64) // 64
        self.accept_bit = np.uint64(1) << (np.array(ends, np.uint64) % np.uint64(64))
        self.chunk = max(1, min(CHUNK, STATE_BYTES // (8 * self.words + len(ends) * 9)))

    @staticmethod
    def _parse(glob: str) -> tuple[list[str], dict[int, str]]:
        symbols: list[str] = []
        loops: dict[int, str] = {}
        i = 0
        while i < len(glob):
            if glob[i] == "*":
                run = len(glob[i:]) - len(glob[i:].lstrip("*"))
                loops[len(symbols)] = "all" if run > 1 or loops.get(len(symbols)) == "all" else "host"
                i += run
                continue
            if glob[i] == "\\" and i + 1 < len(glob):
                i += 1
                symbols.append(glob[i])
            else:
                symbols.append(ANY if glob[i] == "?" else glob[i])
            i += 1
        return symbols, loops

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(len(bits), self.words)

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix: texts by globs."""
        out = np.zeros((len(texts), len(self.accept_word)), bool)
        for rows, fits in self.matches(texts):
            out[rows] = fits
        return out

    def first(self, texts: Sequence[str], owner: np.ndarray) -> np.ndarray:
        """For each text the least ``owner`` of the globs that fit, or -1; ``owner`` must ascend."""
        out = np.full(len(texts), -1)
        for rows, fits in self.matches(texts):
            best = fits.argmax(axis=1) if fits.shape[1] else np.zeros(len(rows), np.int64)
            some = fits.any(axis=1)
            out[rows[some]] = owner[best[some]]
        return out

    def matches(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of ``texts``, some at a time, and which globs fit them."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        for at in range(0, len(order), self.chunk):
            rows = order[at : at + self.chunk]
            yield rows, self._match_sorted([texts[i] for i in rows])

    def _match_sorted(self, texts: list[str]) -> np.ndarray:
        """``texts`` come longest first, so that those still running are always a leading slice."""
        lengths = np.array([len(t) for t in texts], np.int64)
        state = np.repeat(self.start[None], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for begin in range(0, int(lengths[0]) if len(lengths) else 0, BLOCK):
            running = int(np.searchsorted(-lengths, -begin, side="left"))
            parts = [t[begin : begin + BLOCK] for t in texts[:running]]
            flat = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            found = np.minimum(np.searchsorted(self.literals, flat), len(self.literals) - 1)
            classes = np.where(self.literals[found] == flat, found, len(self.literals))
            here = np.minimum(lengths[:running] - begin, BLOCK)
            offsets = np.cumsum(here) - here
            for position in range(int(here[0])):
                n = int(np.searchsorted(-here, -position, side="left"))
                c = classes[offsets[:n] + position]
                moved = state[:n] & self.step[c]
                shifted = moved << one
                shifted[:, 1:] |= moved[:, :-1] >> top
                state[:n] = shifted | (state[:n] & self.stay[c])
        return (state[:, self.accept_word] & self.accept_bit) != 0


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[Rule] = SITE_RULES,
    method_rules: Sequence[Rule] = METHOD_RULES,
    otherwise: str = "allow",
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``method_rule`` and ``verdict`` to ``pages``.

    ``rule`` is the longest of ``rules`` that fits; without one the longest of ``method_rules`` decides,
    and ``otherwise`` where none fits either. Columns of these names that ``pages`` has are replaced.
    """
    ranked = [sorted(some, key=lambda r: -len(r.text)) for some in (rules, method_rules)]
    machines = []
    for some in ranked:
        globs = [(g, k) for k, r in enumerate(some) for g in r.globs]
        machines.append((ShiftAnd([g for g, _ in globs]), np.array([k for _, k in globs], np.int64)))

    def decide(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            urls = (hosts + paths).tolist()
            best = [
                [some[k] if k >= 0 else None for k in machine.first(urls, owner).tolist()]
                for some, (machine, owner) in zip(ranked, machines, strict=True)
            ]
            yield pd.DataFrame(
                {
                    "rule": [r.text if r else None for r in best[0]],
                    "method_rule": [r.text if r else None for r in best[1]],
                    "verdict": [
                        a.verdict if a else "block" if not h else b.verdict if b else otherwise for a, b, h in zip(*best, hosts, strict=True)
                    ],
                }
            )

    decide_udf = F.pandas_udf(decide, "rule string, method_rule string, verdict string")
    added = ("host", "path", "rule", "method_rule", "verdict")
    others = [c for c in pages.columns if c not in added]
    pages = bound_batches(pages)
    kept, restore = set_aside(pages.select(*others), ())
    split = (
        pages.select(F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("address"), *(F.col(f"`{c}`").alias(k) for c, k in zip(others, kept.columns, strict=True)))
        .withColumn("start", F.instr("address", "://"))
        .withColumn("rest", F.when(F.col("start") > 0, F.expr("substring(address, start + 3)")).otherwise(""))
        .withColumn("host", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1))
    )
    judged = split.select(*kept.columns, "host", "path").withColumn("judged", decide_udf("host", "path"))
    judged = judged.select(*kept.columns, "host", "path", "judged.rule", "judged.method_rule", "judged.verdict")
    return restore(judged, *added)


def site_rules(rules: DataFrame) -> list[Rule]:
    """Rules from a table of ``host, path, verdict``, in order of host and path; they become one automaton, so the table must fit a worker."""
    rows = rules.where("host is not null and verdict is not null").select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").distinct().orderBy("host", "path", "verdict").toLocalIterator()
    return [site_rule(r["host"], r["path"], r["verdict"]) for r in rows]


def op1_url_filter(pages: DataFrame) -> DataFrame:
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "method_rule")
