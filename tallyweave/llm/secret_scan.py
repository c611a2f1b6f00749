"""Secrets in texts: three fixed patterns and high-entropy strings.

Candidate strings are long runs of the characters that keys and digests are
written in. Inside one, a window slides over each run of a character class; its
counts, and from them the Shannon entropy, are updated for the one character that
enters and the one that leaves. Windows above the class's threshold merge into
spans, and an allow list suppresses what is known to be harmless.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column

from tallyweave.llm import _spans
from tallyweave.llm._spans import Span

# The patterns of the contract, case-blind in ASCII for the first.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Kind of its spans, its characters as a regular expression's set, characters
    of a window, and bits of entropy from which a window counts. ``mixed``: it must
    also hold a digit and a letter."""

    kind: str
    characters: str
    window: int
    bits: float
    mixed: bool


CLASSES = (
    CharacterClass("ent_hex", "0-9a-fA-F", 20, 3.0, True),
    CharacterClass("ent_b64", "A-Za-z0-9+/_-", 20, 3.7, True),
)
KINDS = (*BASE, *(c.kind for c in CLASSES))
#: Whole runs that are never entropy secrets: UUIDs and paths of plain words.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[A-Za-z]*(?:[/_-][A-Za-z]{0,15}[0-9]{0,4})+",
)
#: Words that mark a piece between slashes as a placeholder; other pieces of its run count.
ALLOWED_WORDS = r"(?i:example|placeholder|changeme|your[_-]?(?:key|token)|xxxxxx|abcdefgh|01234567|12345678)"


@cache
def _weights(window: int) -> list[int]:
    """c * log2(c) for each count, in units of 2**-40, so that sums stay exact."""
    return [0] + [round(c * math.log2(c) * (1 << 40)) for c in range(1, window + 1)]


def entropy_spans(run: str, window: int, bits: float, mixed: bool = False) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` with at least ``bits`` of entropy."""
    if len(run) < window:
        return []
    weight = _weights(window)
    most = int((math.log2(window) - bits) * window * (1 << 40))  # the sum of c*log2(c) at which a window just counts
    counts: dict[str, int] = {}
    total = digits = letters = 0
    spans: list[tuple[int, int]] = []
    for at, new in enumerate(run):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += weight[c + 1] - weight[c] if c < window else 0
        digits += new.isdigit()
        letters += new.isalpha()
        start = at - window + 1
        if start > 0:
            old = run[start - 1]
            c = counts[old]
            counts[old] = c - 1
            total += weight[c - 1] - weight[c] if c <= window else 0
            digits -= old.isdigit()
            letters -= old.isalpha()
        if start >= 0 and total <= most and (not mixed or (digits and letters)):
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], at + 1)
            else:
                spans.append((start, at + 1))
    return spans


class Scanner:
    """Finds spans in texts; classes and allow list can be replaced."""

    def __init__(self, classes: tuple[CharacterClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, words: str = ALLOWED_WORDS):
        self.classes = classes
        self.kinds = (*BASE, *(c.kind for c in classes))
        self.allowed = [re.compile(x) for x in allowed]
        self.words = re.compile(words)
        every, least = "".join(c.characters.rstrip("-") for c in classes), min(c.window for c in classes)
        self.candidate = re.compile(rf"[{every}-]{{{least},}}")
        self.runs = [(c, re.compile(rf"[{c.characters}]{{{c.window},}}")) for c in classes]

    def _harmless(self, run: str) -> bool:
        return any(x.fullmatch(run) for x in self.allowed)

    def _stretches(self, run: str) -> list[tuple[int, str]]:
        """(place, text) of what is left of a run without its placeholder pieces."""
        if not self.words.search(run):
            return [(0, run)]
        out, at, start = [], 0, 0
        for piece in run.split("/"):
            end = at + len(piece)
            if self.words.search(piece):
                out.append((start, run[start:at]))
                start = end
            at = end + 1
        return [*out, (start, run[start:])]

    def entropy(self, text: str) -> list[Span]:
        spans: list[Span] = []
        for found in self.candidate.finditer(text):
            if self._harmless(found[0]):
                continue
            for place, stretch in self._stretches(found[0]):
                for c, runs in self.runs:
                    for run in runs.finditer(stretch):
                        if not self._harmless(run[0]):
                            at = found.start() + place + run.start()
                            spans += [(c.kind, at + a, at + b) for a, b in entropy_spans(run[0], c.window, c.bits, c.mixed)]
        return spans

    def find(self, text: str) -> list[Span]:
        spans: list[Span] = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        return _spans.in_order(spans + self.entropy(text), self.kinds)

    def find_all(self, texts: list[str]) -> list[list[Span]]:
        return [self.find(x) for x in texts]


def secret_spans(text: Column, scanner: Scanner | None = None) -> Column:
    """Array of ``kind, start, end`` in code points (end exclusive), by start, then
    kind in the order of ``KINDS``. Null and empty texts give an empty array, texts of any
    length are read whole, equal texts give equal spans, and an empty table gives no rows.
    It is a column of one other column, so names of further columns don't matter."""
    return _spans.span_column(text, (scanner or Scanner()).find_all)


def without_secrets(text: Column, mark: str = "[SECRET]", scanner: Scanner | None = None) -> Column:
    """The text with its secrets replaced by ``mark``; null stays null."""
    return _spans.redacted(text, (scanner or Scanner()).find_all, mark)
