"""Personal data in texts: four fixed patterns and a linear-chain CRF.

The CRF labels white-space tokens by their word shapes and those of their
neighbours. It is trained here, on a small labelled table, and decoded by Viterbi
over padded numpy batches, each line of a text from its first token to its last; very
long lines go in overlapping stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column

from tallyweave.llm import _spans
from tallyweave.llm._spans import Span

# The patterns of the contract, written so that no text makes them
# slow. Runs of digits are taken whole (no later start in a run can match when its
# first doesn't); an address is found at its at sign and widened to the left.
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "phone", "id")
KINDS = (*BASE, *(f"crf_{x}" for x in LABELS[1:]))
#: Tokens that are decoded together, and tokens whose features are remembered.
HELD, KNOWN = 1 << 17, 1 << 17
#: Tokens of a line that are decoded as one sequence, and tokens that a longer line's
#: stretches share with their neighbours on either side, so that labels near a cut are
#: those of a sequence that goes on. A stretch reports the runs that begin in it.
STRETCH, SHARED = 1 << 14, 64
#: Characters of a token that its shape is taken from; longer ones differ in no feature but
#: their number of digits and at signs, which count in full.
SHAPED = 64


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    doubled = (2 * d - 9 * (d > 4) for d in digits[-2::-2])
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    spans: list[Span] = []
    if "@" in text:
        done = 0
        for m in _HOST.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                spans.append(("email", start, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            spans.append(("phone", m.start(), m.end()))
    return spans


# --- the labelled table --------------------------------------------------------

#: Sentences of the labelled table. A slot in braces stands for tokens of its kind,
#: which a seeded rule fills in; all other tokens are labelled O.
SENTENCES = (
    "please write to {email} before noon", "contact {email} or {email} for details", "{email} is my address",
    "mail me at {email}, thanks", "you can reach the office under {email} or by phone at {phone}", "sent from {email} on {date}",
    "forward the invoice to {email} and keep a copy", "e-mail: {email}", "cc {email}; {email}", "her address was {email} until {year}",
    "call {phone} today", "phone: {phone}", "tel {phone} or {phone}", "if nobody answers, try {phone} instead", "fax {phone} office",
    "her number is {phone}.", "ring ({phone}) after {date}", "my card {card} expires {date}", "card number {card}",
    "the customer paid with {card} last week", "pay with {card} now", "charged to {card}, total {price}", "server {ip} is down",
    "login from {ip} at {time}", "requests came from {ip} all night", "host {ip} port {small}", "address {ip}, gateway {ip}",
    "ssn {id} on file", "her id {id} was copied", "account {id} closed", "social security {id}, born {date}", "transfer it to {id} please",
    "version {version} of the licence", "under licence {version}", "in {year} we sold {small} units",
    "the meeting is on {date} at {time}", "see page {small} of chapter {small}", "it costs {price} each",
    "between {year} and {year} about {big} people", "section {version} applies", "follow @{word} for news",
    "{small} of {small} items, {big} in all", "at {time} on {date}", "room {small} floor {small}", "isbn {book} in print",
    "order {big} shipped {date}", "{word}{small} and {word}{small}", "copyright {year} the authors", "grew by {percent} in {year}",
    "token = {hash} was revoked", "the key {key} is no longer in use", "password={hash} in the log", "commit {hash} of {date}", "rotate {key} and {hash} soon", "page {small}: contact {email} for details", "notes of {date}: write to {email} about room {small}",
    "upgrade to version {version} before {date}", "the score was {small} to {small}", "flight {word} {small} leaves at {time}",
    "we met at noon and left at {time}", "look at the dot on the map", "the dot product at the end of page {small}", "he works at a dot com company",
    "they arrived at the station at {time}", "a red dot at each corner", "meet us at the gate", "the com port at slot {small}", "she laughed at {word} and sat down",
)


def _filler(kind: str, rng: np.random.Generator) -> str:
    def d(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word(n: int) -> str:
        return "".join(chr(97 + x) for x in rng.integers(0, 26, n))

    pick = lambda *forms: forms[rng.integers(len(forms))]
    n = int(rng.integers(3, 9))
    if kind == "email":
        host = pick(f"{word(n)}.com", f"{word(4)}.{word(5)}.org", f"{word(6)}.net", f"{word(5)}{d(1)}.de", f"{word(5)}.co.uk", f"mail.{word(n)}.edu")
        name = pick(word(n), f"{word(4)}.{word(n)}", f"{word(3)}_{word(n)}", f"{word(n)}{d(3)}", f"{word(n)}.{d(2)}", f"{word(1)}-{word(n)}")
        end = pick("com", "org", "net", "de")
        return pick(f"{name}@{host}", f"{name}@{host}", f"{name}@{host}", f"{word(n)} at {word(6)} dot {end}", f"{word(n)} (at) {word(6)} (dot) {end}", f"{word(n)}[at]{word(6)}.{end}")
    if kind == "phone":
        return pick(f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"+{d(11)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(3)}", f"({d(3)}) {d(4)} {d(4)}", f"+{d(1)} {d(3)}-{d(3)}-{d(4)}")
    if kind == "card":
        return pick(f"4{d(15)}", f"5{d(3)} {d(4)} {d(4)} {d(4)}", f"4{d(3)}-{d(4)}-{d(4)}-{d(4)}", f"37{d(13)}")
    if kind == "ip":
        return ".".join(str(x) for x in rng.integers(1, 256, 4))
    if kind == "id":
        return pick(f"{d(3)}-{d(2)}-{d(4)}", f"{word(2).upper()}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}")
    if kind == "date":
        return pick(f"{d(2)}/{d(2)}/20{d(2)}", f"20{d(2)}-{d(2)}-{d(2)}", f"{d(1)} May 20{d(2)}")
    if kind == "price":
        return pick(f"${d(2)}.{d(2)}", f"{d(3)},{d(2)} EUR", f"{d(4)} USD")
    forms = {"time": f"{d(2)}:{d(2)}", "version": pick(f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.{d(1)}.{d(1)}.{d(1)}", f"v{d(1)}.{d(2)}"), "year": f"19{d(2)}", "small": d(2), "big": f"{d(2)},{d(3)}", "percent": f"{d(2)}%", "word": word(n), "hash": "".join("0123456789abcdef"[x] for x in rng.integers(0, 16, 40)), "key": f"AKIA{word(5).upper()}{d(2)}{word(4).upper()}{d(1)}", "book": f"978-{d(1)}-{d(5)}-{d(3)}-{d(1)}"}
    return forms[kind]


def labelled_table(copies: int = 8, seed: int = 7) -> pd.DataFrame:
    """The training table: ``sentence``, ``position``, ``token``, ``label``."""
    rng, rows, n = np.random.default_rng(seed), [], 0
    for _ in range(copies):
        for sentence in SENTENCES:
            position = 0
            for part in sentence.split(" "):
                before, _, rest = part.partition("{")
                kind, _, after = rest.partition("}")
                kind = kind if kind and "{" not in after else ""
                filled = re.sub(r"\{(\w+)\}", lambda m: _filler(m[1], rng), part)
                for token in filled.split(" "):
                    label = kind if kind in LABELS else "O"
                    rows.append((n, position, token, label))
                    position += 1
            n += 1
    return pd.DataFrame(rows, columns=["sentence", "position", "token", "label"])


# --- the model ------------------------------------------------------------------

_EDGE = "()[]{}<>\"',;:!?"
_CUES = frozenset("at dot call phone tel fax mail card pay ssn id account social security number host server ip isbn page version licence license section".split())


_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(1 << 16)
def _shapes(token: str) -> tuple[str, str]:
    """Word shape, runs collapsed, and the same with lengths of digit runs."""
    marks = _LETTERS.sub("x", token[:SHAPED])
    return re.sub(r"[0-9]+", "d", marks), re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 17)}", marks)


STEPS = (-2, -1, 1, 2)


def _own(whole: str) -> list[str]:
    """Features of a token itself."""
    token = whole.rstrip(".").strip(_EDGE)
    short, long = _shapes(token)
    digits = sum("0" <= c <= "9" for c in whole)
    return ["bias", f"s={short}", f"l={long}", f"n={min(digits, 20)}", f"a={token.count('@')}{'.' in token.partition('@')[2]}{min(token.count('.'), 4)}{token[:1] == '+'}", f"at={'@' in token and '.' in token.partition('@')[2]}", f"w={token.lower() if token.lower() in _CUES else ''}"]


def _near(whole: str | None, step: int) -> list[str]:
    """Features that a token (None: the line's end) gives to the one it is ``step`` from."""
    if whole is None:
        return [f"{step}none"]
    near = whole.rstrip(".").strip(_EDGE)
    return [f"{step}s={_shapes(near)[1 if abs(step) == 1 else 0]}", f"{step}w={near.lower() if near.lower() in _CUES else ''}"]


def _plain(token: str) -> str:
    """A token of the same features, one for many: runs of letters matter as cues only."""
    if len(token) > SHAPED or token.rstrip(".").strip(_EDGE).lower() in _CUES:
        return token
    return _LETTERS.sub("x", token)


def features(tokens: list[str], at: int) -> list[str]:
    out = _own(tokens[at])
    for step in STEPS:
        out += _near(tokens[at + step] if 0 <= at + step < len(tokens) else None, step)
    return out


class ChainCrf:
    """Linear-chain CRF: label scores from token features, and label pair scores."""

    def __init__(self, table: pd.DataFrame, rounds: int = 120, l2: float = 0.02, rate: float = 0.3):
        sentences = [g for _, g in table.groupby("sentence", sort=True)]
        tokens = [g["token"].tolist() for g in sentences]
        self.ids: dict[str, int] = {}
        self.k = len(LABELS)
        self.known: dict[str, int] = {}
        named = [[[self.ids.setdefault(f, len(self.ids)) for f in features(t, i)] for i in range(len(t))] for t in tokens]
        gold = [np.array([LABELS.index(x) for x in g["label"]]) for g in sentences]
        long, n = max(map(len, tokens)), len(tokens)
        self.weights = np.zeros((len(self.ids), self.k))
        self.moves = np.zeros((self.k, self.k))
        flat = np.array([f for s in named for t in s for f in t])
        starts = np.cumsum([0] + [len(t) for s in named for t in s][:-1])
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(flat))))
        place = np.array([i * long + j for i, s in enumerate(named) for j in range(len(s))])
        lengths = np.array(list(map(len, tokens)))
        inside = np.arange(long)[None, :] < lengths[:, None]
        truth = np.concatenate(gold)
        seen_moves = np.zeros_like(self.moves)
        for g in gold:
            np.add.at(seen_moves, (g[:-1], g[1:]), 1)
        past_w, past_m = np.full_like(self.weights, 1e-8), np.full_like(self.moves, 1e-8)
        for _ in range(rounds):
            scores = np.add.reduceat(self.weights[flat], starts, axis=0)
            padded = np.zeros((n * long, self.k))
            padded[place] = scores
            chance, pairs = self._expected(padded.reshape(n, long, self.k), inside)
            miss = -chance.reshape(n * long, self.k)[place]
            miss[np.arange(len(truth)), truth] += 1
            grad_w = -l2 * self.weights
            np.add.at(grad_w, flat, miss[owner])
            grad_m = seen_moves - pairs - l2 * self.moves
            past_w += grad_w**2
            past_m += grad_m**2
            self.weights += rate * grad_w / np.sqrt(past_w)
            self.moves += rate * grad_m / np.sqrt(past_m)
        self.rows: dict[tuple[tuple[int, ...], ...], int] = {}
        self.tables: list[list[np.ndarray]] = []
        self._kind(None)

    def _expected(self, scores: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: chances of labels, and expected counts of label pairs."""
        n, long, k = scores.shape

        def logsum(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = scores[:, 0]
        for t in range(1, long):
            new = logsum(ahead[:, t - 1, :, None] + self.moves, 1) + scores[:, t]
            ahead[:, t] = np.where(inside[:, t, None], new, ahead[:, t - 1])
        for t in range(long - 2, -1, -1):
            new = logsum(self.moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(inside[:, t + 1, None], new, 0)
        whole = logsum(ahead[:, -1], 1)
        chance = np.exp(ahead + back - whole[:, None, None]) * inside[..., None]
        pairs = np.zeros((k, k))
        for t in range(long - 1):
            joint = ahead[:, t, :, None] + self.moves + (scores[:, t + 1] + back[:, t + 1])[:, None, :] - whole[:, None, None]
            pairs += (np.exp(np.minimum(joint, 0)) * inside[:, t + 1, None, None]).sum(axis=0)
        return chance, pairs

    def _kind(self, token: str | None) -> int:
        """The row of ``tables`` for a token. Tokens with the same known features share
        one, so there are no more rows than the trained features allow."""
        lists = [_own(token) if token is not None else [], *(_near(token, step) for step in STEPS)]
        known = tuple(tuple(self.ids[f] for f in x if f in self.ids) for x in lists)
        if known not in self.rows:
            self.rows[known] = len(self.rows)
            self.tables.append([self.weights[list(x)].sum(axis=0) for x in known])
        return self.rows[known]

    def _kinds(self, tokens: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[t] for t in tokens]
        except KeyError:
            if len(known) > KNOWN:
                known.clear()
            for t in tokens:
                if t not in known:
                    plain = _plain(t)
                    if plain not in known:
                        known[plain] = self._kind(plain)
                    known[t] = known[plain]
            return [known[t] for t in tokens]

    def scores(self, sequences: list[list[int]]) -> np.ndarray:
        """Label scores (sequence, token, label), padded, from rows of ``tables``."""
        long = max(map(len, sequences))
        rows = np.zeros((len(sequences), long + 4), np.int32)  # row 0: the end
        for row, kinds in zip(rows, sequences, strict=True):
            row[2 : 2 + len(kinds)] = kinds
        tables = np.array(self.tables)
        out = tables[rows[:, 2:-2], 0]
        for i, step in enumerate(STEPS, 1):
            out += tables[rows[:, 2 + step : 2 + step + long], i]
        return out

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of a padded batch (sequence, token, label); equal paths: the
        lower label. Labels after a sequence's end mean nothing."""
        n, long, k = scores.shape
        best, came = scores[:, 0], np.zeros((long, n, k), np.int8)
        least = lengths.min()
        for t in range(1, long):
            new, here = best[:, :1] + self.moves[0], came[t]
            for a in range(1, k):
                step = best[:, a : a + 1] + self.moves[a]
                here[step > new] = a
                np.maximum(new, step, out=new)
            new += scores[:, t]
            if t >= least:
                over = t >= lengths
                new[over], here[over] = best[over], np.arange(k)
            best = new
        labels = np.empty((n, long), np.int8)
        labels[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(long - 1, 0, -1):
            labels[:, t - 1] = came[t, rows, labels[:, t]]
        return labels

    def decode(self, sequences: list[list[str]], batch: int = 32768) -> list[np.ndarray]:
        """Labels of each sequence; sequences of like length share a batch of about
        ``batch`` tokens."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sequences)
        kinds = [self._kinds(x) for x in sequences]
        order = sorted((i for i, x in enumerate(kinds) if x), key=lambda i: -len(kinds[i]))
        at = 0
        while at < len(order):
            part = order[at : at + max(1, batch // len(kinds[order[at]]))]
            at += len(part)
            lengths = np.array([len(kinds[i]) for i in part])
            for i, size, labels in zip(part, lengths, self.viterbi(self.scores([kinds[i] for i in part]), lengths), strict=True):
                out[i] = labels[:size]
        return out


_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


class Finder:
    """Base spans and the spans of a trained CRF."""

    def __init__(self, model: ChainCrf | None = None):
        self.model = model or ChainCrf(labelled_table())

    def find_all(self, texts: list[str]) -> list[list[Span]]:
        spans = [base_spans(x) for x in texts]
        held: list[_Stretch] = []
        waiting = 0
        for n, text in enumerate(texts):
            for stretch in _stretches(n, text):
                held.append(stretch)
                waiting += len(stretch.tokens)
                if waiting > HELD:
                    self._flush(texts, held, spans)
                    held, waiting = [], 0
        self._flush(texts, held, spans)
        return [_spans.in_order(x, KINDS) for x in spans]

    def _flush(self, texts: list[str], held: list[_Stretch], spans: list[list[Span]]) -> None:
        for s, labels in zip(held, self.model.decode([s.tokens for s in held]), strict=True):
            if labels.any():
                spans[s.text] += _runs(texts[s.text], s, labels)


class _Stretch(NamedTuple):
    """Tokens of a line, or of a part of a very long one: the text's number, the place of the
    first token in the text, and the tokens, by number, whose runs are reported."""

    text: int
    start: int
    tokens: list[str]
    first: int
    last: int


def _stretches(number: int, text: str) -> Iterator[_Stretch]:
    at = 0
    for line in _lines(text):
        if len(line) <= STRETCH:  # so are its tokens
            if words := _TOKEN.findall(line):
                yield _Stretch(number, at, words, 0, len(words))
        else:
            yield from _long_line(number, at, line)
        at += len(line) + 1


def _lines(text: str) -> Iterator[str]:
    at = 0
    while (end := text.find("\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _long_line(number: int, at: int, line: str) -> Iterator[_Stretch]:
    found = _TOKEN.finditer(line)
    kept: list[re.Match[str]] = []
    first, more = 0, True
    while more:
        new = list(islice(found, STRETCH + SHARED - (len(kept) - first)))
        kept += new
        last = min(len(kept), first + STRETCH)
        more = len(kept) > last
        if last > first:
            yield _Stretch(number, at + kept[0].start(), [m[0] for m in kept], first, last)
        drop = max(0, last - SHARED)
        kept, first = kept[drop:], last - drop


def _runs(text: str, s: _Stretch, labels: np.ndarray) -> list[Span]:
    """Spans of the runs of one label that begin among the stretch's own tokens."""
    edges = np.flatnonzero(np.diff(labels)) + 1
    starts, ends = np.append(0, edges), np.append(edges, len(labels))
    out: list[Span] = []
    wanted = [(i, j) for i, j in zip(starts.tolist(), ends.tolist(), strict=True) if labels[i] and s.first <= i < s.last]
    if not wanted:
        return out
    tokens = [(m.start(), m.end()) for m in islice(_TOKEN.finditer(text, s.start), wanted[-1][1])]
    for i, j in wanted:
        start, end = tokens[i][0], tokens[j - 1][1]
        while start < end and text[start] in "[{<\"',;:!?.":
            start += 1
        while end > start and text[end - 1] in "]}>\"',;:!?.":
            end -= 1
        if start < end:
            out.append((f"crf_{LABELS[labels[i]]}", start, end))
    return out


def personal_spans(text: Column, finder: Finder | None = None) -> Column:
    """Array of ``kind, start, end`` in code points (end exclusive), by start, then
    kind in the order of ``KINDS``. Null and empty texts give an empty array, texts and lines
    of any length are read whole in bounded memory, equal texts give equal spans, and an empty
    table gives no rows. It is a column of one other column, so names of others don't matter."""
    return _spans.span_column(text, (finder or Finder()).find_all)


def without_personal(text: Column, mark: str = "[PII]", finder: Finder | None = None) -> Column:
    """The text with personal data replaced by ``mark``; null stays null."""
    return _spans.redacted(text, (finder or Finder()).find_all, mark)
