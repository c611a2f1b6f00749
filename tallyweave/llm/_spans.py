"""Spans of a text: their column type, their digest columns and redaction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Span = tuple[str, int, int]
SPANS = "array<struct<kind: string, start: int, end: int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def in_order(spans: Sequence[Span], kinds: Sequence[str]) -> list[Span]:
    """By start, then by the kind's place in ``kinds``, then by end; no repeats."""
    return sorted(set(spans), key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def span_column(text: Column, find: Callable[[list[str]], list[list[Span]]]) -> Column:
    """Column of ``SPANS`` from a function over a batch of texts (null: empty)."""

    @F.arrow_udf(SPANS)
    def of(texts: pa.Array) -> pa.Array:
        found = find([x or "" for x in texts.to_pylist()])
        return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in found], _ARROW)

    return of(text)


def redacted(text: Column, find: Callable[[list[str]], list[list[Span]]], mark: str) -> Column:
    """The text with each stretch that spans cover replaced by ``mark``; null stays."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        return pa.array([x and cover(x, s, mark) for x, s in zip(rows, find([x or "" for x in rows]))], pa.string())

    return of(text)


def cover(text: str, spans: Sequence[Span], mark: str) -> str:
    parts, done, reach = [], 0, -1
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= reach:
            if reach >= 0:
                done = reach
            parts += [text[done:start], mark]
        reach = max(reach, end)
    return "".join(parts) + text[max(reach, 0) :]


def of_kinds(spans: Column, kinds: Sequence[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined in the order of the array."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def n_of(spans: Column, kind: str) -> Column:
    return F.size(of_kinds(spans, [kind])).cast("long")
