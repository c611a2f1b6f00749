"""Exact histogram of encoded document lengths, and what suffix sums of it answer."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm._shared import Scratch, running_sums

#: Session setting with the path of the ranks of a byte-level BPE, one base64 token and its
#: rank a line, and where they are if it is unset.
RANKS_SETTING, RANKS = "tallyweave.tokenizer.ranks", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary splits texts before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths of a bucket of the two-level suffix sums.
SPREAD = 1 << 10


@cache
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


#: Characters that are split and merged at a time.
STRETCH = 1 << 17
#: A space between characters that are no white space: whatever the pattern makes of both
#: sides, a token ends before it, so texts can be cut there.
_CUT = re.compile(r"(?<=\S)\x20(?=\S)")


def stretches(text: str, length: int = STRETCH) -> Iterator[str]:
    """A text in parts that have the tokens of the whole, of about ``length`` characters;
    longer ones where it has no place to cut."""
    at = 0
    while len(text) - at > length:
        cut = _CUT.search(text, at + length)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def count_tokens(texts: list[str | None], ranks: bytes, pattern: str = PATTERN, length: int = STRETCH, whole: int = 1 << 19) -> np.ndarray:
    """Tokens of each text (null: 0). Strings of special tokens are ordinary text.

    The library's own splitter can run out of stack on a very long run of white space; a
    stretch of over ``whole`` characters, which has no single space in a whole ``whole``,
    is split by the same pattern in another engine. Tests hold the two against each other.
    """
    encoder, split = _encoder(ranks, pattern), None
    out = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for part in stretches(text or "", length):
            if len(part) <= whole:
                out[i] += len(encoder.encode_ordinary(part))
            else:
                split = split or regex.compile(pattern)
                out[i] += sum(len(encoder._encode_single_piece(m[0])) for m in split.finditer(part))
    return out


def token_count(text: Column, spark: SparkSession, ranks: str | None = None, pattern: str = PATTERN) -> Column:
    """Tokens of a text, as BIGINT. The driver reads the ranks (a vocabulary, so of
    bounded size) from the path ``ranks``, else from that in the session's setting
    ``RANKS_SETTING``, else from ``RANKS``, and sends them along; executors need no file.
    Null and empty texts have none; texts of any length are counted whole."""
    path = ranks or spark.conf.get(RANKS_SETTING, RANKS)
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: give token_count its path, or set {RANKS_SETTING}")
    with open(path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(count_tokens(texts.to_pylist(), sent.value, pattern))

    return of(text)


def length_histogram(docs: DataFrame, length: Column) -> DataFrame:
    """``n_tokens``, ``n_docs``: documents by their length. Every row counts."""
    return docs.select(length.alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_table(histogram: DataFrame, spark: SparkSession) -> DataFrame:
    """For each length L that occurs: ``n_docs`` of that length, ``docs_longer`` and
    ``tokens_longer`` (suffix sums over greater lengths), ``docs_to`` and
    ``tokens_to`` (totals up to L, so their last row is the grand total), and
    ``truncated_total``, the tokens left if every document is cut at L.

    The histogram has one row for each distinct length, and d distinct lengths need
    d * d / 2 tokens; running sums still go by buckets of lengths, not in one task.
    """
    kept = Scratch(spark, "lengths").keep(histogram, "histogram")
    rows = kept.select(
        F.lit(0).alias("all"),
        (F.col("n_tokens") / F.lit(SPREAD)).cast("long").alias("bucket"),
        "n_tokens",
        "n_docs",
        (F.col("n_tokens") * F.col("n_docs")).alias("tokens"),
    )
    whole = rows.agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    before = running_sums(rows, ["all"], "bucket", ["n_tokens"], {"n_docs": "docs_before", "tokens": "tokens_before"})
    to_docs, to_tokens = F.col("docs_before") + F.col("n_docs"), F.col("tokens_before") + F.col("tokens")
    longer = F.col("all_docs") - to_docs
    return before.crossJoin(F.broadcast(whole)).select(  # one row
        "n_tokens",
        "n_docs",
        to_docs.alias("docs_to"),
        to_tokens.alias("tokens_to"),
        longer.alias("docs_longer"),
        (F.col("all_tokens") - to_tokens).alias("tokens_longer"),
        (to_tokens + longer * F.col("n_tokens")).alias("truncated_total"),
    )


def truncated_totals(table: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit``, ``truncated_total``: tokens left if documents are cut at any limit,
    from a suffix table: the greatest length up to the limit tells how many tokens
    shorter documents have and how many documents are longer."""
    n = table.agg(F.max("docs_to").alias("n"))  # one row
    asked = limits.select(F.col("limit").cast("long").alias("at"), F.lit(True).alias("asked"), F.lit(None).cast("long").alias("tokens_to"), F.lit(None).cast("long").alias("docs_longer")).distinct()
    known = table.select(F.col("n_tokens").alias("at"), F.lit(False).alias("asked"), "tokens_to", "docs_longer")
    # The last length up to a limit: within its bucket of lengths, else the last of an earlier one.
    both = known.unionByName(asked).withColumn("bucket", F.floor(F.col("at") / F.lit(SPREAD)))
    found = F.when(~F.col("asked"), F.struct("tokens_to", "docs_longer"))
    inside = Window.partitionBy("bucket").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy("bucket").agg(F.max_by(found, F.when(~F.col("asked"), F.col("at"))).alias("end"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for SPREAD lengths
    carried = ends.select("bucket", F.last("end", ignorenulls=True).over(before).alias("earlier"))
    near = both.withColumn("own", F.last(found, ignorenulls=True).over(inside)).filter("asked").join(carried, "bucket")
    at = F.coalesce("own", "earlier")
    total = F.coalesce(at["tokens_to"] + at["docs_longer"] * F.col("at"), F.col("n") * F.col("at"), F.lit(0))
    return near.crossJoin(F.broadcast(n)).select(F.col("at").alias("limit"), total.alias("truncated_total"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """``share``, ``n_tokens``: the least length that this share of documents do not
    exceed. An empty table gives no rows."""
    wanted = F.explode(F.array(*map(F.lit, shares)))
    n = table.agg(F.max("docs_to").alias("n"))
    return (
        table.crossJoin(F.broadcast(n))
        .select("n_tokens", "docs_to", "n", wanted.alias("share"))
        .filter(F.col("docs_to") >= F.col("share") * F.col("n"))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
