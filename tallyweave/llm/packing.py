"""Packing documents into batches of like length.

Bucket boundaries are chosen by dynamic programming over the histogram of all
lengths, so that padding every sequence to its bucket's boundary costs the fewest
tokens; batches of a fixed token budget then form inside each bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm._shared import Scratch, running_sums, word_count

#: Longest sequence: longer documents become several. It bounds the histogram.
CONTEXT = 2048
#: Buckets, and tokens of a batch, padding included.
BUCKETS, BUDGET = 8, 32_768


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of the buckets with the least padding, ascending. ``lengths``
    are distinct and ascending. Of equal solutions the one whose last bucket, then
    whose last but one and so on, starts lowest."""
    m = len(lengths)
    if not m:
        return []
    docs = np.concatenate(([0], np.cumsum(counts)))
    tokens = np.concatenate(([0], np.cumsum(counts * lengths)))
    k = min(buckets, m)
    cost = lengths * docs[1:] - tokens[1:]  # of the first j lengths in one bucket
    came = np.zeros((k, m), np.int64)
    for n in range(1, k):
        new = np.full(m, np.iinfo(np.int64).max)
        for j in range(n, m):
            start = np.arange(n, j + 1)  # the bucket holds lengths start..j
            pad = cost[start - 1] + lengths[j] * (docs[j + 1] - docs[start]) - (tokens[j + 1] - tokens[start])
            best = int(pad.argmin())
            new[j], came[n, j] = pad[best], start[best]
        cost = new
    out, j = [], m - 1
    for n in range(k - 1, -1, -1):
        out.append(int(lengths[j]))
        j = int(came[n, j]) - 1
    return out[::-1]


def pieces(docs: DataFrame, length: Column | None = None, context: int = CONTEXT) -> DataFrame:
    """``doc_id``, ``piece``, ``length``: documents as sequences of at most
    ``context`` tokens. One without tokens is a single piece of length 0."""
    sized = docs.select("doc_id", (word_count(F.col("text")) if length is None else length).cast("long").alias("tokens"))
    n = F.greatest(F.lit(1), F.ceil(F.col("tokens") / context)).cast("int")
    return sized.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece")).select(
        "doc_id", "piece", F.least(F.lit(context), F.col("tokens") - F.col("piece").cast("long") * context).alias("length")
    )


def pack(
    docs: DataFrame,
    spark: SparkSession,
    length: Column | None = None,
    context: int = CONTEXT,
    buckets: int = BUCKETS,
    budget: int = BUDGET,
) -> DataFrame:
    """One row for each piece: ``doc_id``, ``piece``, ``length``, ``bucket`` (from 1),
    ``boundary`` (its padded length), ``batch`` (from 0, in its bucket).

    Pieces of a bucket come in the order of the md5 of their id and number; a batch
    takes as many as its budget holds at the padded length, one at least. Pieces of
    length 0 have nothing to pack: bucket, boundary and batch are null. The driver
    gets the histogram, at most ``context`` rows. Null texts count as empty; repeated
    rows are packed as often as they come; an empty table gives no rows.
    """
    cut = Scratch(spark, "pack").hold(pieces(docs, length, context))
    histogram = cut.filter("length > 0").groupBy("length").agg(F.count("*").alias("n")).orderBy("length").toPandas()
    tops = boundaries(histogram["length"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), buckets)
    boundary = F.element_at(F.filter(F.array(*(F.lit(x).cast("long") for x in tops or [0])), lambda b: b >= F.col("length")), 1)
    number = F.array_position(F.array(*(F.lit(x).cast("long") for x in tops or [0])), F.col("boundary")).cast("int")
    order = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")).cast("binary"))
    rows = (
        cut.filter("length > 0")
        .withColumn("boundary", boundary)
        .withColumn("bucket", number)
        .withColumn("order", order)
        .withColumn("part", F.substring("order", 1, 3))
        .withColumn("one", F.lit(1).cast("long"))
    )
    ranked = running_sums(rows, ["bucket"], "part", ["order", "doc_id", "piece", "length"], {"one": "rank"})
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("boundary")))
    packed = ranked.select("doc_id", "piece", "length", "bucket", "boundary", F.floor(F.col("rank") / per_batch).alias("batch"))
    nothing = cut.filter("length = 0").select(
        "doc_id", "piece", "length", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("long").alias("boundary"), F.lit(None).cast("long").alias("batch")
    )
    return packed.unionByName(nothing)
