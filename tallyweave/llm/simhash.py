"""Near-duplicate documents by SimHash.

Fingerprints link when they differ in few bits. Candidate pairs come from an
inverted index on the bytes of a fingerprint at their positions; pairs that share
fewer positional bytes than any link must share are dropped, the rest verified.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm._shared import Scratch, WordFilter, components, join_copies, row_marks

BITS, BYTES = 64, 8
#: Positional bytes that name a posting.
TOGETHER = 4
#: Seed of the shingle hash.
SEED = 42


def simhash(text: str | None, width: int = 3) -> int:
    """Fingerprint of one text, as an unsigned integer: ASCII letters in lower
    case, words split at ASCII white space, shingles of ``width`` words with
    repeats (fewer words: one shingle of them all; none or null: 0), and a bit
    for each that over half of the shingles' hashes have."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (
            digest(line[a:b], SEED)
            for a, b in zip(starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
        ),
        np.uint64,
        last,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, last, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > last, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    """Fingerprint column, as the BIGINT of the same 64 bits."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        found = np.fromiter((simhash(x, width) for x in texts.to_pylist()), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return of(text)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the positions at which two fingerprints hold the same byte."""
    differ = a.bitwiseXOR(b)
    masks = (255 << (8 * i) if i < BYTES - 1 else -(1 << 56) for i in range(BYTES))
    return sum((F.when(differ.bitwiseAND(F.lit(m)) == 0, 1).otherwise(0) for m in masks), F.lit(0))


def _slots(fp: Column) -> list[Column]:
    """Number of each positional byte of a fingerprint: position * 256 + byte."""
    return [F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255)).cast("int") + F.lit(256 * i) for i in range(BYTES)]


def _postings(fps: DataFrame) -> DataFrame:
    """One row, ``counts``: the length of the posting of each of the 8 * 256 positional
    bytes, by its number."""
    slots = fps.select(F.explode(F.array(*_slots(F.col("fp")))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    every = fps.sparkSession.range(256 * BYTES).select(F.col("id").cast("int").alias("slot")).join(F.broadcast(slots), "slot", "left")
    return every.agg(F.sort_array(F.collect_list(F.struct("slot", F.coalesce("n", F.lit(0)).alias("n")))).alias("all")).select(F.col("all.n").alias("counts"))


def _index(fps: DataFrame, distance: int) -> DataFrame:
    """Postings in which a fingerprint is listed, ``mask, bytes, fp``: each ``TOGETHER`` of
    its ``TOGETHER + distance`` rarest positional bytes, as a mask of their bits and these bits.

    A posting of one byte would hold 1/256 of all fingerprints, so it is split by further
    bytes. Bytes are ranked by one order for all, the length of their postings. Two
    fingerprints that share all but ``distance`` of their bytes have the first ``TOGETHER``
    they share among so many first ones of either, so they meet in a posting.
    """
    counted = fps.crossJoin(F.broadcast(_postings(fps)))  # one row of 2,048 numbers
    ranks = F.sort_array(F.array(*(F.get(F.col("counts"), slot) * 2048 + slot for slot in _slots(F.col("fp")))))
    rarest = range(TOGETHER + distance)
    masks = (F.expr(f"shiftleft(255L, cast((ranks[{i}] & 2047) >> 8 AS INT) * 8)").alias(f"m{i}") for i in rarest)
    masked = counted.select("fp", ranks.alias("ranks")).select("fp", *masks)
    each = [reduce(Column.bitwiseOR, (F.col(f"m{i}") for i in some)) for some in combinations(rarest, TOGETHER)]
    listed = masked.select("fp", F.explode(F.array(*each)).alias("mask"))
    return listed.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")


def _masked_links(values: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Links of a long list without pairs: fingerprints that agree outside a mask
    are linked to the smallest of them. Returns a spanning forest (child, parent)."""
    root = np.arange(len(values))
    for mask in masks:
        rest = values & ~mask
        order = np.argsort(rest, kind="stable")
        new = np.concatenate(([True], rest[order][1:] != rest[order][:-1]))
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        pairs = np.stack([root[order[~new]], root[lead[~new]]])
        while True:  # join the two trees of each pair, smaller root first
            pairs = root[pairs]
            pairs = pairs[:, pairs[0] != pairs[1]]
            if not pairs.shape[1]:
                break
            np.minimum.at(root, pairs.max(axis=0), pairs.min(axis=0))
            while (root[root] != root).any():
                root = root[root]
    return np.stack([np.flatnonzero(root != np.arange(len(root))), root[root != np.arange(len(root))]], axis=1)


def _close_pairs(values: np.ndarray, distance: int) -> np.ndarray:
    """All links (a, b) of a short list, as places in it."""
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    return np.argwhere(np.triu(apart <= distance, 1))


def links(fps: DataFrame, scratch: Scratch, distance: int = 2, long_list: int = 64, direct: int = 32) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp``: enough of those at
    ``distance`` bits or fewer (2 at most) to keep what is connected connected.

    The inverted index lists fingerprints by positional bytes (``_index``). Two that meet
    in a posting of up to ``long_list`` entries are a candidate pair; its shared positional
    bytes are tallied, and only pairs that reach the least a link must have, 8 - distance,
    are verified by their bits. A longer posting, such as that of thousands of near copies,
    would give pairs with the square of its length. Its fingerprints are split anew by the
    least that a link must share: each six of the eight positional bytes, so that the tally
    is reached by being listed together. Two bytes are left open, so no list holds more than
    65,536 fingerprints, however many documents are near copies. Lists up to ``direct`` are
    verified pair by pair; in others, fingerprints that agree outside a mask of two of the
    16 open bits (120 masks) are linked, which finds the same components without pairs.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    length = F.count("*").over(Window.partitionBy("mask", "bytes"))
    index = scratch.hold(_index(fps, distance).withColumn("n", length).filter("n > 1"))
    short = index.filter(F.col("n") <= long_list).select("mask", "bytes", "fp")
    a, b = F.col("l.fp"), F.col("r.fp")
    met = (F.col("l.mask") == F.col("r.mask")) & (F.col("l.bytes") == F.col("r.bytes")) & (a < b)
    candidates = short.alias("l").join(short.alias("r"), met & (shared_bytes(a, b) >= BYTES - distance)).select(a.alias("a"), b.alias("b"))
    pairs = candidates.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()
    open_bytes = list(combinations(range(BYTES), 2))
    open_masks = np.array([255 << (8 * i) | 255 << (8 * j) for i, j in open_bytes], np.uint64)
    kept = F.array(
        *(
            F.struct(F.lit(n).alias("open"), F.col("fp").bitwiseAND(F.lit(int(~mask.view(np.int64)))).alias("rest"))
            for n, mask in enumerate(open_masks)
        )
    )
    long = index.filter(F.col("n") > long_list).select("fp").distinct()
    lists = (
        long.select("fp", F.explode(kept).alias("k"))
        .groupBy("k.open", "k.rest")
        .agg(F.collect_list("fp").alias("fps"))
        .filter(F.size("fps") > 1)
        .select("open", "fps")
    )

    def of_lists(batches):
        masks = []
        for i, j in open_bytes:
            bits = [8 * i + k for k in range(8)] + [8 * j + k for k in range(8)]
            masks.append(np.array([sum(1 << k for k in some) for some in combinations(bits, distance)], np.uint64))
        for rows in batches:
            parts = []
            for which, found in zip(rows["open"], rows["fps"], strict=True):
                values = np.sort(np.asarray(found, np.int64)).view(np.uint64)
                near = _close_pairs(values, distance) if len(values) <= direct else _masked_links(values, masks[which])
                parts.append(values[near])
            every = np.concatenate(parts).view(np.int64) if parts else np.zeros((0, 2), np.int64)
            yield pd.DataFrame({"a": every[:, 0], "b": every[:, 1]})

    return pairs.unionByName(lists.mapInPandas(of_lists, "a long, b long"))


def _least_of_component(classes: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """Classes ``fp, least, copies`` with the smallest ``least`` of their component."""
    edges = scratch.keep(links(classes.select("fp"), scratch, distance), "links")
    roots = scratch.keep(components(edges, scratch).withColumnRenamed("node", "fp"), "roots")
    joined = scratch.keep(roots.join(classes, "fp"), "joined")
    tops = joined.groupBy("root").agg(F.min("least").alias("top"), F.count("*").alias("members"))
    moved = join_copies(joined.select("fp", "root"), tops, ["root"], "members", scratch).select("fp", "top")
    return scratch.keep(classes.join(moved, "fp", "left").select("fp", "copies", F.coalesce("top", "least").alias("least")), "final")


def near_duplicates(docs: DataFrame, spark: SparkSession, distance: int = 2, width: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (BIGINT of the 64 bits) and
    ``component_id``, the smallest doc_id reachable over links.

    Null and blank texts have fingerprint 0 and link like any other. A null doc_id
    takes part in links but is never a component_id unless all are null. Repeated
    rows stay repeated. Other columns are ignored. An empty table gives no rows.
    """
    scratch = Scratch(spark, "simhash")
    rows = scratch.hold(docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp")))
    classes = scratch.hold(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    final = _least_of_component(classes, distance, scratch).withColumnRenamed("least", "component_id")
    return join_copies(rows, final, ["fp"], "copies", scratch).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, spark: SparkSession, distance: int = 2, width: int = 3) -> DataFrame:
    """Documents less the near copies: of each component one row stays, with all its
    columns, namely the first by doc_id (nulls last), then by the hash of the whole row.

    Rows are told apart by a hash of all their columns, never by doc_id, so rows of one
    doc_id with unrelated texts all stay. Of rows that are equal in all columns one stays
    at most. Null and blank texts are near copies of each other. An empty table stays empty.

    Texts are not shuffled but for rows that a filter of fixed size takes for one that may
    go: these are joined with the rows to drop, all others stay in their place.
    """
    scratch = Scratch(spark, "simhash-keep")
    marked = docs.select("*", *(m.alias(name) for m, name in zip(row_marks(docs), ("_mark1", "_mark2"), strict=True)))
    rows = scratch.hold(marked.select("doc_id", "_mark1", "_mark2", fingerprint(F.col("text"), width).alias("fp")))
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "_mark1", "_mark2")
    classes = scratch.hold(rows.groupBy("fp").agg(F.min(first).alias("least"), F.count("*").alias("copies")))
    final = _least_of_component(classes, distance, scratch)
    told = join_copies(rows, final, ["fp"], "copies", scratch)
    stays = (F.col("_mark1") == F.col("least._mark1")) & (F.col("_mark2") == F.col("least._mark2"))
    each = told.groupBy("_mark1", "_mark2").agg(F.first(stays).alias("stays"), F.count("*").alias("times"))
    touched = scratch.keep(each.filter("NOT stays OR times > 1"), "touched")
    untouched, others = WordFilter(touched, "_mark1", "_mark2").split(marked)
    gone = touched.filter("NOT stays").select("_mark1", "_mark2")
    single = others.dropDuplicates(["_mark1", "_mark2"]).join(gone, ["_mark1", "_mark2"], "left_anti")
    return untouched.select(*docs.columns).unionByName(single.select(*docs.columns))
