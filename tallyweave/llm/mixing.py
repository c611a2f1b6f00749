"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm._shared import Scratch, hex_order, join_copies, ranked_sums, row_marks, running_sums, word_count

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all sizes, and how often a document may be used.
SHARE, EPOCHS = 1.5, 2
#: Equal steps of virtual time that the queue is range-sorted by.
STEPS = 4096
#: Steps of virtual time after 1, for each doubling of it.
LATE_STEPS = 256


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source``, ``source_docs``, ``source_size``, ``target`` from one row (source, size)
    for each document: the weights go to the sources by code point, null last, and repeat.
    The budget is ``share`` of all sizes. A target stops at ``epochs`` times its source's
    size; what it can't use goes to the others by weight, until none is above.

    Sources are ordered by ranges, so their number is not bounded by one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"), F.lit(1).alias("one"))
    name = [F.isnull("source"), F.col("source")]
    numbered = ranked_sums(per, name, {"one": "rank"}, scratch)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    ranked = numbered.select("source", "source_docs", "source_size", weight.alias("weight"), (F.col("source_size") * epochs).alias("most"))
    # Sources fill up in the order of most / weight. With those before one full, the
    # rest share what is left; the first share that the next can take, which is
    # the greatest of those that fit, is the level.
    filled = ranked_sums(ranked, [F.col("most") / F.col("weight"), *name], {"most": "most_before", "weight": "weight_before"}, scratch)
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    left = F.col("all_size") * F.lit(float(share)) - F.col("most_before")
    leveled = filled.crossJoin(F.broadcast(whole)).withColumn("level", left / (F.col("all_weight") - F.col("weight_before")))
    top = leveled.agg(F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).alias("top"))  # one row
    target = F.least(F.col("most").cast("double"), F.coalesce("top", F.lit(float("inf"))) * F.col("weight"))
    return ranked.crossJoin(F.broadcast(top)).select("source", "source_docs", "source_size", target.alias("target"))


#: Tables of sources up to this many rows are broadcast, larger ones in part.
SOURCES = 100_000


def _queued(docs: DataFrame, size: Column, scratch: Scratch, ties: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """Each document with ``before``, the words of its source that are queued ahead
    of it in the shuffled order, and its source's size and target; and the targets.
    Documents of one id queue by ``ties``, or else by size."""
    sizes = scratch.hold(docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row"), *ties))
    targets = scratch.keep(source_targets(sizes, scratch), "targets")
    name, unnamed = F.coalesce("source", F.lit("")).alias("source"), F.isnull("source").alias("unnamed")
    order = hex_order(F.col("doc_id"))
    tied = sizes.columns[4:]
    rows = sizes.select("row", "doc_id", "size", *tied, name, unnamed, order.alias("order"), F.substring(order, 1, 3).alias("bucket"))
    queued = running_sums(rows, ["source", "unnamed"], "bucket", ["order", "doc_id", *(tied or ["size"]), "row"], {"size": "before"})
    if tied:  # rows equal in all columns follow one another: which of them this is, and how many there are
        equal = Window.partitionBy("source", "unnamed", "bucket", "order", "doc_id", *tied)
        queued = queued.withColumn("nth", F.row_number().over(equal.orderBy("row"))).withColumn("there", F.count("*").over(equal))
    named = targets.select(name, unnamed, "source_docs", "source_size", "target")
    return join_copies(queued, named, ["source", "unnamed"], "source_docs", scratch, SOURCES), targets


def fair_mix(docs: DataFrame, spark: SparkSession, size: Column | None = None) -> DataFrame:
    """The mix: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` (words,
    repeats counted) and ``first_end`` (words of the mix up to the end of the
    document's first use; null if unused), one row for each document.

    A source's documents queue in the order of the md5 of their ids, ``EPOCHS``
    times over. A use's virtual finish time is the words of its source up to its end
    divided by the target. Uses are range-sorted by it and cut where the mix has as
    many words as all targets together, which is virtual time 1; a use in service
    then is taken in part, so each source gets its target but for a fraction of a word.

    Sorting is by ``STEPS`` equal steps of virtual time, over which fair queueing
    itself spreads the words evenly. A null text has size 0; null sources are one
    source. Repeated rows queue as documents of their own. Other columns are ignored.
    """
    scratch = Scratch(spark, "mix")
    queued, targets = _queued(docs, word_count(F.col("text")) if size is None else size, scratch)
    start = F.col("before") + F.col("epoch") * F.col("source_size")
    served = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - start))
    uses = scratch.hold(
        queued.withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
        .withColumn("served", served)
        .withColumn("finish", F.when(F.col("served") > 0, (start + F.col("served")) / F.col("target")))
    )
    step = F.when(F.col("served") > 0, F.least((F.col("finish") * STEPS).cast("int"), F.lit(STEPS - 1))).otherwise(
        F.lit(STEPS) + F.pmod(F.xxhash64("row"), F.lit(STEPS)).cast("int")  # unused: no order among them
    )
    timed = uses.select("*", F.lit(0).alias("mix"), step.alias("step")).drop("bucket")
    order = ["finish", "source", "unnamed", "epoch", "order", "doc_id", "row"]
    placed = running_sums(timed, ["mix"], "step", order, {"served": "ahead"})
    whole = targets.agg(F.sum(F.floor("target")).alias("mix_size"))  # one row; sources can give all of it
    budget = placed.crossJoin(F.broadcast(whole))
    got = F.greatest(F.lit(0), F.least(F.col("served"), F.col("mix_size") - F.col("ahead")))
    return (
        budget.withColumn("got", got)
        .groupBy("row")
        .agg(
            *(F.min(c).alias(c) for c in ("doc_id", "size", "source_size", "target")),
            F.sum("got").alias("taken"),
            F.min(F.when(F.col("got") > 0, F.col("ahead") + F.col("got"))).alias("first_end"),
        )
        .drop("row")
    )


def mixed_documents(docs: DataFrame, spark: SparkSession, size: Column | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is used, with all their columns.

    The queue is that of ``fair_mix``, but documents are never cut: a use's virtual
    finish time counts the whole document, uses are range-sorted by it, and the one in
    service where the mix reaches all targets together is the last, used whole. So the
    mix exceeds its budget by less than that document, and a source differs from its
    target by what is left or ahead of its documents. Sources without any word give
    each document once. Null texts have size 0, null sources are one source, and an
    empty table gives no rows.

    A source's uses are the first of its queue, so what to use is told by where each
    source's queue is cut, one row for each source, and texts are not shuffled. Documents
    of one id, or of none, queue by the hash of the whole row. Rows that are equal in all
    columns can't be told apart by that, so the cut also says how many of them are used.

    Steps of virtual time are equal up to 1; later ones, which only large documents of
    small targets leave to be used, grow with it, so there are few of them.
    """
    scratch = Scratch(spark, "mixed")
    marks = row_marks(docs)
    ties = [m.alias(name) for m, name in zip(marks, ("mark1", "mark2"), strict=True)]
    queued, targets = _queued(docs, word_count(F.col("text")) if size is None else size, scratch, ties)
    start = F.col("before") + F.col("epoch") * F.col("source_size")
    finish = F.when(F.col("target") > 0, (start + F.col("size")) / F.col("target")).otherwise(F.col("epoch").cast("double"))
    uses = scratch.hold(
        queued.drop("bucket")
        .withColumn("epoch", F.explode(F.array(*map(F.lit, range(EPOCHS)))))
        .filter("target > 0 OR epoch = 0")
        .withColumn("finish", finish)
    )
    late = F.lit(STEPS) + (F.log2(F.greatest(F.col("finish"), F.lit(1.0))) * LATE_STEPS).cast("int")
    step = F.when(F.col("finish") < 1, (F.col("finish") * STEPS).cast("int")).otherwise(late)
    own = ["order", "doc_id", "mark1", "mark2"]
    order = ["finish", "source", "unnamed", "epoch", *own, "row"]
    placed = running_sums(uses.select("*", F.lit(0).alias("mix"), step.alias("step")), ["mix"], "step", order, {"size": "ahead"})
    whole = targets.agg(F.round(F.sum("target"), 3).alias("budget"))  # one row
    taken = placed.crossJoin(F.broadcast(whole)).filter("ahead < budget OR target = 0")
    # The last use of each source, and how many of the rows that equal it are used by then.
    last = F.max(F.struct("epoch", F.struct(*own).alias("at"), F.col("nth").alias("used"), "there"))
    per_source = taken.groupBy("source", "unnamed").agg(last.alias("last"), F.count("*").alias("docs"))
    cuts = scratch.keep(per_source.select(*(F.col(c).alias(f"_cut_{c}") for c in per_source.columns)), "cuts")
    keyed = docs.select(
        "*",
        F.coalesce("source", F.lit("")).alias("_cut_source"),
        F.isnull("source").alias("_cut_unnamed"),
        F.struct(hex_order(docs["doc_id"]).alias("order"), docs["doc_id"].alias("doc_id"), *ties).alias("_cut_own"),
    )
    met = join_copies(keyed, cuts, ["_cut_source", "_cut_unnamed"], "_cut_docs", scratch, SOURCES).filter("_cut_last IS NOT NULL")
    mine, cut = F.col("_cut_own"), F.col("_cut_last")
    some = cut["used"] < cut["there"]  # of the equal rows at the cut only some are used once more
    more = F.when((mine < cut["at"]) | (~(mine > cut["at"]) & ~some), 1).otherwise(0)

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.withColumn("_cut_use", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)

    out = repeated(met, cut["epoch"] + more)
    if cuts.filter("_cut_last.used < _cut_last.there").isEmpty():
        return out
    at_cut = met.filter(some & ~(mine < cut["at"]) & ~(mine > cut["at"])).withColumn("_cut_used", cut["used"].cast("int"))
    one_each = at_cut.drop("_cut_last").dropDuplicates(["_cut_source", "_cut_unnamed"])
    return out.unionByName(repeated(one_each, F.col("_cut_used")))
