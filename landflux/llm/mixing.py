"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: sources share the total of all sizes by weight; a target stops at a
multiple of its source's size, and what is cut off is shared by weight among
the others until none is above. A target is complete epochs of the source plus
a fraction. Every document is taken once for each complete epoch; for the
fraction, documents are drawn without repeats: each has an exponential key with
its quality weight as rate, the keys are sorted within the source, and documents
are taken in that order while the running size stays within the budget, the one
that crosses it if half of it or more lies within.

The keys come from a hash of the document's id and text, so reruns and retried
tasks agree. A source's order is kept in slices of its key range: sizes are
summed by slice, the running totals of slices are added up, and only the keys of
the slice in which the budget ends are sorted. All other documents are taken or
not by their slice alone, so no text is shuffled and a source that holds a third
of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landflux.llm.store import Store, other_columns, sets_aside

MOST_EPOCHS = 3
SLICES = 1024  # equal parts of a source's key range on a log scale, each sorted on its own
WEIGHTS = (1, 2, 3)  # repeating, by source in code point order
SPACES = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "w")
    return F.length(F.regexp_replace(trimmed, "[\\x20\\x09-\\x0D]+", "")).cast("bigint")


def quality_weight(text: Column) -> Column:
    """Rate of a document's key: from 0.25, up to 1 for a text of nothing but letters and spaces."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(F.regexp_replace(text, "[A-Za-z\\x20\\x{C0}-\\x{24F}]+", ""))
    return 1.0 - 0.75 * odd / F.greatest(F.length(text), F.lit(1))


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, exclusive, from a digest of the parts."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def targets(sources: DataFrame, most: int = MOST_EPOCHS) -> DataFrame:
    """``sources`` (source, source_size, weight and any more columns) with their target.

    Sources are filled in order of size per weight: the one that reaches its cap
    first keeps it, and the rest share what is left, so the level is found from
    running sums in one pass over the sources, one row each.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    # a source with weight w is capped at level L (budget per weight) if most * size < w * L
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    open_weight = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (total - capped) / open_weight
    ranked = sources.withColumn("level", level.cast("double"))
    free = ranked.withColumn("is_free", F.col("source_size").cast("double") * most >= F.col("level") * F.col("weight"))
    lowest = F.min(F.when(F.col("is_free"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(
        Window.partitionBy()
    )
    cap = F.col("source_size").cast("double") * most
    share = F.coalesce(F.least(cap, lowest["level"] * F.col("weight")), cap)
    return free.select(*sources.columns, share.alias("target"))


@sets_aside("_key", "_slice", "_source", "_row", "_cut", "_cut_slice")
def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target, epochs, sampled and taken.

    ``docs`` needs doc_id, text and source; columns named like a result are
    replaced. A null text has size 0; a null source is a source of its own, last
    in order. Documents of size 0 are taken once for each epoch and never
    change a total. Rows with equal id and text have equal keys; ties are broken
    by size, so that it does not matter which of them is taken. An empty table
    stays empty.
    """
    results = ["size", "source_size", "target", "epochs", "sampled", "taken"]
    return take(measure(docs.select(*other_columns(docs, results))))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with size and the sampling key; the text is not needed any more afterwards."""
    key = -F.log(uniform(F.col("doc_id"), F.col("text"))) / quality_weight(F.col("text"))
    return docs.withColumns({"size": words(F.col("text")), "_key": key})


def take(measured: DataFrame) -> DataFrame:
    """What ``mix`` gives, for measured documents.

    The rows are stored once and stay where they are: only sums by slice, and the
    keys of the one slice of each source in which its budget ends, are shuffled.
    Every row is then judged by its own key against that of the last one taken.
    """
    store = Store(measured.sparkSession, "mixing")
    own = [c for c in measured.columns if c not in ("size", "_key")]
    slot = F.least(F.lit(SLICES - 1), F.floor((1.0 - F.exp(-F.col("_key"))) * SLICES)).cast("int")
    # a text for every source, null too, so that plain equality serves all joins
    named = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    # the row's number orders rows with equal id and text, of which the budget may take some
    numbered = measured.withColumns({"_slice": slot, "_source": named, "_row": F.monotonically_increasing_id()})
    sized = store.keep(numbered, compression="zstd")
    slices = store.keep(
        sized.groupBy("_source", "_slice").agg(F.sum("size").alias("slice_size"), F.first("source").alias("source"))
    )
    sources = slices.groupBy("_source").agg(F.sum("slice_size").alias("source_size"), F.first("source").alias("source"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    goal = targets(sources.withColumn("weight", weight))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", F.least(F.lit(MOST_EPOCHS), epochs).cast("bigint"))
    goal = goal.withColumn("_budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = store.keep(goal.select("_source", "source_size", F.col("target").cast("double").alias("target"), "epochs", "_budget"))
    upto = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("_before", F.coalesce(F.sum("slice_size").over(upto), F.lit(0)))
    ends_here = (F.col("_before") <= F.col("_budget")) & (F.col("_budget") < F.col("_before") + F.col("slice_size"))
    last = offsets.join(goal, "_source").filter(ends_here).select("_source", "_slice", "_before", "_budget")
    order = ["_key", "doc_id", "size", "_row"]
    within = Window.partitionBy("_source", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ending = sized.select("_source", "_slice", *order).join(last, ["_source", "_slice"])
    ending = ending.withColumn("_inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    fits = (F.col("size") > 0) & (F.col("_before") + F.col("_inner") + F.col("size") / 2 <= F.col("_budget"))
    cuts = ending.groupBy("_source").agg(
        F.first("_slice").alias("_cut_slice"), F.max(F.when(fits, F.struct(*order))).alias("_cut")
    )
    goal = store.keep(goal.join(cuts, "_source", "left").drop("_budget"))
    clash = [c for c in own if c in ("source_size", "target", "epochs")]
    placed = sized.drop(*clash).join(goal, "_source")
    early = F.col("_slice") < F.col("_cut_slice")
    taken_in_slice = (F.col("_slice") == F.col("_cut_slice")) & (F.struct(*order) <= F.col("_cut"))
    sampled = F.coalesce((F.col("size") > 0) & (early | taken_in_slice), F.lit(False))
    return placed.select(
        *[c for c in own if c not in clash],
        "size",
        "source_size",
        "target",
        "epochs",
        sampled.alias("sampled"),
        ((F.col("epochs") + sampled.cast("int")) * F.col("size")).alias("taken"),
    )
