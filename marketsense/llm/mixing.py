"""Mixing sources to target weights, by distributed prefix sums over hash-random keys.

Every document gets a hash-random key.  Within a source the keys are sorted: equal
ranges of the (uniform) key are buckets of about ``ROWS`` documents, whatever the
size of the source, and a running sum inside buckets, over buckets in groups of
1,024, and over the groups gives each document's first word in the order of its
source.  The source's budget of words cuts that order at its exact place; what a
source lacks is repeated in further epochs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketsense.llm.common import word_count
from marketsense.session import stage

ROWS = 64
KEY_BITS = 60


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Target of each source: one row per source (source, size, n), sources in code point order, null last.

    Weights go round the sources; ``share`` times all sizes are dealt by weight, no
    source gets over ``most`` times its size, and what is over goes to the others by
    weight.  The level that fills all caps is found by one pass over the sources in
    order of cap over weight.  The table has a row per source, never per document.
    """
    listed = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sizes.withColumn("ordinal", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.get(listed, F.col("ordinal") % len(weights)).cast("long")).withColumn("cap", F.lit(float(most)) * F.col("size"))
    everything = Window.partitionBy(F.lit(0))
    filling = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "ordinal").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(share)) * F.sum("size").over(everything) - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filling), F.lit(0))
    )
    ranked = ranked.withColumn("full", F.col("cap") / F.col("weight") <= level)
    left = F.lit(float(share)) * F.sum("size").over(everything) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * (left / open_weight))
    q = F.floor(F.col("n") / ROWS)
    bits = F.when(q > 0, F.length(F.bin(q))).otherwise(0)
    return ranked.select("source", "ordinal", F.col("size").alias("source_size"), target.alias("target"), F.least(bits, F.lit(KEY_BITS)).cast("int").alias("bits"))


def document_key(doc_id: Column, text: Column) -> Column:
    """The hash-random number that orders the documents of a source; a null id is keyed by its text."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("-"), text), F.lit(""))
    return F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """How many words of each document the mix takes.

    Returns a row per row of ``docs``: doc_id, source, size, source_size, target, start
    (words before it in the order of its source), taken, key, epochs and rest (whole turns of
    its source, and words of the last turn).  A document inside the budget
    is taken whole in each epoch; the one at the cut gives its first words only, so a
    source gives exactly the whole part of its target.

    Null texts have size 0 and give nothing.  A null source is a source.  A null id is
    keyed by its text.  Repeated rows are rows of their own (the order among equal rows
    does not show).  A source without words has target 0.  An empty table gives none.
    """
    key = document_key(F.col(id_col), F.col(text_col))
    sized = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), key.alias("key")), "mix-sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, share, most)
    keyed = sized.alias("d").join(sources.alias("s"), F.expr("d.source <=> s.source")).selectExpr(
        "d.doc_id", "d.source", "d.size", "d.key", "s.ordinal", "s.source_size", "s.target", f"shiftright(d.key, {KEY_BITS} - s.bits) as bucket"
    )
    # Running sums at three levels: documents in a bucket, buckets in a group, groups in a source.
    inside = Window.partitionBy("ordinal", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    buckets = keyed.groupBy("ordinal", "bucket").agg(F.sum("size").alias("words")).withColumn("tier", F.shiftright("bucket", 10))
    tiers = buckets.groupBy("ordinal", "tier").agg(F.sum("words").alias("words"))
    over_tiers = Window.partitionBy("ordinal").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    over_buckets = Window.partitionBy("ordinal", "tier").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tiers = tiers.select("ordinal", "tier", F.coalesce(F.sum("words").over(over_tiers), F.lit(0)).alias("tier_start"))
    buckets = buckets.withColumn("bucket_start", F.coalesce(F.sum("words").over(over_buckets), F.lit(0)))
    offsets = buckets.join(tiers, ["ordinal", "tier"]).select("ordinal", "bucket", (F.col("bucket_start") + F.col("tier_start")).alias("offset"))
    start = F.col("inside") + F.col("offset")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    return placed.join(offsets, ["ordinal", "bucket"]).select(
        "doc_id", "source", "size", "source_size", "target", start.cast("long").alias("start"), taken.cast("long").alias("taken"), "key",
        epochs.cast("int").alias("epochs"), rest.cast("long").alias("rest"),
    )


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of a mix: each as often as it was taken whole (the one at a cut: if at least half of it was).

    ``mixed`` is ``mix_sources`` of the same rows.  The order inside a source is that of
    key, id and size, so one row per source (its turns and the place of its cut) tells every
    document how often it comes: texts are not moved.  Rows with equal key, id and size are
    taken alike.  Columns are those of ``docs``; documents of size 0 go.
    """
    place = F.struct("key", "doc_id", "size")
    ending = (F.col("rest") > 0) & (F.col("start") < F.col("rest")) & (F.col("start") + F.col("size") >= F.col("rest"))
    half = 2 * (F.col("rest") - F.col("start")) >= F.col("size")
    cuts = mixed.groupBy(F.col("source").alias("_source")).agg(
        F.max("epochs").alias("_epochs"), F.min(F.when(ending, place)).alias("_cut"), F.min_by(half, F.when(ending, place)).alias("_half")
    )
    held = docs.withColumns({"_size": word_count(F.col(text_col)), "_key": document_key(F.col(id_col), F.col(text_col))})
    own = F.struct(F.col("_key").alias("key"), F.col(id_col).alias("doc_id"), F.col("_size").alias("size"))
    last = F.when(own < F.col("_cut"), 1).when(own == F.col("_cut"), F.col("_half").cast("int")).otherwise(0)
    copies = F.when(F.col("_size") > 0, F.col("_epochs") + F.coalesce(last, F.lit(0))).otherwise(0)
    joined = held.join(cuts, F.col(source_col).eqNullSafe(F.col("_source"))).withColumn("_copies", copies).filter("_copies > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
