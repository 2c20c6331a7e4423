"""Mixing sources to target weights: hash-random keys, a range sort within sources, distributed prefix sums, exact cuts.

The word total before each document comes from sums by (source, range partition) plus a running sum inside the partition,
so a source with a third of all rows is spread over as many tasks as its rows fill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2


def size_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows with the source as a key that sorts by code point with null last, the size, and a random but repeatable key."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("z"))
    random = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    return docs.select(*more, F.col("doc_id").cast("long"), source.alias("_source"), size_of(F.col("text")).alias("size"), random.alias("_key"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(_source, source_size, target): weights in turn by source order; no target above cap times its source's size.

    Sources in order of their cap per weight: the first one whose cap holds the even share of what is left ends the capped
    ones. One row a source takes part.
    """
    by = sizes.groupBy("_source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy("_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    by = by.select("_source", "source_size", weight.alias("w"), (F.col("source_size") * cap).cast("double").alias("most"))
    w = Window.orderBy(F.col("most") / F.col("w"), "_source")
    upto, every = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = by.select(
        "*",
        F.row_number().over(w).alias("rank"),
        (F.sum(F.col("source_size").cast("double")).over(every) * share - (F.sum("most").over(upto) - F.col("most"))).alias("left_over"),
        (F.sum("w").over(every) - (F.sum("w").over(upto) - F.col("w"))).alias("left_weight"),
    )
    fits = F.col("left_over") * F.col("w") / F.col("left_weight") <= F.col("most")
    level = F.min(F.when(fits, F.struct("rank", "left_over", "left_weight"))).over(every)
    ranked = ranked.select("*", level.alias("level"))
    target = F.when(F.col("rank") < F.coalesce(F.col("level.rank"), F.lit(2**31 - 1)), F.col("most")).otherwise(F.col("level.left_over") * F.col("w") / F.col("level.left_weight"))
    return ranked.select("_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the cut's parts, for every row of docs(doc_id, text, source).

    A source is taken whole as often as its target holds it (epochs), then in the order of the random keys until the exact
    budget: the document on the cut is taken in part. Null text has size 0 and none of it is taken; null source is a
    source, the last; rows that agree in doc_id and size are interchangeable; a source of only empty documents has target
    0. Other columns are not read; an empty table gives no rows.
    """
    sizes = materialize(_keyed(docs), "sizes")
    plan = materialize(targets(sizes, weights, share, cap), "targets")
    order = ["_source", "_key", "doc_id", "size"]
    ranged = sizes.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select(*order, F.monotonically_increasing_id().alias("_at")), "order").withColumn("_part", F.shiftright("_at", 33))
    sums = ranged.groupBy("_source", "_part").agg(F.sum("size").alias("_sum"))
    sums = sums.select("_source", "_part", (F.sum("_sum").over(Window.partitionBy("_source").orderBy("_part")) - F.col("_sum")).alias("_before"))
    local = Window.partitionBy("_source", "_part").orderBy("_at")
    summed = ranged.select(*order, "_part", (F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("_local"))
    whole = summed.join(sums, ["_source", "_part"]).join(plan, "_source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    whole = whole.withColumn("epochs", epochs)
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before") - F.col("_local"))).cast("long")
    return whole.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "epochs", part.alias("part"), "_source", "_key")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs as often as the mix takes them, whole documents: the one on the cut if at least half is taken.

    A source's cut is one key, so the rows only meet a table of one row a source.
    """
    id_or_least = F.coalesce("doc_id", F.lit(-(2**63)))
    mixed = mix(docs)
    key = F.struct("_key", id_or_least.alias("i"), "size")
    cut = F.max(F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), key))
    cuts = materialize(mixed.groupBy("_source").agg(F.max("epochs").alias("_epochs"), cut.alias("_cut")), "cuts")
    rows = _keyed(docs, F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    copies = F.col("_epochs") + F.when(F.col("_cut").isNotNull() & (key <= F.col("_cut")), 1).otherwise(0)
    picked = rows.join(cuts, "_source").select("_row", F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("n"))
    return picked.where("n > 0").select("_row", F.explode(F.expr("sequence(1, n)"))).select("_row.*")
