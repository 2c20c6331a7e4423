"""Sharding along a Hilbert curve: quantise metadata, sort by curve index, cut runs of equal row counts.

Rows near in (language, source, size) are near on the curve, so each shard covers a small box of all three dimensions and a
reader prunes shards by the ranges in manifest(). A dimension's coordinate is the share of rows whose value comes before its
own, so neighbours in a range are neighbours in order, and half of the rows lie in each half of the curve's cube. The global rank comes from a range sort and one count a partition, so no
key, however frequent, meets in one task: the sort key ends in crc and doc_id, which split a hot cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

SHARDS, BITS = 24, 8


def _flip(dims: Column, i: int, q: int) -> Column:
    """One step of the axes-to-transpose walk: dimension i at bit q, dims being an array of whole numbers."""
    first, own, low = F.get(dims, 0), F.get(dims, i), F.lit(q - 1).cast("long")
    swap = first.bitwiseXOR(own).bitwiseAND(low)
    flip = own.bitwiseAND(F.lit(q).cast("long")) != 0
    rest = lambda v, j: F.when(~flip & (j == i), v.bitwiseXOR(swap)).otherwise(v)
    head = F.when(flip, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap) if i else first)
    return F.transform(dims, lambda v, j: F.when(j == 0, head).otherwise(rest(v, j)))


def hilbert_index(dims: list[Column], bits: int = BITS) -> Column:
    """The position on a Hilbert curve of the point dims, whole numbers of so many bits each."""
    n = len(dims)
    step = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)
    point = F.array(*[d.cast("long") for d in dims])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            point = step(point, lambda p: _flip(p, i, q))
    for i in range(1, n):
        point = step(point, lambda p: F.transform(p, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(p, i - 1))).otherwise(v)))
    zero = F.lit(0).cast("long")
    turned = lambda p: reduce(lambda a, b: a.bitwiseXOR(b), [F.when(F.get(p, n - 1).bitwiseAND(F.lit(1 << b).cast("long")) != 0, F.lit((1 << b) - 1).cast("long")).otherwise(zero) for b in range(bits - 1, 0, -1)], zero)
    point = step(point, lambda p: F.transform(p, lambda v: v.bitwiseXOR(turned(p))))
    bit = lambda p, i, b: F.shiftleft(F.shiftright(F.get(p, i), b).bitwiseAND(F.lit(1).cast("long")), b * n + n - 1 - i)
    return step(point, lambda p: reduce(lambda a, b: a.bitwiseOR(b), [bit(p, i, b) for b in range(bits) for i in range(n)]))


def _eighths(size: Column) -> Column:
    """Sizes by eighths of a power of two."""
    return F.floor(F.log2(size.cast("double")) * 8).cast("int")


def coordinates(rows: DataFrame, values: list[str], bits: int = BITS) -> list[DataFrame]:
    """For each column of rows a table (value, code): whole numbers of so many bits that keep the values' order.

    The code is the share of rows before the value. Counting is one pass that combines before its shuffle; the running sum
    meets a row for each distinct value. Written, so that their size decides whether they are sent to the executors.
    """
    cells = materialize(rows.groupBy(*values).agg(F.count("*").alias("_n")), "cells")
    tables = []
    for v in values:
        by = cells.groupBy(v).agg(F.sum("_n").alias("_n"))
        w = Window.orderBy(F.col(v).asc_nulls_first())
        before, every = F.sum("_n").over(w) - F.col("_n"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        tables.append(materialize(by.select(F.col(v).alias("_value"), before.alias("_before"), every.alias("_every")).select("_value", F.expr(f"cast(_before * {1 << bits} div _every as int)").alias(f"_code_{v}")), "codes"))
    return tables


def shard(docs: DataFrame, shards: int = SHARDS, carry: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs(doc_id, text, lang, source).

    The law is rows: shard counts differ by at most one, and slots run from 0 without a gap. size is the text's UTF-8
    bytes plus 8; null text has no bytes and the crc of none, 0. carry: with the row as _row. Rows that agree in curve
    index, crc and doc_id are interchangeable; null lang, source or doc_id sorts like an empty or smallest one. An empty
    table gives no rows; fewer rows than shards leave shards empty.
    """
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("_row")] if carry else []
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(*row, F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("_lang"), F.col("source").cast("string").alias("_source"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    sized = sized.withColumn("_size", _eighths(F.col("size")))
    keep, dims = [*["_row"][: len(row)], "doc_id", "size", "text_crc32"], ["_lang", "_source", "_size"]
    placed = sized
    for d, codes in zip(dims, coordinates(sized, dims), strict=True):
        placed = placed.join(codes, placed[d].eqNullSafe(codes["_value"])).drop("_value")
    placed = placed.select(*keep, hilbert_index([F.col(f"_code_{d}") for d in dims]).alias("curve"))
    order = ["curve", "text_crc32", "doc_id"]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.select(*keep, "curve", F.monotonically_increasing_id().alias("_at")), "curve")
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_part")
    counts = counts.select("_part", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    counts = materialize(counts, "counts")  # a row a partition: by its size Spark knows not to shuffle the rows again
    ranked = ranged.withColumn("_part", part).join(counts, "_part").withColumn("_rank", F.col("_before") + within)
    ranked = ranked.withColumn("shard", F.expr(f"cast(_rank * {shards} div _all as int)"))
    slot = F.expr(f"_rank - (shard * _all + {shards - 1}) div {shards}").cast("long")
    return ranked.select(*keep, F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs with its columns and shard, slot (which replace columns so named)."""
    columns = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return shard(docs, shards, carry=True).select(*columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> DataFrame:
    """Writes docs as Parquet with a folder a shard, rows in curve order, and returns the manifest for pruning."""
    whole = shard_documents(docs, shards)
    whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return manifest(docs.sparkSession.read.parquet(path))


def manifest(sharded: DataFrame) -> DataFrame:
    """For each shard: rows and the ranges of language, source and size."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    return sharded.groupBy("shard").agg(
        F.count("*").alias("rows"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("lang", "source") for f in (F.min, F.max)], F.min(size).alias("min_bytes"), F.max(size).alias("max_bytes")
    )
