"""Shards against brute force, and how many of them a reader of one source, language or size opens."""

import math
import zlib

from pyspark.sql import functions as F
from tessera.llm import sharding

DATA = "/root/testdata/sf0.01"


def test_readers_open_few_shards(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sharding.shard_documents(docs).select("shard", "lang", "source").collect()
    for column in ("source", "lang"):
        held, ranges = {}, {}
        for r in rows:
            held.setdefault(r[column], set()).add(r["shard"])
            ranges.setdefault(r["shard"], set()).add(r[column])
        opened = {v: sum(min(x) <= v <= max(x) for x in ranges.values()) for v in held}
        assert sum(opened.values()) <= 1.3 * sum(len(x) for x in held.values()), (column, opened)


def test_shards_are_runs_of_the_curve(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(400).cache()
    rows = {r["doc_id"]: r for r in docs.collect()}
    size = {i: len(r["text"].encode()) + 8 for i, r in rows.items()}
    eighth = {i: int(math.log2(s) * 8) for i, s in size.items()}
    code = lambda value: {v: 256 * sum(x < v for x in value.values()) // len(value) for v in set(value.values())}
    lang, source = ({i: r[c] for i, r in rows.items()} for c in ("lang", "source"))
    codes = [code(lang), code(source), code(eighth)]
    points = {i: (codes[0][lang[i]], codes[1][source[i]], codes[2][eighth[i]]) for i in rows}
    got = {r["doc_id"]: r for r in sharding.shard(docs, 7).collect()}
    index = {r["i"]: r["h"] for r in spark.createDataFrame([(i, *p) for i, p in points.items()], "i long, x long, y long, z long").select("i", sharding.hilbert_index([F.col(c) for c in "xyz"]).alias("h")).collect()}
    order = sorted(rows, key=lambda i: (index[i], zlib.crc32(rows[i]["text"].encode()), i))
    assert [got[i]["shard"] for i in order] == [k * 7 // len(order) for k in range(len(order))]


def test_nulls_ties_and_clashing_columns(spark):
    schema = "doc_id long, text string, lang string, source string, size string, _code__lang int, shard string"
    rows = [(None, None, None, None, "s", 1, "q"), (1, "", "en", "a", None, None, None), (1, "", "en", "a", None, None, None), (2, "x" * 300_000, None, "b", "t", 2, "r")]
    docs = spark.createDataFrame(rows, schema)
    got = sharding.shard(docs, 3).collect()
    assert sorted(r["size"] for r in got) == [8, 8, 8, 300_008] and sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert sharding.shard_documents(docs, 3).columns == ["doc_id", "text", "lang", "source", "size", "_code__lang", "shard", "slot"]
    assert sharding.shard(docs.limit(0), 3).count() == 0
