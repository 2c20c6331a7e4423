"""SimHash near-dedup: Golay-code fuzzy hashing of fingerprint segments, join, verify, components.

A fingerprint has 64 bits in four segments of 16. Of two fingerprints at 3 or fewer differing bits, some segment e is equal
in both, and of any two further segments one differs in at most one bit. Padded to 23 bits, a segment lies within 3 bits of
exactly one word of the perfect binary Golay code, so two segments at one bit share a code word that lies within 4 bits of
both. The keys (e, equal segment, g, code word) for g = e+1 and e+2 therefore find every linked pair: eight tables of 28
bits, about 42 keys a fingerprint.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import discard, materialize, settle

SHINGLE, SEED, MAX_BITS = 3, 42, 3
#: Fixed value: the generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the binary Golay code.
GENERATOR = 0b101011100011
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def fingerprint(text: bytes) -> int:
    """SimHash of one text: lower-cased A-Z, 3-word shingles, XXH64 with seed 42, strict majority a bit."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined, digest = b" ".join(words), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    total, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(1)
        prints = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts.cast(pa.large_string())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for every row; null text is an empty text, with fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def code_words() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment, the Golay words (as their 12 message bits) within 4 bits: start offsets and values."""
    if not _tables:
        messages = np.arange(4096, dtype=np.int64)
        words = np.zeros(4096, np.int64)
        for i in range(12):
            words ^= np.where(messages >> i & 1, GENERATOR << i, 0)
        high = np.bitwise_count(words >> 16).astype(np.int64)
        at, found = [], []
        for weight in range(5):
            patterns = np.array([sum(1 << b for b in c) for c in combinations(range(16), weight)], np.int64)
            near = np.flatnonzero(high + weight <= 4)
            at.append(((words[near] & 0xFFFF)[:, None] ^ patterns[None, :]).ravel())
            found.append(np.repeat(near, len(patterns)))
        at, found = np.concatenate(at), np.concatenate(found)
        order = np.lexsort((found, at))
        _tables.append((np.searchsorted(at[order], np.arange(65537)), found[order]))
    return _tables[0]


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (index of fingerprint, key) of the eight tables."""
    offsets, values = code_words()
    parts = [(prints >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.int64) for i in range(4)]
    rows, keys = [], []
    for e in range(4):
        for step in (1, 2):
            part = parts[(e + step) % 4]
            n = offsets[part + 1] - offsets[part]
            row = np.repeat(np.arange(len(prints)), n)
            within = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            rows.append(row)
            keys.append((2 * e + step - 1 << 28) | parts[e][row] << 12 | values[offsets[part][row] + within])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1 << 14):
            prints = batch.column(0).slice(at, 1 << 14).to_numpy()
            rows, keys = keys_of(prints.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[rows])], names=["key", "fp"])


def _near(a: str, b: str):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def linked_prints(prints: DataFrame) -> DataFrame:
    """(node, component) of the distinct fingerprints prints(fp) that have a link.

    Exact without pairs of whole buckets: each bucket links its members to its smallest and largest fingerprint where
    those lie within 3 bits. Only in buckets whose members then still belong to several components are the members
    outside the first one's component compared with the rest, and only across components.

    Tables that grow with the corpus are never broadcast: keyed has 42 rows for each of prints, which Spark takes for one.
    """
    keyed = prints.select("fp").mapInArrow(_keyed, "key long, fp long")
    buckets = materialize(keyed.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = materialize(keyed.join(buckets.where("n > 2").select("key", "lo", "hi").hint("merge"), "key"), "members")
    stars = (
        buckets.where("n = 2").where(_near("lo", "hi")).select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        .union(members.where(_near("fp", "lo")).select(F.col("lo").alias("a"), F.col("fp").alias("b")))
        .union(members.where(_near("fp", "hi")).select(F.col("hi").alias("a"), F.col("fp").alias("b")))
        .where("a <> b").distinct()
    )
    stars = materialize(stars, "stars")
    first = materialize(connected_components(stars, "first"), "labels")
    label = lambda c: F.coalesce(F.col("component"), F.col(c))
    named = members.select("key", "fp").join(first.hint("merge"), members["fp"] == first["node"], "left").select("key", "fp", label("fp").alias("c"))
    named = materialize(named, "named")
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key", "c0")
    named = named.join(mixed.hint("merge"), "key")
    others = named.where("c <> c0").select("key", F.col("fp").alias("other"), F.col("c").alias("oc"))
    cross = others.join(named.select("key", "fp", "c").hint("merge"), (others["key"] == named["key"]) & (F.col("c") != F.col("oc")) & _near("fp", "other"))
    cross = materialize(cross.select(F.col("c").alias("a"), F.col("oc").alias("b")).distinct(), "cross")
    second = connected_components(cross, "second")
    merged = first.join(second.select(F.col("node").alias("component"), F.col("component").alias("into")).hint("merge"), "component", "left")
    merged = merged.select("node", F.coalesce("into", "component").alias("component"))
    lone = second.join(first.select("node").hint("merge"), "node", "left_anti")
    out = materialize(merged.union(lone), "linked")
    for x in (buckets, members, stars, first, cross):
        discard(x)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp) for every row of docs(doc_id, text).

    Two documents link at 3 or fewer differing bits; component_id is the smallest doc_id reachable through links. Equal
    fingerprints are one node, so copies cost nothing beyond their own row. Null text counts as empty (fingerprint 0,
    linked like any other); a row without doc_id takes part, and never names a component unless all of it are null. Other
    columns are not read. Repeated rows come out repeated; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    linked = linked_prints(nodes)
    placed = nodes.join(linked.hint("merge"), nodes["fp"] == linked["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    names = placed.groupBy("c").agg(F.min("low").alias("component_id"))
    placed = placed.join(names.hint("merge"), "c").select("fp", "component_id")
    return prints.join(placed.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each component the row with the smallest doc_id stays, all columns as they were.

    A doc_id names one text. Rows without doc_id cannot be named and stay; of repeated rows of a kept doc_id, one stays.
    """
    classes = materialize(near_duplicates(docs).select("doc_id", "component_id").where("doc_id is not null"), "classes")
    settle(docs.sparkSession)
    drop = classes.where("doc_id <> component_id").select("doc_id").distinct()
    # the lists grow with the corpus: they are never broadcast, so that the joins are the same at every size
    kept = docs.join(drop.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    again = classes.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    repeated = kept.join(again.hint("merge"), "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"])
    return kept.join(again.hint("merge"), "doc_id", "left_anti").select(docs.columns).unionByName(repeated)
