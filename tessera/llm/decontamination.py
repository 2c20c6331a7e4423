"""Benchmark decontamination: n-gram seeds find candidate passages, Smith-Waterman alignment scores them.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased, so case and punctuation do not matter.
Every 3-gram of an item is a seed, however common, so three equal words in a row are one. A pass looks the seeds up in each
document; around each the item is aligned with that stretch of the document unless the words that they share cannot reach
the least score, and the best local alignment (match 2, mismatch and gap -1) is scored against the item's own.

The benchmark is the bounded side: its distinct texts are taken in blocks of at most BLOCK bytes (one text at least), each of
which is sent to the executors, costs a pass over the documents and is released; nothing of the documents is shuffled or collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as V
from .scratch import materialize

GRAM, BLOCK = 3, 4 << 20
SIMILARITY, LEAST_WORDS = 0.5, 8
#: Pairs of a seed in a document and its place in an item that a task holds at once.
PLACES = 1 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32


def tokens(texts: pa.Array) -> list[tuple[V.Slice, np.ndarray]]:
    return [(part, part.hashes(FOLD)) for part in V.slices(texts, SEPARATORS)]


class Index:
    """A block of benchmark items: word hashes, and the distinct 3-grams with where they stand."""

    def __init__(self, item_ids: list[int], texts: list[str]):
        self.item_ids, self.items = item_ids, [np.zeros(0, np.uint64) for _ in item_ids]
        grams, item, pos = [], [], []
        for part, hashes in tokens(pa.array(texts, pa.large_string())):
            at, got = part.windows(hashes, GRAM)
            for t in range(len(part.offsets) - 1):
                self.items[part.first + t] = hashes[part.bounds[t] : part.bounds[t + 1]]
            grams.append(got)
            item.append(part.first + part.text[at])
            pos.append(at - part.bounds[part.text[at]])
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        gram, self.item, self.pos = cat(grams, np.uint64), cat(item, np.int64), cat(pos, np.int64)
        self.grams, gram = np.unique(gram, return_inverse=True)
        order = np.argsort(gram, kind="stable")
        self.item, self.pos = self.item[order], self.pos[order]
        self.starts = np.searchsorted(gram[order], np.arange(len(self.grams) + 1))
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.filter()

    def filter(self) -> None:
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.grams & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are known, and as which gram."""
        at = np.flatnonzero(self.bits[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.grams):
            return at[:0], at[:0]
        slot = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        ok = self.grams[slot] == hashes[at]
        return at[ok], slot[ok]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman: the best local score, and the passage's words from and to (exclusive) that it covers."""

    def best(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
        slope = np.arange(len(b) + 1) * -GAP
        row, top, at = np.zeros(len(b) + 1, np.int64), 0, (0, 0)
        for i, word in enumerate(a):
            new = np.maximum(row + GAP, 0)
            np.maximum(new[1:], row[:-1] + np.where(b == word, MATCH, MISMATCH), out=new[1:])
            row = np.maximum.accumulate(new + slope) - slope
            j = int(row.argmax())
            if row[j] > top:
                top, at = int(row[j]), (i + 1, j)
        return top, *at

    top, i, j = best(item, passage)
    if not top:
        return 0, 0, 0
    _, _, back = best(item[:i][::-1], passage[:j][::-1])
    return top, j - back, j


def _passages(known: Index, text: np.ndarray, pos: np.ndarray, gram: np.ndarray):
    """(text, item, first word, last word) worth aligning, from seed hits; stretches that overlap are one.

    Hits are paired with their places in the items PLACES at a time, so a word repeated over and over costs time, not memory.
    Each stretch reaches an item's length beyond its hits, so one that is cut in two is still covered by either part.
    """
    upto = np.cumsum(known.starts[gram + 1] - known.starts[gram])
    a = 0
    while a < len(gram):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PLACES, "right")))
        yield from _stretches(known, text[a:b], pos[a:b], gram[a:b])
        a = b


def _stretches(known: Index, text: np.ndarray, pos: np.ndarray, gram: np.ndarray):
    n = known.starts[gram + 1] - known.starts[gram]
    hit = np.repeat(np.arange(len(gram)), n)
    place = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + known.starts[gram][hit]
    item, diagonal = known.item[place], pos[hit] - known.pos[place]
    sizes, of = known.sizes[item], text[hit]
    order = np.lexsort((diagonal, item, of))
    item, diagonal, sizes, of = item[order], diagonal[order], sizes[order], of[order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > sizes[1:] // 2)))
    cut = np.append(np.flatnonzero(new), len(of))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        size = int(sizes[a])
        pad = size // 4 + 4
        yield int(of[a]), int(item[a]), int(diagonal[a]) - pad, int(diagonal[b - 1]) + size + pad


def _leaks(index, similarity: float, least: int):
    def run(batches):
        known = index.value
        for batch in batches:
            found: dict[tuple[int, int], tuple] = {}
            for part, hashes in tokens(batch.column(1)):
                at, got = part.windows(hashes, GRAM)
                hit, gram = known.find(got)
                at = at[hit]
                for text, item, lo, hi in _passages(known, part.text[at], at - part.bounds[part.text[at]], gram):
                    words = hashes[part.bounds[text] : part.bounds[text + 1]]
                    lo = max(lo, 0)
                    own = known.items[item]
                    need = max(similarity * len(own), min(len(own), least))
                    if np.isin(own, words[lo:hi]).sum() < need:
                        continue
                    score, a, b = align(own, words[lo:hi])
                    if score >= MATCH * need:
                        key = (part.first + text, item)
                        found[key] = max(found.get(key, (0,)), (score / (MATCH * len(own)), -(lo + a), lo + b))
            rows = [(batch.column(0)[d].as_py(), known.item_ids[i], s, -a, b) for (d, i), (s, a, b) in found.items()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "text_id", "similarity", "first_word", "end_word"])

    return run


_FOUND = "doc_id long, text_id long, similarity double, first_word long, end_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, least: int = LEAST_WORDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, end_word): documents that hold a copy, maybe edited, of a benchmark item.

    similarity is the alignment's score over that of the whole item with itself; a row has at least the one asked for and
    min(item's words, least) matching words' worth. Of equal scores the first stretch, then the longer one is given. The
    words are counted within the document, which may be of any length. Null text or item has no words; items of fewer than
    3 words cannot be told from chance and are not sought; repeated items or documents give repeated rows; a null doc_id or
    item_id comes out as null. Other columns are not read; empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where(F.octet_length("text") >= 2 * GRAM - 1)
    distinct = items.groupBy("text").agg(F.count("*").alias("n")).select(F.xxhash64("text").alias("text_id"), "text")
    distinct = materialize(distinct, "items")
    size = distinct.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], _FOUND)
    for b in range(blocks):
        rows = distinct.where(F.pmod("text_id", F.lit(blocks)) == b).collect()
        index = Index([r["text_id"] for r in rows], [r["text"] for r in rows])
        sent = spark.sparkContext.broadcast(index)
        out = out.union(materialize(texts.mapInArrow(_leaks(sent, similarity, least), _FOUND), "found"))
        sent.destroy()
    names = items.select("item_id", F.xxhash64("text").alias("text_id"))
    return out.join(names, "text_id").select("doc_id", "item_id", "similarity", "first_word", "end_word")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that contaminated() names; rows without doc_id stay."""
    leaks = materialize(contaminated(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "leaks")
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)
