"""Substring dedup: a count-min prefilter over 13-word windows, then exact grouping of the windows estimated repeated.

The rows are written once with a number, in chunks of about CHUNK bytes. Pass 1 sketches each chunk: the sorted cells of its
windows in DEPTH rows of counters, counts saturating at 2. The sketches merge by range of cells, each range in a task of its
own, which holds one byte a cell and says for each chunk which of its cells count twice or more in all. A count-min
estimate is never too low, so a window whose cells are not all among those is surely unique. Pass 2 reads the chunks with
their cells and ships only windows estimated repeated. Within a chunk only the smallest document of a window goes on; later
ones are already known to repeat. The reducers group windows exactly (96 bits of hash) and name every window whose smallest
document is another one. At last the named words go, document by document.

The counters grow with the input, at least two for each window, and so does the number of ranges: a task's memory, and
everything that is sent to the driver or to all executors, stays the same at every size, and the texts are read as often.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as V
from .scratch import discard, materialize, settle

WINDOW, DEPTH = 13, 2
#: Bits of the cells in one range: a task holds a byte for each, and there are 2**RANGES_BITS ranges in a row where that allows it.
LEAST_RANGE_BITS, MOST_RANGE_BITS, RANGES_BITS = 22, 27, 11
#: Bytes of text and rows of a chunk; a longer text is a chunk of its own.
CHUNK, CHUNK_ROW_BITS = 8 << 20, 20
_SALT = np.uint64(0xA5A5A5A55A5A5A5A)


def range_bits(bits: int) -> int:
    return min(bits, MOST_RANGE_BITS, max(LEAST_RANGE_BITS, bits - RANGES_BITS))


def _pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers as gaps of two bytes, or four if one needs them, all low bytes first; the first byte says which."""
    gaps = np.diff(values, prepend=np.zeros(1, values.dtype))
    width = 2 if not len(gaps) or gaps.max() < 1 << 16 else 4
    return bytes([width]) + gaps.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{data[0]}").ravel().astype(np.int64))


def _cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((hashes if row == 0 else V.mix(hashes ^ _SALT)) >> np.uint64(64 - bits)).astype(np.int64)


def _number(most: int):
    """(rid, doc_id, text): a number for each row, whose bits above CHUNK_ROW_BITS are its chunk's."""

    def run(batches):
        chunk, place, size = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            lengths = np.diff(V.plain(batch.column(1))[0])
            rids = np.empty(len(lengths), np.int64)
            for i, n in enumerate(lengths.tolist()):
                if place and (size + n > most or place >> CHUNK_ROW_BITS):
                    chunk, place, size = chunk + 1, 0, 0
                rids[i] = chunk << CHUNK_ROW_BITS | place
                place, size = place + 1, size + n
            yield pa.RecordBatch.from_arrays([pa.array(rids), batch.column(0), batch.column(1)], names=["rid", "doc_id", "text"])

    return run


def _sketch_rows(chunk: int, hashes: np.ndarray, bits: int):
    rows, wide = [], range_bits(bits)
    for row in range(DEPTH):
        cells = np.sort(_cells(hashes, row, bits))
        if len(cells) > 2:
            cells = cells[np.concatenate(([True, True], cells[2:] != cells[:-2]))]
        cut = np.append(np.flatnonzero(np.concatenate(([True], np.diff(cells >> wide) > 0))), len(cells))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            part = int(cells[a]) >> wide
            rows.append((row, part, chunk, _pack(cells[a:b] - (part << wide))))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["row", "part", "chunk", "cells"])


_SKETCH = "row int, part long, chunk long, cells binary"


def _sketch(k: int, bits: int):
    """The sketches of the chunks, or of the parts of them, that a task reads."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            chunks = batch.column(0).to_numpy() >> CHUNK_ROW_BITS
            for part in V.slices(batch.column(1)):
                first, hashes = part.windows(part.hashes(), k)
                of = chunks[part.first + part.text[first]]
                for chunk in np.unique(of).tolist():
                    if chunk != at and held:
                        yield _sketch_rows(at, np.concatenate(held), bits)
                        held = []
                    at = chunk
                    held.append(hashes[of == chunk])
        if held:
            yield _sketch_rows(at, np.concatenate(held), bits)

    return run


def _merge(wide: int):
    """Of one range: each chunk's cells that count twice or more over all chunks."""

    def run(table: pa.Table) -> pa.Table:
        count = np.zeros(1 << wide, np.uint8)
        lists = [x.as_py() for x in table.column("cells")]
        for data in lists:
            cells = _unpack(data)
            again = cells[1:][cells[1:] == cells[:-1]]
            count[cells] = np.minimum(count[cells] + 1, 2)
            count[again] = 2
        found = []
        for data in lists:
            cells = _unpack(data)
            found.append(_pack(np.unique(cells[count[cells] > 1])))
        out = table.set_column(table.schema.get_field_index("cells"), "cells", pa.array(found, pa.binary()))
        return out.filter(pa.array([len(x) > 1 for x in found], pa.bool_())).select(["row", "part", "chunk", "cells"])

    return run


ENTRY = np.dtype([("h", "<u8"), ("x", "<u4"), ("pos", "<i4"), ("doc", "<i8"), ("fid", "<i8")])
_SHIPPED = "bucket int, doc_id long, fid long, data binary"


def _removals(entries: np.ndarray, bucket_of_doc: bool, buckets: int):
    """Rows (bucket, doc_id, fid, positions) for entries, one a document."""
    entries = entries[np.lexsort((entries["pos"], entries["fid"], entries["doc"]))]
    cut = np.flatnonzero((entries["doc"][1:] != entries["doc"][:-1]) | (entries["fid"][1:] != entries["fid"][:-1])) + 1
    for part in np.split(entries, cut):
        if len(part):
            doc = int(part["doc"][0])
            yield (doc % buckets if bucket_of_doc else 0, doc, int(part["fid"][0]), part["pos"].astype("<i4").tobytes())


def _resolve(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of each window's smallest document, and the others."""
    entries = entries[np.lexsort((entries["doc"], entries["x"], entries["h"]))]
    if not len(entries):
        return entries, entries
    new = np.concatenate(([True], (entries["h"][1:] != entries["h"][:-1]) | (entries["x"][1:] != entries["x"][:-1])))
    low = entries["doc"][new][np.cumsum(new) - 1]
    return entries[entries["doc"] == low], entries[entries["doc"] != low]


def _compress(part: np.ndarray) -> bytes:
    """Columns one after another, in document order and but for the hashes as differences, so that compression finds the runs."""
    part = part[np.lexsort((part["pos"], part["fid"], part["doc"]))]
    steps = b"".join(np.diff(part[c], prepend=np.zeros(1, ENTRY[c])).tobytes() for c in ("pos", "doc", "fid"))
    return b"".join(np.ascontiguousarray(part[c]).tobytes() for c in ("h", "x")) + steps


def _expand(data: bytes) -> np.ndarray:
    n = len(data) // ENTRY.itemsize
    out, at = np.zeros(n, ENTRY), 0
    for c in ("h", "x", "pos", "doc", "fid"):
        column = np.frombuffer(data, ENTRY[c], n, at)
        out[c] = np.cumsum(column, dtype=ENTRY[c]) if c in ("pos", "doc", "fid") else column
        at += ENTRY[c].itemsize * n
    return out


def _batch(rows: list[tuple]):
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "doc_id", "fid", "data"])


def _ship(k: int, bits: int, buckets: int):
    """Of one chunk: the windows whose cells all count twice or more, as entries for exact grouping."""

    def run(texts: pa.Table, flags: pa.Table) -> pa.Table:
        again, wide = [[] for _ in range(DEPTH)], range_bits(bits)
        for row, part, cells in zip(*[flags.column(c).to_pylist() for c in ("row", "part", "cells")], strict=True):
            again[row].append(_unpack(cells) + (part << wide))
        if not all(again) or not texts.num_rows:
            return pa.Table.from_batches([_batch([])])
        known = [np.unique(np.concatenate(x)) for x in again]
        rids, doc_ids, held = texts.column("rid").to_numpy(), texts.column("doc_id").to_numpy(), []
        for part in V.slices(texts.column("text")):
            one = part.hashes()
            at, hashes = part.windows(one, k)
            seen = np.ones(len(at), bool)
            for row in range(DEPTH):
                cells = _cells(hashes, row, bits)
                slot = np.minimum(np.searchsorted(known[row], cells), len(known[row]) - 1)
                seen &= known[row][slot] == cells
            if not seen.any():
                continue
            other = part.windows(V.mix(one ^ _SALT), k)[1][seen]
            at, text = at[seen], part.text[at[seen]]
            got = np.empty(len(at), ENTRY)
            got["h"], got["x"], got["pos"] = hashes[seen], other >> np.uint64(32), at - part.bounds[text]
            got["doc"], got["fid"] = doc_ids[part.first + text], rids[part.first + text]
            held.append(got)
        if not held:
            return pa.Table.from_batches([_batch([])])
        first, later = _resolve(np.concatenate(held))
        rows = list(_removals(later, True, buckets))
        bucket = (first["h"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first, bucket = first[order], bucket[order]
        for part in np.split(np.arange(len(first)), np.flatnonzero(np.diff(bucket)) + 1):
            if len(part):
                rows.append((int(bucket[part[0]]), None, None, _compress(first[part])))
        return pa.Table.from_batches([_batch(rows)])

    return run


def _group(table: pa.Table) -> pa.Table:
    """Of one bucket: the removals named so far, and those of windows whose smallest document is another."""
    known = table.column("doc_id").is_valid()
    rows = [(0, r["doc_id"], r["fid"], r["data"]) for r in table.filter(known).to_pylist()]
    blobs = [_expand(x.as_py()) for x in table.filter(pa.compute.invert(known)).column("data")]
    if blobs:
        rows += _removals(_resolve(np.concatenate(blobs))[1], False, 1)
    return pa.Table.from_batches([_batch(rows)]).select(["doc_id", "fid", "data"])


def numbered(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(rid, doc_id, text) of every row, written, with rid as _number says."""
    return materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_number(chunk), "rid long, doc_id long, text string"), "texts")


def repeated_windows(texts: DataFrame, k: int = WINDOW, buckets: int | None = None, bits: int | None = None) -> DataFrame:
    """(doc_id, fid, data): word positions (packed int32) of the row fid where a window starts that also starts in a smaller document."""
    texts = texts.where("doc_id is not null and text is not null")
    if bits is None or buckets is None:
        size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        bits = bits or max(LEAST_RANGE_BITS, (size // 3).bit_length())  # over two cells for each window, as a word has a byte and a space
        buckets = buckets or max(64, size // (8 << 20))
    chunk = F.shiftright("rid", CHUNK_ROW_BITS)
    lists = texts.select("rid", "text").mapInArrow(_sketch(k, bits), _SKETCH)
    flags = materialize(lists.groupBy("row", "part").applyInArrow(_merge(range_bits(bits)), _SKETCH), "flags")
    settle(texts.sparkSession)
    whole = texts.select(chunk.alias("chunk"), "rid", "doc_id", "text")
    shipped = materialize(whole.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(_ship(k, bits, buckets), _SHIPPED), "shipped")
    discard(flags)
    settle(texts.sparkSession)  # written, so that the shuffled texts can go before the entries are shuffled
    found = materialize(shipped.groupBy("bucket").applyInArrow(_group, "doc_id long, fid long, data binary"), "windows")
    discard(shipped)
    return found


def _finish(k: int, with_text: bool):
    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
                words = (text.as_py() or "").encode().split()
                n = removed = len(words)
                kept = words
                removed = 0
                if found.is_valid and n >= k:
                    edge = np.zeros(n + 1, np.int64)
                    at = np.unique(np.concatenate([np.frombuffer(x, "<i4") for x in found.as_py()]))
                    at = at[at + k <= n]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + k, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    removed = int(covered.sum())
                    kept = [words[i] for i in np.flatnonzero(~covered).tolist()]
                joined = b" ".join(kept)
                rows.append((n, removed, joined.decode() if with_text else None, hashlib.sha256(joined).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            new = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return run


def dedup_substrings(docs: DataFrame, k: int = WINDOW, with_text: bool = False, buckets: int | None = None, bits: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_words, n_removed, kept_text (only with_text), kept_sha256.

    A word goes if any window of k words over it also starts in a document with a smaller doc_id; windows are judged on
    the input. Null text has no words; texts of fewer than k words are kept; rows without doc_id keep all their words and
    take none from others; repeated rows with one doc_id do not affect one another, and of equal texts the one with the least
    doc_id keeps its words. Texts may be of any length: memory follows the longest. Other columns are not read; an empty
    table gives no rows.
    """
    texts = numbered(docs, chunk)
    found = repeated_windows(texts, k, buckets, bits).groupBy("fid").agg(F.collect_list("data").alias("found"))
    settle(docs.sparkSession)
    joined = texts.join(found, texts["rid"] == found["fid"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_finish(k, with_text), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
