"""The contract queries against brute force, on fixtures with ties, nulls, copies and odd white space."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F
from tessera.llm import components, mixing, quality, sharding, simhash, substring
from tessera.llm import words as V

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _row string"


def corpus(n=160, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É#x", "ü", "the", "THE", "a b", "\u0085", "##", "|"]
    passage = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for i in range(n):
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b", " \r\n"]) for w in rng.choices(vocabulary, k=rng.choice([0, 1, 2, 5, 12, 13, 40, 90])))
        if i % 5 == 0:
            text += "\n" + passage
        if i % 7 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1] or ""
        if i % 11 == 0:
            text = text.replace("w1", "W1")
        if i % 13 == 0:
            text = text + " " + text
        rows.append((i * 37 % 499, text, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "S", "é", None]), 1, 2, "x"))
    rows += [(500, None, "en", "s1", None, None, None), (501, "", None, None, 0, 0, "y"), (None, passage, "en", "s1", 3, 3, "z"), (502, "one " * 3000, "en", "long", 1, 1, "q")]
    return rows + rows[10:14]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_match_the_regular_expression():
    texts = [r[1] for r in corpus()]
    got = defaultdict(list)
    for part in V.slices(pa.array(texts)):
        data = part.data.tobytes()
        for s, e, t in zip(part.starts, part.ends, part.text, strict=True):
            got[part.first + t].append(data[s:e].decode())
        hashes = part.hashes()
        assert len(set(zip(hashes.tolist(), (data[s:e] for s, e in zip(part.starts, part.ends, strict=True)), strict=True))) == len(set(hashes.tolist()))
    assert [got[i] for i in range(len(texts))] == [WORD.findall(t or "") for t in texts]


def test_word_slices_are_cut_between_texts(monkeypatch):
    monkeypatch.setattr(V, "SLICE", 16)
    parts = list(V.slices(pa.array(["aa bb", None, "", "cc " * 30, "dd"])))
    assert sum(len(p.offsets) - 1 for p in parts) == 5
    assert sum(len(p.starts) for p in parts) == 33


def brute_print(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_equals_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    prints = [brute_print(t) for _, t in rows]
    low = list(range(len(rows)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    want = Counter((d, f"{p:016x}", smallest.get(root(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))
    assert Counter(tuple(r)[:3] for r in simhash.near_duplicates(docs).collect()) == want


def clusters(seed, n):
    rng = random.Random(seed)
    out = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 40])):
            out.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_linked_prints_lose_no_link(spark, seed):
    prints = clusters(seed, 30)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    low = list(range(len(prints)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                low[root(i)] = root(j)
    groups = defaultdict(set)
    for i, x in enumerate(signed):
        groups[root(i)].add(x)
    got = defaultdict(set)
    for r in simhash.linked_prints(spark.createDataFrame([(x,) for x in signed], "fp long")).collect():
        got[r["component"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)
    assert all(min(g) == c for c, g in got.items())


def test_golay_keys_meet_at_one_bit():
    offsets, values = simhash.code_words()
    sets = [set(values[offsets[w] : offsets[w + 1]].tolist()) for w in range(1 << 16)]
    assert all(sets)
    for w in range(0, 1 << 16, 7):
        assert all(sets[w] & sets[w ^ 1 << b] for b in range(16))


def test_keep_one_leaves_one_of_each_component(spark, docs, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert Counter(i for i in ids if i is not None) == Counter(set(classes.values()))
    assert ids.count(None) == 1
    assert simhash.keep_one(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(60)] + [(7000, 7000), (None, 1), (3, 4), (-5, 900)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100 + i: 100 for i in range(60)} | {7000: 7000, -5: -5, 900: -5}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_dedup_equals_brute_force(docs, empty):
    rows = [(r["doc_id"], WORD.findall(r["text"] or "")) for r in docs.select("doc_id", "text").collect()]
    first = {}
    for d, w in rows:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if d is not None:
                first[k] = min(d, first.get(k, d))
    want = Counter()
    for d, w in rows:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and first[tuple(w[i : i + 13])] < d:
                gone.update(range(i, i + 13))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    for bits, chunk in ((None, 8 << 20), (12, 3000), (25, 1)):
        got = substring.dedup_substrings(docs, bits=bits, buckets=5, chunk=chunk).select("doc_id", "n_words", "n_removed", "kept_sha256")
        assert Counter(map(tuple, got.collect())) == want
    assert substring.dedup_substrings(empty).count() == 0
    text = substring.dedup_substrings(docs, with_text=True).where("n_removed > 0").first()
    assert hashlib.sha256(text["kept_text"].encode()).hexdigest() == text["kept_sha256"]


def test_sketch_never_underestimates():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    chunks = [hashes[:3000], np.concatenate([hashes[3000:], hashes[:300]]), np.repeat(hashes[4000:4010], 2)]
    bits = 24
    wide = substring.range_bits(bits)
    rows = pa.Table.from_batches([substring._sketch_rows(i, x, bits) for i, x in enumerate(chunks)])
    said = {i: [set() for _ in range(substring.DEPTH)] for i in range(3)}
    for part in {(r["row"], r["part"]) for r in rows.select(["row", "part"]).to_pylist()}:
        own = rows.filter((pc.field("row") == part[0]) & (pc.field("part") == part[1]))
        for r in substring._merge(wide)(own).to_pylist():
            said[r["chunk"]][r["row"]] |= set((substring._unpack(r["cells"]) + (r["part"] << wide)).tolist())
    for chunk, again in ((0, hashes[:300]), (1, hashes[:300]), (1, hashes[4000:4010]), (2, hashes[4000:4010])):
        for row in range(substring.DEPTH):
            assert set(substring._cells(again, row, bits).tolist()) <= said[chunk][row]
    assert len(said[0][0]) < 400 and len(said[2][1]) <= 10


def test_chunks_are_bounded_and_numbered_once(docs):
    rows = substring.numbered(docs, 2000).collect()
    assert len({r["rid"] for r in rows}) == len(rows) == docs.count()
    sizes = Counter()
    for r in rows:
        sizes[r["rid"] >> substring.CHUNK_ROW_BITS] += len((r["text"] or "").encode())
    longest = max(len((r["text"] or "").encode()) for r in rows)
    assert len(sizes) > 4 and max(sizes.values()) <= max(2000, longest)


def counts(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(docs, empty):
    got = quality.quality(docs).collect()
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        c = counts(r["text"])
        want[(r["doc_id"], *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.quality(empty).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_quality_thresholds_follow_the_group(spark):
    noisy = [(i, "word# " * 4 + " ".join(f"a{i}x{j}" for j in range(20)), "en", "code") for i in range(80)]
    clean = [(100 + i, " ".join(f"b{i}x{j}" for j in range(24)), "en", "prose") for i in range(80)]
    odd = [(300, "bad# " * 2 + "x# y# z# " + " ".join(f"c{j}" for j in range(20)), "en", "prose")]
    got = {r["doc_id"]: r for r in quality.quality(spark.createDataFrame(noisy + clean + odd, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(80)) and all(got[100 + i]["kept"] for i in range(80))
    assert not got[300]["kept"]


def test_shards_are_whole_even_and_gapless(docs, empty):
    rows = sharding.shard(docs, 24).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[i]) for i in range(24)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert sharding.shard(empty).count() == 0
    whole = sharding.shard_documents(docs)
    assert whole.columns == [*docs.columns, "shard", "slot"]


def test_hilbert_index_is_a_continuous_curve(spark):
    grid = spark.range(8).select(F.col("id").alias("x")).crossJoin(spark.range(8).select(F.col("id").alias("y"))).crossJoin(spark.range(8).select(F.col("id").alias("z")))
    rows = sorted((r["h"], (r["x"], r["y"], r["z"])) for r in grid.select("x", "y", "z", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).collect())
    assert [h for h, _ in rows] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for (_, p), (_, q) in zip(rows, rows[1:], strict=False))


def test_shard_files_round_trip(tmp_path, docs):
    table = sharding.write_shards(docs, str(tmp_path / "out"), 5)
    assert sum(r["rows"] for r in table.collect()) == docs.count()


def test_mix_equals_brute_force(docs, empty):
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    got = mixing.mix(docs).collect()
    taken = defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, n) for d, _, n in rows)
    for r in got:
        source = None if r["_source"] == "z" else r["_source"][1:]
        assert abs(r["target"] - target[source]) < 1e-6 and r["source_size"] == sizes[source]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_mixed_documents_come_near_the_targets(docs, empty):
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in mixed.collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    for r in mixing.mix(docs).collect():
        source = None if r["_source"] == "z" else r["_source"][1:]
        target[source], largest[source] = r["target"], max(largest[source], 2 * r["size"])
    assert all(abs(words[s] - target[s]) <= largest[s] for s in target)
    assert mixing.mix_documents(empty).count() == 0
