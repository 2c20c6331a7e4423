"""The pipeline as a whole on the small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import xxhash
from tessera.llm import decontamination, quality, simhash

DATA = "/root/testdata/sf0.001"


def test_each_stage_keeps_the_columns_and_takes_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    good = {r["doc_id"] for r in quality.quality(docs).collect() if r["kept"]}
    final = corpus_pipeline.run(spark, DATA)
    assert final.columns == [*docs.columns, "shard", "slot"]
    rows = final.collect()
    ids = {r["doc_id"] for r in rows}
    assert ids and ids <= good
    kept = docs.where(docs["doc_id"].isin(list(ids)))
    assert simhash.near_duplicates(kept).where("doc_id <> component_id").count() == 0
    assert decontamination.contaminated(kept, bench).count() == 0
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["text"] == text[r["doc_id"]] for r in rows)


# A version of the five stages in plain Python, written from their contracts.

SPACES, SYMBOLS = "\x20\x09\x0a\x0b\x0c\x0d", set("#*$%&|<>")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def measured(text):
    words, lines = words_of(text), [x for x in (text or "").split("\n") if x.strip(SPACES)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    n = len(words)
    rate = lambda a, b: a * 1000 // b if b else 0
    found = {"symbols": rate(sum(c in SYMBOLS for c in text or ""), n), "repeats": rate(len(covered), n), "dup_lines": rate(len(lines) - len(set(lines)), len(lines)), "word_length": rate(sum(map(len, words)), n)}
    return n < 10 or 100 * len(covered) > 20 * n, found


def brute_quality(rows):
    def fence(values, measure):
        bins = sorted(x >> max(0, x.bit_length() - 6) << max(0, x.bit_length() - 6) for x in values)
        q25, q75 = bins[-(-len(bins) // 4) - 1], bins[-(-3 * len(bins) // 4) - 1]
        return q75 + 3 * (q75 - q25) + {"symbols": 150, "repeats": 100, "dup_lines": 200, "word_length": 3000}[measure]

    judged = [(r, *measured(r["text"])) for r in rows]
    good, out = [(r, m) for r, failed, m in judged if not failed], []
    for r, m in good:
        for measure, x in m.items():
            levels = [[q[measure] for s, q in good], [q[measure] for s, q in good if s["lang"] == r["lang"]], [q[measure] for s, q in good if (s["lang"], s["source"]) == (r["lang"], r["source"])]]
            limit = fence(levels[0], measure)
            for level in levels[1:]:
                limit = (len(level) * fence(level, measure) + 5 * limit) // (len(level) + 5)
            if x > limit:
                break
        else:
            out.append(r)
    return out


def brute_dedup(rows):
    def fingerprint(text):
        words = [re.sub("[A-Z]", lambda c: c[0].lower(), w) for w in words_of(text)]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least, out, seen = {}, [], set()
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    for i, r in enumerate(rows):
        if r["doc_id"] is None:
            out.append(r)
        elif r["doc_id"] == least[find(i)] and r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            out.append(r)
    return out


def brute_decontaminated(rows, items):
    tokens = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))

    def score(item, text):
        best, row = 0, [0] * (len(text) + 1)
        for w in item:
            last, row = row, [0]
            for j, x in enumerate(text):
                row.append(max(0, last[j] + (2 if w == x else -1), last[j + 1] - 1, row[j] - 1))
            best = max(best, max(row))
        return best

    sought = [own for own in map(tokens, items) if len(own) >= 3]
    leaked = {r["doc_id"] for r in rows for own in sought if score(own, tokens(r["text"])) >= 2 * max(0.5 * len(own), min(len(own), 8))} - {None}
    return [r for r in rows if r["doc_id"] not in leaked]


def brute_mixed(rows):
    size = lambda r: len(words_of(r["text"]))
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(map(size, by[s])) for s in names}
    weight, target, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(total.values())
    while len(target) < len(names):
        rest = [s for s in names if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        full = [s for s in rest if share[s] > 2 * total[s]]
        for s in full or rest:
            target[s] = 2 * total[s] if full else share[s]
        left -= sum(target[s] for s in full)
    out = []
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        budget, before, cut = math.floor(target[s] - epochs * total[s] + 0.5), 0, None
        key = lambda r: (int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest()[:15], 16), r["doc_id"] if r["doc_id"] is not None else -(2**63), size(r))
        ordered = sorted(by[s], key=key)
        for r in ordered:
            part = max(0, min(size(r), budget - before))
            before += size(r)
            if part and 2 * part >= size(r):
                cut = key(r)
        for r in ordered:
            out += [r] * ((epochs + (cut is not None and key(r) <= cut)) if size(r) else 0)
    return out


def brute_sharded(rows, shards=24):
    nbytes = lambda r: len((r["text"] or "").encode()) + 8
    dims = [lambda r: (r["lang"] is not None, r["lang"] or ""), lambda r: (r["source"] is not None, r["source"] or ""), lambda r: int(math.log2(nbytes(r)) * 8)]
    codes = []
    for d in dims:
        values = [d(r) for r in rows]
        codes.append({v: sum(x < v for x in values) * 256 // len(rows) for v in set(values)})

    def curve(x):
        q = 128
        while q > 1:
            for i in range(3):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0], x[i] = x[0] ^ t, x[i] ^ t
            q >>= 1
        x[1] ^= x[0]
        x[2] ^= x[1]
        t, q = 0, 128
        while q > 1:
            t ^= q - 1 if x[2] & q else 0
            q >>= 1
        x = [v ^ t for v in x]
        return sum((x[i] >> b & 1) << (3 * b + 2 - i) for b in range(8) for i in range(3))

    order = sorted(rows, key=lambda r: (curve([c[d(r)] for c, d in zip(codes, dims, strict=True)]), zlib.crc32((r["text"] or "").encode()), r["doc_id"] is not None, r["doc_id"] or 0))
    out, slots = [], Counter()
    for i, r in enumerate(order):
        s = i * shards // len(order)
        out.append((r, s, slots[s]))
        slots[s] += 1
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [text(14) for _ in range(5)] + ["too short", None, ""]
    texts = [text(rng.randint(12, 90)) for _ in range(90)] + [None, "", "few words", "same words again and " * 9, "# % & " * 12, text(2500)]
    texts += [t if i % 2 else t + " " + rng.choice(vocabulary) for i, t in enumerate(rng.choices(texts[:40], k=30))]
    for i in range(8):
        own = items[i % 5].split()
        own[rng.randrange(len(own))] = "edited"
        texts.append(text(20) + " " + " ".join(own).upper() + ", " + text(20))
    rows = [{"doc_id": i, "text": t, "lang": rng.choice(["en", "de", None]), "source": rng.choice(["a", "b", "c", "d", None]), "n_chars": len(t or ""), "size": "s", "kept": i % 3, "fp": None, "shard": "old", "_key": 1} for i, t in enumerate(texts)]
    rows += [rows[0], rows[5], rows[5], {**rows[7], "doc_id": None}, {**rows[1], "doc_id": None, "text": text(30)}]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, kept int, fp string, shard string, _key int"
    spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = [rows, good := brute_quality(rows), once := brute_dedup(good), clean := brute_decontaminated(once, items), mixed := brute_mixed(clean)]
    assert all(len(a) > len(b) > 40 for a, b in zip(steps, steps[1:4], strict=False)) and len(mixed) > len(clean)
    names = [c for c in rows[0] if c != "shard"]
    want = Counter((*[r[c] for c in names], s, k) for r, s, k in brute_sharded(mixed))
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.columns == [*names, "shard", "slot"]
    assert Counter(tuple(r) for r in final.collect()) == want


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
