"""Line dedup against brute force over all overlapping shingles."""

import hashlib
import random

from tessera.llm import lines


def full(line):
    return {line[i : i + 9] for i in range(max(1, len(line) - 8))}


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


def classes_of(spark, texts):
    kept = {r["line_md5"]: r["kept_md5"] for r in lines.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    return {x: kept[hashlib.md5(x.encode()).hexdigest()] for x in texts}


def brute(texts):
    root = {x: x for x in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if 10 * len(full(a) & full(b)) >= 8 * len(full(a) | full(b)):
                root[find(a)] = find(b)
    return {x: find(x) for x in texts}


def together(of):
    return {(a, b) for a in of for b in of if a < b and of[a] == of[b]}


def test_similarity_is_over_all_overlapping_shingles(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(30):
        words = sentence(rng, 40).split()
        for _ in range(6):
            own = list(words)
            for _ in range(rng.choice([1, 1, 2, 3])):
                own[rng.randrange(len(own))] = sentence(rng, 1)
            texts.append(" ".join(own))
    texts = sorted(set(texts))
    want, got = together(brute(texts)), together(classes_of(spark, texts))
    assert got <= want
    assert len(got) >= 0.99 * len(want) > 0


def test_repeats_of_a_phrase_do_not_part_lines(spark):
    rng = random.Random(3)
    phrases = [sentence(rng, 12) for _ in range(40)]
    texts = [" ".join([p] * n) for p in phrases for n in (3, 5)]
    got = classes_of(spark, texts)
    assert all(got[a] == got[b] for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert len(set(got.values())) == 40


def test_short_lines_meet(spark):
    rng = random.Random(7)
    texts = ["a", "ab", "aaaaaaaaaa", "aaaaaaaaaaa", "EAST!! THTHORBLE!! THTIED!! ONING", "THTHORBLE!! THTIED!! ONING"]
    for n in range(2, 44):
        for _ in range(4):
            own = "".join(rng.choices("abcdef ", k=n + 8)).replace(" ", "x", 1).strip()
            texts += [own, own + "y", "z" + own, own + "yz", own[1:]]
    texts = sorted({x.strip() for x in texts})
    want, got = together(brute(texts)), together(classes_of(spark, texts))
    few = {(a, b) for a, b in want if min(len(full(a)), len(full(b))) < lines.FEW}
    assert got <= want
    assert few <= got and len(few) > 100


def test_lines_are_trimmed_of_tabs_and_returns(spark):
    docs = spark.createDataFrame([(1, "one line of text\r\n\tone line of text \n\t\r\n")], "doc_id long, text string")
    assert [(r["n"], r["line_md5"]) for r in lines.classes(docs).collect()] == [(2, hashlib.md5(b"one line of text").hexdigest())]
