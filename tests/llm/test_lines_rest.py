"""No link within a bucket is lost, however many lines it holds."""

import random

from test_lines import brute, classes_of, full, sentence, together

from tessera.llm import lines


def test_a_lone_pair_in_a_bucket_of_many_lines_is_found(spark):
    rng, texts, pairs = random.Random(17), [], []
    for _ in range(4):
        base = sentence(rng, 60).split()

        def edited(n, base=base):
            own = list(base)
            for i in rng.sample(range(60), n):
                own[i] = sentence(rng, 1)
            return " ".join(own)

        texts += [edited(5) for _ in range(500)]
        pairs.append((edited(1), edited(1)))
    got = classes_of(spark, texts + [x for pair in pairs for x in pair])
    assert all(got[a] == got[b] for a, b in pairs)


def test_the_exact_pass_finds_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm.lines.DRAWS", (1,))
    rng, texts = random.Random(23), []
    for _ in range(6):
        base = sentence(rng, 30).split()
        for _ in range(20):
            own = list(base)
            for i in rng.sample(range(30), rng.choice([0, 1, 1, 2, 3])):
                own[i] = sentence(rng, 1)
            texts.append(" ".join(own))
    texts = sorted(set(texts))
    assert together(classes_of(spark, texts)) == together(brute(texts))


def edited(rng, base, n):
    own = base.split()
    for i in rng.sample(range(len(own)), n):
        own[i] = sentence(rng, 1)
    return " ".join(own)


def test_lines_of_small_buckets_only_are_not_cut_into_shingles_again(spark, monkeypatch):
    cut, keep = [], lines._by_prefix
    monkeypatch.setattr(lines, "DRAWS", (1,))
    monkeypatch.setattr(lines, "_by_prefix", lambda rows, texts: (cut.append({r["id"] for r in rows.collect()}), keep(rows, texts))[1])
    rng, texts = random.Random(29), []
    for _ in range(40):
        base = sentence(rng, 30)
        texts += [edited(rng, base, n) for n in (0, 1, 2, 3, 3)]
    hot = sentence(rng, 60)
    texts = sorted({*texts, *[edited(rng, hot, 5) for _ in range(100)]})
    want, got = together(brute(texts)), together(classes_of(spark, texts))
    assert got <= want
    assert len(got) >= 0.99 * len(want) > 0
    assert [0 < len(x) <= 100 for x in cut] == [True]


def test_the_prefix_join_makes_all_similar_pairs_and_few_others(spark):
    for edits, most in ((2, 400), (3, 10)):
        rng = random.Random(31)
        hot = sentence(rng, 60)
        texts = [edited(rng, hot, edits) for _ in range(60)]
        lines_ = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
        rows = lines_.selectExpr("id", "id as component")
        got = {(r["a"], r["b"]) for r in lines._by_prefix(rows, lines.Texts(lines_, lines._sketches(lines_))).distinct().collect()}
        want = {(i, j) for i, x in enumerate(texts) for j, y in enumerate(texts[:i]) if 10 * len(full(x) & full(y)) >= 8 * len(full(x) | full(y))}
        assert want <= got
        assert len(got) <= most
