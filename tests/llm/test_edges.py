"""Nulls, very long texts, ties, repeated rows, empty tables and clashing columns, for operators that have no other test of them."""

import hashlib

from tessera.llm import classifier, lines, quality, simhash, substring

CLASH = "doc_id long, text string, lang string, source string, id string, keys int, fp string, found int, n long, grade string, selected int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "x", 1, "y", 2, 3, "z", 4) for i, t in rows], CLASH)


def test_lines(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    near = long.replace("w100 ", "w1000000 ")
    got = {r["line_md5"]: r for r in lines.classes(docs_of(spark, [(2, long), (1, near), (1, near), (3, None), (4, ""), (None, "only here")])).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got[md5(long)]["kept_md5"] == md5(near) and got[md5(near)]["n"] == 2 and len(got) == 3
    tie = ["the very same words stand here in each of the two lines A", "the very same words stand here in each of the two lines B"]
    got = {r["line_md5"]: r["kept_md5"] for r in lines.classes(docs_of(spark, [(7, "\n".join(tie))])).collect()}
    assert set(got.values()) == {min(map(md5, tie))}
    assert lines.classes(docs_of(spark, [])).count() == 0


def test_quality(spark):
    long = " ".join(f"word{i}" for i in range(100_000))
    got = quality.quality(docs_of(spark, [(1, long), (1, long), (2, None), (3, "")])).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_words"], r["base_failed"]) for r in got] == [(1, 100_000, False), (1, 100_000, False), (2, 0, True), (3, 0, True)]


def test_each_measure_rejects_what_the_base_rules_pass(spark):
    plain = [(i, "\n".join(f"some{i}x{k} words{i}x{k} here{i}x{k}" for k in range(20))) for i in range(60)]
    words = [f"q{k}" for k in range(55)]
    odd = [
        (100, plain[0][1] + " " + " ".join(f"#{k}#" for k in range(30))), (101, " ".join(words) + " a b c d e " + " ".join(words[:3]) + " a b c d e"),
        (102, "\n".join([" ".join(f"line{k}x{j}" for j in range(10)) for k in range(38)] + ["x y"] * 12)), (103, " ".join("m" * 60 + str(k) for k in range(40))),
    ]
    got = {r["doc_id"]: r for r in quality.quality(docs_of(spark, plain + odd)).collect()}
    assert all(got[i]["kept"] for i, _ in plain)
    assert all(not got[i]["kept"] and not got[i]["base_failed"] for i, _ in odd), [(i, got[i]) for i, _ in odd if got[i]["kept"]]


def test_simhash(spark):
    long = "lorem ipsum dolor " * 100_000
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs_of(spark, [(5, long), (4, long), (4, long), (9, None), (8, "")])).collect()}
    assert got == {4: 4, 5: 4, 8: 8, 9: 8}


def test_classifier(spark):
    good, bad = [f"good{i} fine nice clear prose" for i in range(40)], [f"bad{i} junk spam click buy" for i in range(40)]
    rows = [*enumerate(good), *((100 + i, t) for i, t in enumerate(bad)), (200, "good " * 300_000), (201, None), (0, "another text of document 0"), (300, good[0]), (301, good[0]), (300, good[0])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(40)] + [(0, 1, 0), (1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = classifier.classify(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["expected_grade"])
    assert by[300][0] == by[300][1] == by[301][0] and min(by[2]) > max(by[101])
    few = classifier.train(docs_of(spark, rows), labels, most_features=100)
    assert few is not None and classifier.train(docs_of(spark, rows), labels, most_features=1) is None
    assert classifier.classify(docs_of(spark, []), labels).count() == 0
    assert [r["selected"] for r in classifier.classify(docs_of(spark, rows[:2]), labels.limit(0)).collect()] == [True, True]


def test_substrings(spark):
    long = " ".join(f"w{i}" for i in range(400_000))
    got = {r["doc_id"]: r for r in substring.dedup_substrings(docs_of(spark, [(1, long), (2, long), (3, None), (4, ""), (None, long)])).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[None]["n_removed"], got[3]["n_words"], got[4]["n_words"]) == (0, 400_000, 0, 0, 0)
    assert got[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert substring.dedup_substrings(docs_of(spark, [])).count() == 0
