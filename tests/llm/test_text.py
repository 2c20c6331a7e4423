"""Line dedup, decontamination, classifier, licence scan and HTML extraction on planted cases."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import classifier, decontamination, htmltext, licenses, lines

EXTRA = "doc_id long, text string, line string, keys string"


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(n))


def shingle_set(line):
    return {line[at : at + 9] for at in range(max(1, len(line) - 8))}


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(11)
    base = [sentence(rng, 40) for _ in range(40)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(4):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                words[rng.randrange(len(words))] = sentence(rng, 1)
            own.append(" ".join(words))
        rows.append((i, "\n".join([*own, "short one", ""]), "x", "y"))
    return [*rows, (500, None, None, None), (501, "", "", ""), (None, base[0], "", ""), rows[3]]


def test_line_classes_find_the_links_of_brute_force(spark, line_rows):
    rows = lines.classes(spark.createDataFrame(line_rows, EXTRA)).collect()
    every = sorted({x.strip(" ") for _, t, *_ in line_rows for x in (t or "").split("\n")} - {""})
    name = {hashlib.md5(x.encode()).hexdigest(): x for x in every}
    got = [{"line": name[r["line_md5"]], "kept_line": name[r["kept_md5"]], "kept": r["kept"]} for r in rows]
    assert sorted(r["line"] for r in got) == every
    sets = {x: shingle_set(x) for x in every}
    low = {x: x for x in every}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(every):
        for b in every[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low[root(a)] = root(b)
    want, have = defaultdict(set), defaultdict(set)
    for x in every:
        want[root(x)].add(x)
    for r in got:
        have[r["kept_line"]].add(r["line"])
        assert r["kept"] == (r["line"] == r["kept_line"])
    ours = {x: k for k, own in have.items() for x in own}
    pairs = [(a, b) for own in want.values() for a in own for b in own if a < b]
    assert sum(ours[a] == ours[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert all(root(a) == root(b) for own in have.values() for a in own for b in own)


def test_clean_keeps_one_line_of_each_class(spark, line_rows):
    docs = spark.createDataFrame(line_rows[:-2], EXTRA)
    got = {r["doc_id"]: r["text"] for r in lines.clean(docs).collect()}
    assert got[500] is None and got[501] == "" and len(got) == len(line_rows) - 2
    left = [x for t in got.values() for x in (t or "").split("\n") if len(x) >= 40]
    short = {hashlib.md5(x.encode()).hexdigest() for x in ("short one",)}
    assert sorted(hashlib.md5(x.encode()).hexdigest() for x in left) == sorted(r["line_md5"] for r in lines.classes(docs).where("kept").collect() if r["line_md5"] not in short)
    assert sum(t.count("short one") for t in got.values() if t) == 120


def test_no_lines(spark):
    assert lines.classes(spark.createDataFrame([], EXTRA)).count() == 0


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(5)
    items = [(i, sentence(rng, 30)) for i in range(12)] + [(50, "two words"), (51, None), (52, "")]
    docs, want = [], set()
    for i in range(60):
        words = sentence(rng, 80).split()
        if i % 3 == 0:
            item = items[i % 12]
            own = item[1].split()
            for _ in range(i % 4):
                own[rng.randrange(len(own))] = "edited"
            if i % 2:
                own.insert(10, "more")
                del own[20]
            words[40:40] = [w.upper() + "," for w in own]
            want.add((i, item[0]))
        if i % 7 == 0:
            words[5:5] = items[1][1].split()[:7]
        docs.append((i, " ".join(words), "x", "y"))
    return docs + [(70, None, "", ""), (71, "", "", ""), (None, items[2][1], "", "")], items, want


def test_edited_copies_are_found_and_others_left(spark, leaks):
    docs, items, want = leaks
    documents, benchmark = spark.createDataFrame(docs, EXTRA), spark.createDataFrame(items, "item_id long, text string")
    for block in (decontamination.BLOCK, 400):
        got = decontamination.contaminated(documents, benchmark, block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(None, 2)}
        assert all(36 <= r["first_word"] <= 55 and r["end_word"] - r["first_word"] > 20 for r in got if r["doc_id"] is not None)
    kept = decontamination.without_leaks(documents, benchmark)
    assert kept.columns == documents.columns
    assert kept.count() == len(docs) - len(want)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(documents, none).count() == 0
    assert decontamination.contaminated(documents.where("false"), benchmark).count() == 0


def test_alignment_equals_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(0, table[i, j] + (2 if a[i] == b[j] else -1), table[i, j + 1] - 1, table[i + 1, j] - 1)
        score, first, end = decontamination.align(a, b)
        assert score == table.max()
        assert decontamination.align(a, b[first:end])[0] == score


def graded_corpus():
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(400):
        kind = rng.choice([0, 1, 2, 2])
        words = sentence(rng, 60).split() + rng.choices(["good", "fine", "clear"], k=4)
        if kind == 0:
            words += rng.choices(["vile", "nasty"], k=3)
        if kind == 1:
            words = [w + "***" for w in words]
        rng.shuffle(words)
        docs.append((i, " ".join(words), "", ""))
        labels.append((i, int(kind == 2 or kind == 0 and i % 2), int(kind == 0), kind))
    return docs, labels


def test_classifier_orders_held_out_grades(spark):
    docs, labels = graded_corpus()
    frame = spark.createDataFrame(docs + [(900, None, "", ""), (901, "", "", "")], EXTRA)
    half = spark.createDataFrame([r[:3] for r in labels[:300]] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in classifier.classify(frame, half).collect()}
    assert len(got) == 402
    right = sum(got[i]["selected"] == (kind == 2) for i, _, _, kind in labels[300:])
    assert right >= 95
    mean = [np.mean([got[i]["expected_grade"] for i, _, _, k in labels[300:] if k == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert all(0 <= r["p_good"] <= r["p_not_toxic"] <= 1 for r in got.values())
    none = classifier.classify(frame, half.where("false"))
    assert none.where("selected and expected_grade is null").count() == 402
    assert classifier.classify(frame.where("false"), half).count() == 0


def test_licences_match_whatever_the_case_and_holder(spark):
    mit = licenses.LICENSES["MIT"]
    rows = [
        (1, mit.replace("Copyright (c) <year> <holder>", "  Copyright © 2019 A. Person\n(c) 2020 Others").upper(), "", ""),
        (2, "/* " + licenses.LICENSES["BSD-3-Clause"].replace("\n", "\n * ") + " */", "", ""),
        (3, mit + " More.", "", ""), (4, None, "", ""), (5, "", "", ""), (6, "own licence  text, entire", "", ""), (6, "own licence  text, entire", "", ""),
    ]
    own = spark.createDataFrame([("Own", "Own LICENSE: text entire"), ("Void", "")], "license string, text string")
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame(rows, EXTRA), own).collect())
    assert got == [(1, "MIT"), (2, "BSD-3-Clause"), (3, None), (4, None), (5, None), (6, "Own"), (6, "Own")]


def page(i, body, host="a.example"):
    return (i, f"https://{host}/p/{i}?q#f", f"<!DOCTYPE html><html><head><title>T{i}</title><script>var x='</p>';</script></head><body>{body}</body></html>", "x")


def test_article_text_is_extracted(spark):
    nav = "<nav><ul><li><a href=/>Home</a><li>More</ul></nav><div class='ad'>Buy</div>"
    article = "<article><header><h1>A &amp; B</h1></header><p>One  <b>two</b>\n three<p>4 &lt; 5<br>six<aside>Side</aside><div class='share-bar'>Share</div></article>"
    rows = [page(1, nav + article + "<section id='comments'><p>Me too</p></section><footer>&copy; x</footer>")]
    rows += [page(10 + i, f"<div class=top>Site name</div><div class=c><p>Story {i} begins.</p><p>It ends {i}.</p></div><div class=b>Imprint</div>", "b.example") for i in range(6)]
    rows += [page(30 + i, "<article><p>Same everywhere.</p></article>", "c.example") for i in range(6)]
    rows += [page(40 + i, "<p>Same whole page.</p>", "d.example") for i in range(6)]
    rows += [(50, None, None, "x"), (51, "u", "", "x"), (52, "u", "plain &eacute; text", "x"), (None, None, "<p>a<p>b", "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    got = {r["page_id"]: r for r in htmltext.extract(frame).collect()}
    assert got[1]["text"] == "A & B\nOne two three\n4 < 5 six"
    assert all(got[10 + i]["text"] == f"Story {i} begins.\nIt ends {i}." for i in range(6))
    assert all(got[30 + i]["text"] == "Same everywhere." for i in range(6))
    assert all(got[40 + i]["text"] == "Same whole page." for i in range(6))
    assert [got[i]["text"] for i in (50, 51, 52, None)] == ["", "", "plain é text", "a\nb"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert htmltext.extract(frame.where("false")).count() == 0


def test_hosts(spark):
    urls = ["http://A.b:80/x?y", "https://c", None, "no scheme", "ftp://d#z"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(htmltext.host_of(F.col("u")).alias("h")).collect()
    assert [r["h"] for r in got] == ["a.b:80", "c", "", "no scheme", "d"]


def _families():
    """Lines of several unlike groups that share much wording, so that one band bucket holds more than one group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9)))
    common, out = [word() for _ in range(40)], []
    for _ in range(6):
        tail = [word() for _ in range(16)]
        for _ in range(14):
            ws = common + tail
            for at in rng.sample(range(len(ws)), rng.randint(1, 3)):
                ws[at] = word()
            out.append(" ".join(ws))
    return out


def test_buckets_of_several_groups_lose_no_link(spark):
    texts = _families()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["line_md5"]: r["kept_md5"] for r in lines.classes(docs).collect()}
    rows = docs.select(F.md5("text").alias("m"), lines.band_keys(F.col("text")).alias("keys"), lines.shingles(F.col("text")).alias("s")).collect()
    rows = [(r["m"], set(r["keys"]), set(r["s"])) for r in rows]
    root = {m: m for m, _, _ in rows}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for i, (m, keys, s) in enumerate(rows):
        for n, others, t in rows[:i]:
            if keys & others and len(s & t) >= lines.SIMILARITY * len(s | t):
                root[find(m)] = find(n)
    classes = lambda of: {frozenset(m for m in root if of(m) == c) for c in map(of, root)}
    want = classes(find)
    assert classes(kept.get) == want
    assert 1 < len(want) < len(rows)
