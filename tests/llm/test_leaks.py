"""Items that leak into many documents."""

import random

from tessera.llm import decontamination


def test_items_in_many_documents_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 8)))
    items = [(n, " ".join(word() for _ in range(n))) for n in (3, 4, 5, 14)]
    docs, want = [], set()
    for i in range(3000):
        n, text = items[i % 4]
        own = text.split()
        if n == 14 and i % 8 == 7:
            for at in (3, 7, 11):
                own[at] = word()
        words = [word() for _ in range(30)]
        words[10:10] = own
        docs.append((i, " ".join(words)))
        want.add((i, n))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontamination.contaminated(documents, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["first_word"] == 10 for r in got)


def _brute(item, text):
    """The best local alignment score of two word lists, by the whole table."""
    best, row = 0, [0] * (len(text) + 1)
    for w in item:
        last, row = row, [0]
        for j, x in enumerate(text):
            row.append(max(0, last[j] + (2 if w == x else -1), last[j + 1] - 1, row[j] - 1))
        best = max(best, max(row))
    return best


def test_found_items_equal_a_whole_alignment_of_everything(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 7))) for _ in range(400)]
    words = lambda n: rng.choices(vocabulary, k=n)
    items = [(i, words(n)) for i, n in enumerate([3, 4, 5, 8, 12, 20, 30, 30, 60])]
    docs = []
    for i in range(240):
        text = words(rng.randint(0, 120))
        if i % 2:
            own = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, len(own) // 3))):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text[len(text) // 2 : len(text) // 2] = own
        docs.append((i, text))
    want = {(d, i) for d, text in docs for i, own in items if _brute(own, text) >= 2 * max(0.5 * len(own), min(len(own), 8))}
    got = decontamination.contaminated(
        spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    )
    got = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert got <= want and len(got) >= 0.95 * len(want) > 80


def test_items_of_few_words_repeats_and_long_texts(spark):
    long = "same " * 200_000
    docs = spark.createDataFrame([(1, long, "x", 1), (1, long, "x", 1), (2, "", "y", 2), (None, "five words are an item", "z", 3), (3, None, None, None)], "doc_id long, text string, item_id string, similarity int")
    items = spark.createDataFrame([(7, "five words are an item"), (8, "five words are an item"), (9, "two words"), (10, None), (11, ""), (12, "same " * 200)], "item_id long, text string")
    got = decontamination.contaminated(docs, items, block=1).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["similarity"]) for r in got) == [(0, 7, 1.0), (0, 8, 1.0), (1, 12, 1.0), (1, 12, 1.0)]
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0 == decontamination.contaminated(docs.limit(0), items).count()
