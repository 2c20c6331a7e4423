"""Tables that grow with the corpus do not go through the driver, at Spark's own threshold of broadcasts."""

import random

import corpus_pipeline
from tessera.llm import components, scratch, simhash

DATA = "/root/testdata/sf0.001"


def plans_of(monkeypatch):
    """Name and plan, as it stands before it runs, of each table written from here on."""
    plans = []

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return scratch.materialize(df, name)

    monkeypatch.setattr(simhash, "materialize", noted)
    monkeypatch.setattr(components, "materialize", noted)
    return plans


def sent(plans, *names):
    assert {x for x, _ in plans} >= set(names)
    return [x for x, plan in plans if x in names and "BroadcastExchange" in plan]


def near_prints(n):
    rng = random.Random(5)
    own = [rng.getrandbits(64) for _ in range(n)]
    flips = [x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in own for _ in range(3)]
    return sorted({x - (x >> 63 << 64) for x in own + flips})


def test_keys_and_labels_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    plans, prints = plans_of(monkeypatch), near_prints(60)
    got = {r["node"]: r["component"] for r in simhash.linked_prints(spark.createDataFrame([(x,) for x in prints], "fp long")).collect()}
    root = {x: x for x in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if ((a ^ b) & 2**64 - 1).bit_count() <= 3:
                root[find(a)] = find(b)
    assert {frozenset(y for y in got if got[y] == c) for c in got.values()} == {s for s in (frozenset(y for y in prints if find(y) == x) for x in prints) if len(s) > 1}
    assert sent(plans, "members", "named", "first", "linked") == []


def test_near_dedup_of_the_pipeline_broadcasts_no_keys(spark, monkeypatch):
    plans = plans_of(monkeypatch)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 0 < corpus_pipeline.near_dedup(spark, docs, DATA).count() < docs.count()
    assert sent(plans, "members", "named", "first") == []


def test_no_step_of_near_dedup_broadcasts(spark, monkeypatch):
    plans = plans_of(monkeypatch)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.union(docs.limit(5))
    kept = corpus_pipeline.near_dedup(spark, docs, DATA)
    plans.append(("kept", kept._jdf.queryExecution().executedPlan().toString()))
    assert sent(plans, "fingerprints", "nodes", "cross", "linked", "classes", "kept") == []
