"""Intermediate tables live as long as a plan can read them."""

import os

from tessera.llm import scratch


def test_tables_go_only_when_no_plan_reads_them(spark):
    table = scratch.materialize(spark.range(50), "lifetime")
    path = table._scratch_path
    derived = table.where("id > 5")
    del table
    scratch.settle(spark)
    assert os.path.isdir(path) and derived.count() == 44
    del derived
    for _ in range(5):
        scratch.settle(spark)
        spark.range(1).count()
    assert not os.path.isdir(path)


def test_discarded_tables_are_not_looked_at_again(spark):
    table = scratch.materialize(spark.range(5), "discarded")
    scratch.discard(table)
    assert not os.path.isdir(table._scratch_path)
    del table
    scratch.settle(spark)
