"""What a runner's wait() sends to the driver, and that it does the whole job."""

import pytest
from pyspark.sql import functions as F
from tessera.runner import Runner


def sent(spark, run):
    """Bytes that the tasks of a runner's stages sent to the driver."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(run.group) for s in tracker.getJobInfo(j).stageIds}
    return sum(context.statusStore().lastStageAttempt(s).resultSize() for s in stages)


def test_wait_sends_counts_only(spark):
    sizes = []
    for n in (20_000, 200_000):
        run = Runner(spark.range(0, n, 1, 4).select("id", F.repeat(F.lit("x"), 20)), batch=500)
        assert run.wait() == n and run.state == "finished" and run.next() is None
        assert run.stats()["rows"] == n and run.stats()["jobs"] >= 1 and run.stats()["seconds"] > 0
        sizes.append(sent(spark, run))
    assert 0 < sizes[1] < 100_000 and sizes[1] < 1.5 * sizes[0]


def test_wait_computes_every_column_of_every_row(spark):
    late = F.when(F.col("id") == 1998, F.raise_error(F.lit("late"))).otherwise("x")
    run = Runner(spark.range(0, 2000, 1, 3).select("id", late.alias("s")), batch=7)
    with pytest.raises(Exception, match="late"):
        run.wait()
    assert run.state == "failed" and run.next() is None and run.wait() == run.stats()["rows"] < 2000


@pytest.mark.parametrize("text, n", [("select id, id as id from range(1203)", 1203), ("select id from range(7) where id < 0", 0), ("select map(id, null), named_struct('a', id, 'a', id) from range(7)", 7), ("select id as `a.b`, null as `` from range(7) order by 1 limit 5", 5)])
def test_wait_counts_odd_rows(spark, text, n):
    assert Runner(spark.sql(text), batch=2).wait() == n


def test_wait_counts_rows_without_columns(spark):
    assert Runner(spark.range(9).select()).wait() == 9


def test_wait_goes_on_after_next(spark):
    run = Runner(spark.range(25, numPartitions=3), batch=10)
    assert len(run.next()) == 10 and run.wait() == 25 and run.stats()["rows"] == 25


def test_abort_before_the_job_of_wait_starts(spark):
    run = Runner(spark.range(10**12).where("id < 0"))
    tagged = run._tagged
    run._tagged = lambda work: (run.abort(), tagged(work))
    thread = run.start()
    thread.join(30)
    assert not thread.is_alive() and run.state == "aborted"
