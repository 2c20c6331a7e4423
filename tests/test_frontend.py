"""Presto SQL, statements, connectors, user functions, plans as text, the runner and the command line."""

import json
import time

import pytest
from pyspark.sql import functions as F
from tessera import cli
from tessera.functions import presto, registry
from tessera.operators import explain
from tessera.operators.builder import Plan
from tessera.runner import Runner
from tessera.session import Session, load_tables
from tessera.sources import tables
from tessera.sources.connectors import FolderConnector, MemoryConnector, TpchConnector
from tessera.sql.presto import PrestoError, translate

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def session(spark):
    out = Session(spark)
    out.add("folder", FolderConnector(spark, DATA))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text", ["select", "select 1 from", "select a b c from t", "selec 1", "select 1 where (", "select 'open", "select * from t group", "select f(1"])
def test_bad_text_is_an_error(spark, text):
    with pytest.raises(PrestoError, match=r"^line 1:\d+: "):
        translate(spark, text)


def test_errors_say_where(spark):
    with pytest.raises(PrestoError, match="^line 2:6: "):
        translate(spark, "select 1\nfrom ) as t")


def test_division_keeps_whole_numbers_whole(session):
    assert rows(session.sql("select 9007199254740993 / 1, 7 / 2, -7 / 2, 7 / 2e0, (select count(*) from nation) / 10, sum(n_nationkey) / count(*) from nation"))[0] == (9007199254740993, 3, -3, 3.5, 2, 12)
    assert rows(session.sql("select transform(array[7, 8], x -> x / 2), reduce(array[7, 9], 0, (a, x) -> a + x / 2, a -> a / 2)"))[0] == ([3, 4], 3)
    with pytest.raises(Exception, match="(?i)divi"):
        session.sql("select n_nationkey / (n_nationkey - 3) from nation").collect()


def test_subscripts_fail_when_they_miss(session):
    for text in ("select array[1, 2][3]", "select map(array['a'], array[1])['b']"):
        with pytest.raises(Exception, match="(?i)not present|index|element"):
            session.sql(text).collect()
    assert rows(session.sql("select element_at(array[1, 2], 3), try(array[1, 2][3]), element_at(map(array['a'], array[1]), 'b')")) == [(None, None, None)]


def test_nulls_sort_last_in_both_directions(session):
    t = "(values 2, null, 1) as t(k)"
    assert [r[0] for r in session.sql(f"select k from {t} order by k").collect()] == [1, 2, None]
    assert [r[0] for r in session.sql(f"select k from {t} order by k desc").collect()] == [2, 1, None]
    assert [r[0] for r in session.sql(f"select k from {t} order by k desc nulls first").collect()] == [None, 2, 1]


def test_only_named_tables_are_opened(spark):
    for t in spark.catalog.listTables():
        spark.catalog.dropTempView(t.name)
    load_tables(spark, DATA, text="select * from nation join REGION on true")
    assert {t.name for t in spark.catalog.listTables() if t.isTemporary} == {"nation", "region"}


def test_statements(session):
    session.sql("drop table if exists t_stmt")
    assert rows(session.sql("create table t_stmt with (file_format = 'parquet', partitioned_by = ARRAY['r']) as select n_nationkey as k, n_regionkey as r from nation where n_nationkey < 6")) == [("CREATE TABLE: 6 rows",)]
    try:
        with pytest.raises(ValueError, match="already exists"):
            session.sql("create table t_stmt as select 1 as k")
        session.sql("create table if not exists t_stmt as select 1 as k")
        session.sql("insert into t_stmt values (50, 1), (51, 2)")
        assert rows(session.sql("update t_stmt set k = k / 2 where k >= 50")) == [("UPDATE: 2 rows",)]
        assert rows(session.sql("delete from t_stmt where k < 4 and k <> 2")) == [("DELETE: 3 rows",)]
        assert sorted(r[0] for r in session.sql("select k from t_stmt").collect()) == [2, 4, 5, 25, 25]
        session.sql("create or replace view v_stmt as select max(k) as m from t_stmt")
        assert rows(session.sql("select m from v_stmt")) == [(25,)]
        assert [r["column_name"] for r in session.sql("describe t_stmt").collect()] == ["k", "r"]
        assert "t_stmt" in [r["tableName"] for r in session.sql("show tables").collect()]
        session.sql("drop view v_stmt")
    finally:
        session.sql("drop table t_stmt")
    session.sql("set session join_limit = 5")
    assert session.variables == {"join_limit": "5"}
    with pytest.raises(PrestoError, match="GRANT"):
        session.sql("grant select on t to u")


def test_a_failed_insert_leaves_nothing(spark, session):
    session.sql("drop table if exists t_half")
    session.sql("create table t_half as select n_nationkey as k from nation")
    try:
        write = tables.WriteSession(spark, "t_half", "INSERT")
        write.write(spark.range(3).selectExpr("cast(id as int) as k"))
        write.write(spark.range(3).selectExpr("cast(raise_error('stop') as int) as k"))
        with pytest.raises(Exception, match="stop"):
            write.finish()
        assert spark.table("t_half").count() == 25
        late = tables.WriteSession(spark, "t_late", "CREATE", tables.Layout(spark.range(1).schema))
        spark.range(2).write.saveAsTable("t_late")
        late.write(spark.range(1))
        with pytest.raises(ValueError, match="already exists"):
            late.finish()
        late.abort()
        assert spark.table("t_late").count() == 2
    finally:
        for t in ("t_half", "t_late"):
            spark.sql(f"drop table if exists {t}")


def test_connectors_meet_in_one_plan(spark):
    session, memory = Session(spark), MemoryConnector(spark)
    session.add("folder", FolderConnector(spark, DATA))
    session.add("mem", memory)
    session.add("tpch", TpchConnector(spark, "/root/testdata"))
    name = tables.TableName("m", "default", "mem")
    memory.create(name, spark.createDataFrame([], "k int, s string").schema)
    with pytest.raises(ValueError, match="already exists"):
        memory.create(name, spark.createDataFrame([], "k int").schema)
    memory.append(name, spark.createDataFrame([(1, "one")], "k int, s string"))
    memory.append(name, spark.createDataFrame([(2, "two")], "k int, s string"))
    with pytest.raises(ValueError, match="columns differ"):
        memory.append(name, spark.range(1))
    text = 'select s, r_name, x.n_name from mem.default.m as m join region on r_regionkey = k join tpch."sf0.001".nation as x on x.n_nationkey = k where s <> \'one\''
    assert len(rows(session.sql(text))) == 1
    assert TpchConnector(spark, "/root/testdata").table(tables.TableName("nation", "nosuch")) is None


def test_mark_and_in_joins_scan_each_side_once(spark):
    nation, region = Plan(spark.read.parquet(f"{DATA}/nation.parquet")), Plan(spark.read.parquet(f"{DATA}/region.parquet"))
    marked = region.mark_join(nation, "r_regionkey = n_regionkey and n_nationkey > 22", "has")
    assert explain.plan_text(marked.df, "executable").count("FileScan") == 2 and "ExistenceJoin" in explain.plan_text(marked.df, "optimized")
    own = spark.createDataFrame([(1, 5)], "_row int, _key int")
    assert rows(Plan(own).mark_join(Plan(spark.range(3).toDF("id")), "id = _row", "m").df) == [(1, 5, True)]
    assert rows(Plan(own).in_join(Plan(spark.range(3).toDF("id")), "_key", "id", "m").df) == [(1, 5, False)]


def test_grouping_sets_scan_once(spark):
    plan = Plan(spark.read.parquet(f"{DATA}/lineitem.parquet")).grouping_sets([["l_returnflag"], ["l_linestatus"], ["l_returnflag"], []], ["count(*) as n", "max(l_returnflag) as m"])
    text = explain.plan_text(plan.df, "executable")
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 1
    got = rows(plan.df)
    assert sum(r[2] == 3 for r in got) == 1 and [r for r in got if r[2] == 3][0][4] == "R"
    assert sorted(r[3] for r in got if r[2] == 0) == sorted(r[3] for r in got if r[2] == 2)


def test_names_of_users_are_kept(spark):
    df = spark.createDataFrame([(1, [1, 2], 3, 4)], "_place int, a array<int>, _item int, `_peer` int")
    assert rows(Plan(df).unnest("a", names=["y"], ordinality="o").df) == [(1, [1, 2], 3, 4, 1, 1), (1, [1, 2], 3, 4, 2, 2)]


def test_explain(session):
    df = session.sql("select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name")
    assert explain.skeleton(df).split("\n")[0] == "Aggregate" and "  Join" in explain.skeleton(df)
    assert explain.summary(df).startswith("output: r_name:string, n:bigint") and "Join: 1" in explain.summary(df)
    assert "Statistics(" in session.sql("explain (type cost) select 1 from nation").first()["plan"]
    measured = session.sql("explain analyze select r_name, count(*) from nation join region on n_regionkey = r_regionkey group by r_name").first()["plan"]
    assert "numOutputRows=25" in measured and "Join" in measured
    with pytest.raises(ValueError, match="no such plan"):
        explain.plan_text(df, "nosuch")


def test_filters_and_columns_reach_the_scan(session):
    text = explain.plan_text(session.sql("select l_orderkey from lineitem where l_quantity < 10 and l_quantity > 2"), "executable")
    assert "GreaterThan(l_quantity,2" in text and "LessThan(l_quantity,10" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_random_filters_are_not_merged(session):
    text = explain.plan_text(session.sql("select k from (select n_nationkey as k from nation where rand() < 0.5e0) t where k > 3"), "optimized")
    assert "rand(" in text and text.index("rand(") < len(text)


def test_nested_aggregates_are_rejected(session):
    with pytest.raises(Exception, match="(?i)nested|aggregate"):
        session.sql("select sum(count(n_nationkey)) from nation").collect()


def test_user_functions_and_metadata(spark, session):
    paths = registry.Metadata(paths={"a": 0, "b": 1}, explode=True)
    registry.register_rewrite("pair_of", "named_struct('a', {0}, 'b', {1})", paths)
    assert rows(session.sql("select pair_of(n_nationkey, n_name).a as a from nation where n_nationkey = 3")) == [(3,)]
    assert registry.exploded("f", paths, ["x", "y"], ["b"]) == ["f(null, y).b AS b"]
    registry.register_simple(spark, "t_draw", lambda x: x, "long", registry.Metadata(deterministic=False))
    assert "t_draw" in explain.plan_text(session.sql("select t_draw(n_nationkey) as d from nation"), "logical")


def test_runner(spark):
    run = Runner(spark.range(25, numPartitions=3), batch=10)
    sizes = []
    while (batch := run.next()) is not None:
        sizes.append(len(batch))
    assert sizes == [10, 10, 5] and run.state == "finished" and run.stats()["rows"] == 25 and run.stats()["jobs"] >= 1
    bad = Runner(spark.range(5).select(F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        bad.wait()
    assert bad.state == "failed" and bad.next() is None
    slow = Runner(spark.range(10**12).where("id < 0"))
    thread = slow.start()
    time.sleep(2)
    slow.abort()
    thread.join(30)
    assert not thread.is_alive() and slow.state == "aborted"


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["--data", DATA, "--query", "select count(*) as n from nation; select 'a;b' as s"]) == 0
    assert capsys.readouterr().out == "n\n25\ns\na;b\n"
    golden = str(tmp_path / "golden.json")
    text = "select r_name from region order by 1; select nosuch from region"
    assert cli.main(["--data", DATA, "--query", text, "--record", golden]) == 0
    kept = json.loads(open(golden).read())
    assert len(kept[0]["rows"]) == 5 and "Sort" in kept[0]["plan"] and kept[1]["error"] == "AnalysisException"
    assert cli.main(["--data", DATA, "--check", golden]) == 0
    kept[0]["rows"][0] = ["X"]
    open(golden, "w").write(json.dumps(kept))
    assert cli.main(["--data", DATA, "--check", golden]) == 1
    history = tmp_path / "history.sql"
    assert cli.main(["--data", DATA, "--query", f"select 1 as x; savehistory {history}; clearhistory"]) == 0
    assert history.read_text() == "select 1 as x;\n"
    assert cli.main(["--data", DATA, "--query", "selec 1"]) == 1


def test_histogram_and_divide(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", None)], "k string, v int")
    assert rows(presto.histogram(df, ["k"], "v")) == [("a", {1: 2, 2: 1})]
    assert spark.range(1).select(presto.divide(F.lit(9007199254740993), F.lit(1), True)).first()[0] == 9007199254740993
    with pytest.raises(ValueError, match="no field"):
        presto.dereference(spark.range(1).select(F.struct("id").alias("s")), "s", 1)
