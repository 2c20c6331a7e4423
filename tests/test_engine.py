"""The plan builder, function semantics, tables and statistics; the catalogue against DuckDB."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from tessera.functions import presto
from tessera.operators.builder import Plan, sort_key
from tessera.plans import catalogue
from tessera.session import TABLES, configure
from tessera.sources import statistics, tables
from tessera.streaming import windows

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_duckdb(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    got = con.execute(catalogue.ORACLE[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(repr(tuple(dict(zip(columns, r, strict=True))[c] for c in order)) for r in got.fetchall())
    assert sorted(repr(tuple(r[c] for c in order)) for r in df.collect()) == want


@pytest.mark.parametrize("conf", [("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "1")])
def test_results_do_not_depend_on_the_physical_plan(spark, conf):
    names = ["join_full", "join_anti_not_in", "agg_cube", "tpch_q5", "win_groups_frame", "unnest_zip_pad"]
    want = {n: sorted(map(repr, catalogue.QUERIES[n](spark, DATA).collect())) for n in names}
    old = spark.conf.get(conf[0])
    spark.conf.set(*conf)
    try:
        assert {n: sorted(map(repr, catalogue.QUERIES[n](spark, DATA).collect())) for n in names} == want
    finally:
        spark.conf.set(conf[0], old)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_sort_keys_put_nulls_last_unless_asked(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "k int")
    assert [r["k"] for r in Plan(df).sort("k").build().collect()] == [1, 3, None]
    assert [r["k"] for r in Plan(df).sort("k desc").build().collect()] == [3, 1, None]
    assert [r["k"] for r in Plan(df).sort("k desc nulls first").build().collect()] == [None, 3, 1]
    assert [r["k"] for r in Plan(df).sort(sort_key("k asc nulls first")).build().collect()] == [None, 1, 3]


def test_stacked_limits(spark):
    df = Plan(spark.range(30).toDF("k")).sort("k")
    ids = lambda p: [r["k"] for r in p.build().collect()]
    assert ids(df.limit(10).limit(5)) == list(range(5))
    assert ids(df.limit(10).limit(15)) == list(range(10))
    assert ids(df.limit(10).offset(7).limit(5)) == [7, 8, 9]
    assert ids(df.limit(0)) == [] and ids(df.offset(2**63 - 6)) == []


def test_division(spark):
    whole = one(spark, presto.divide(F.lit(15), F.lit(4), True).alias("a"), presto.divide(F.lit(-7), F.lit(2), True).alias("b"))
    assert (whole["a"], whole["b"]) == (3, -3)
    part = one(spark, *[presto.divide(F.lit(x), F.lit(0.0), False).alias(n) for n, x in (("p", 1.0), ("n", -1.0), ("z", 0.0))])
    assert part["p"] == math.inf and part["n"] == -math.inf and math.isnan(part["z"])
    with pytest.raises(Exception, match="(?i)divi"):
        one(spark, presto.divide(F.lit(1), F.lit(0), True).alias("x"))


def test_subscripts(spark):
    array, mapping = F.array(F.lit(5), F.lit(6)), F.create_map(F.lit("a"), F.lit(1))
    assert one(spark, presto.element_at(array, 9).alias("x"))["x"] is None
    assert one(spark, presto.subscript(mapping, "a", True).alias("x"))["x"] == 1
    for bad in (presto.subscript(array, 3), presto.subscript(mapping, "b", True)):
        with pytest.raises(Exception, match="(?i)not present|out of bounds|index"):
            one(spark, bad.alias("x"))


def test_array_agg_keeps_nulls_and_order(spark):
    df = spark.createDataFrame([(1, 3), (None, 2), (5, None)], "v int, k int")
    row = df.agg(presto.array_agg(F.col("v")).alias("a"), presto.array_agg_ordered(F.col("v"), (F.col("k"), True)).alias("o"), presto.array_agg_ordered(F.col("v"), (F.col("k"), False), where=F.col("v") > 1).alias("w")).first()
    assert sorted(row["a"], key=str) == [1, 5, None]
    assert row["o"] == [1, None, 5] and row["w"] == [5]


def test_set_operations_want_equal_types(spark):
    with pytest.raises(ValueError, match="types differ"):
        Plan(spark.range(1)).union(Plan(spark.range(1).selectExpr("cast(id as int)")))


@pytest.fixture
def warehouse(spark):
    names = ["t_made", "t_bad"]
    yield
    for n in names:
        spark.sql(f"drop table if exists {n}")


def test_create_insert_and_abort(spark, warehouse):
    df = spark.range(64).selectExpr("id as key1", "cast(id % 10 as int) as key2", "id + 2 as data", "'2022-09-01' as ds")
    options = {"bucketed_by": ["key1"], "bucket_count": 4, "sorted_by": ["key1", "key2"], "partitioned_by": ["ds"], "compression_kind": "zstd"}
    assert tables.create_table(spark, "t_made", df, options).count() == 64
    with pytest.raises(ValueError, match="already exists"):
        tables.create_table(spark, "t_made", df)
    insert = tables.WriteSession(spark, "t_made", "INSERT")
    insert.write(df.withColumn("ds", F.lit("2022-09-02")))
    assert insert.finish().where("ds = '2022-09-02'").count() == 64
    aborted = tables.WriteSession(spark, "t_bad", "CREATE", tables.Layout(df.schema))
    aborted.write(df)
    aborted.abort()
    assert not tables.exists(spark, "t_bad")
    with pytest.raises(ValueError, match="Only CREATE/INSERT supported, not UPDATE"):
        tables.WriteSession(spark, "t_made", "UPDATE")


@pytest.mark.parametrize("options", [{"odd": 1}, {"bucketed_by": ["id"]}, {"bucketed_by": ["id"], "bucket_count": 3}, {"partitioned_by": ["id"]}, {"sorted_by": ["zz"]}])
def test_bad_layouts(spark, options):
    with pytest.raises(ValueError):
        tables.Layout(spark.range(1).selectExpr("id", "1 as x").schema, options)


def test_names_and_schemas():
    assert tables.TableName.parse("a.b.c") == tables.TableName("c", "b", "a")
    assert tables.TableName.parse("t") == tables.TableName("t")
    with pytest.raises(ValueError):
        tables.TableName.parse("a..b")
    assert [tables.scale_of(s) for s in ("tiny", "sf1", "sf0.1", "invalidschema", "sflarge", "sf000")] == [0.01, 1.0, 0.1, None, None, None]


def test_layout_reader_and_statistics(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "id % 2 as p").write.partitionBy("p").parquet(path)
    assert tables.read_layout(spark, path).where("p = 1").count() == 5
    rows = {r["column"]: r for r in statistics.column_stats(spark.range(100).selectExpr("id", "if(id < 10, null, 'ab') as s")).collect()}
    assert rows["id"]["rows"] == 100 and rows["s"]["nulls"] == 10 and rows["s"]["max_length"] == 2
    assert statistics.sample_selectivity(spark.range(1000), "id < 500", 100) == (1000, 500)
    assert statistics.estimate_distinct(1000, 10, 100000) == 10
    assert statistics.estimate_distinct(1000, 900, 100000, 0, 4999) == 5000
    assert statistics.order_shares(spark.range(0, 50, 1, 1), "id", "id").first()["ascending"] == 1.0


def test_windows_on_a_stream(spark, tmp_path):
    configure(spark)
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.tumbling(stream, "1 day", ["event_type"]).writeStream.format("memory").queryName("daily").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = windows.tumbling(events, "1 day", ["event_type"])
    got = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert got(spark.table("daily")) == got(batch)
    assert windows.sessions(events, "1 hour", "user_id").agg(F.sum("n")).first()[0] == 1000
