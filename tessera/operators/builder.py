"""A fluent plan builder over DataFrames: each call resolves at once and adds one node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INT_MAX = 2**31 - 1


def column(x) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def sort_key(x) -> Column:
    """"c", "c desc", "c desc nulls first": nulls come last unless asked first, whatever the direction."""
    if isinstance(x, Column):
        return x
    text = " ".join(x.split())
    low = text.lower()
    first = low.endswith(" nulls first")
    for tail in (" nulls first", " nulls last"):
        text = text[: -len(tail)] if text.lower().endswith(tail) else text
    down = text.lower().endswith(" desc")
    for tail in (" desc", " asc"):
        text = text[: -len(tail)] if text.lower().endswith(tail) else text
    key = F.expr(text)
    return (key.desc_nulls_first() if first else key.desc_nulls_last()) if down else (key.asc_nulls_first() if first else key.asc_nulls_last())


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


class Plan:
    """An immutable chain over one DataFrame; build() gives the DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def values(spark: SparkSession, rows: list, schema: str) -> Plan:
        return Plan(spark.createDataFrame(rows, schema, verifySchema=True))

    @staticmethod
    def scan(spark: SparkSession, table: str, columns: list[str] | None = None) -> Plan:
        df = spark.table(table)
        return Plan(df.select(*columns) if columns else df)

    @staticmethod
    def from_(spark: SparkSession, tables: list[str]) -> Plan:
        """The product of tables; a filter's equalities turn it into joins."""
        return Plan(reduce(DataFrame.crossJoin, [spark.table(t).alias(t.split(".")[-1]) for t in tables]))

    def filter(self, condition) -> Plan:
        return Plan(self.df.where(column(condition)))

    def project(self, *exprs) -> Plan:
        return Plan(self.df.select(*map(column, exprs)))

    def with_(self, *exprs) -> Plan:
        return Plan(self.df.select("*", *map(column, exprs)))

    def as_(self, alias: str, columns: list[str] | None = None) -> Plan:
        return Plan((self.df.toDF(*columns) if columns else self.df).alias(alias))

    def aggregate(self, keys: list, aggregates: list) -> Plan:
        if not keys and not aggregates:
            raise ValueError("an aggregate needs keys or aggregate calls")
        grouped = self.df.groupBy(*map(column, keys))
        return Plan(grouped.agg(*map(column, aggregates)) if aggregates else self.df.select(*map(column, keys)).distinct())

    def grouping_sets(self, sets: list[list[str]], aggregates: list, index: str = "set_index") -> Plan:
        """Keys, aggregates and the number of the set; a set may be given twice. One scan and one shuffle for all sets.

        Each row is expanded to one for each set, with the keys that are not of the set null; aggregates see the columns as
        they were. No rows give no groups, not even for the empty set.
        """
        keys, e = list(dict.fromkeys(k for s in sets for k in s)), free_name(self.df, "_set")
        types = {f.name: f.dataType for f in self.df.schema}
        expanded = [F.struct(F.lit(i).cast("long").alias("i"), *[(F.col(k) if k in s else F.lit(None).cast(types[k])).alias(f"k{n}") for n, k in enumerate(keys)]) for i, s in enumerate(sets)]
        rows = self.df.select("*", F.explode(F.array(*expanded)).alias(e))
        out = rows.groupBy(F.col(f"{e}.i").alias(index), *[F.col(f"{e}.k{n}") for n in range(len(keys))]).agg(*map(column, aggregates))
        values = out.columns[1 + len(keys) :]
        return Plan(out.toDF(index, *keys, *values).select(*keys, index, *values))

    def distinct(self) -> Plan:
        return Plan(self.df.distinct())

    def join(self, other: Plan, condition=None, how: str = "inner", using: list[str] | None = None) -> Plan:
        if using:
            return Plan(self.df.join(other.df, using, how))
        return self.cross_join(other) if condition is None else Plan(self.df.join(other.df, column(condition), how))

    def cross_join(self, other: Plan) -> Plan:
        return Plan(self.df.crossJoin(other.df))

    def mark_join(self, other: Plan, condition: str, mark: str) -> Plan:
        """All rows with whether a match exists; in the condition a name is the other side's if both have it."""
        return Plan(self.df.sparkSession.sql(f"SELECT *, EXISTS (SELECT 1 FROM {{other}} WHERE {condition}) AS `{mark}` FROM {{rows}}", other=other.df, rows=self.df))

    def in_join(self, other: Plan, key: str, other_key: str, mark: str) -> Plan:
        """All rows with key IN (other's other_key): null where only a null could match."""
        k, o = free_name(self.df, "_key"), free_name(other.df, "_of")
        left = self.df.withColumn(k, F.expr(key))
        right = other.df.select(F.expr(other_key).alias(o))
        facts = right.agg(F.count("*").alias("n"), F.count(o).alias("m")).select((F.col("n") > 0).alias("_any"), (F.col("n") > F.col("m")).alias("_null"))
        text = (
            f"SELECT r.* EXCEPT ({k}), CASE WHEN EXISTS (SELECT 1 FROM {{right}} WHERE {o} = {k}) THEN true WHEN f._any AND (f._null OR {k} IS NULL) THEN null ELSE false END AS `{mark}` "
            "FROM {left} AS r CROSS JOIN {facts} AS f"
        )
        return Plan(self.df.sparkSession.sql(text, right=right, left=left, facts=facts))

    def window(self, function, name: str, partition: list | None = None, order: list | None = None, frame: tuple | None = None, ignore_nulls: bool = False) -> Plan:
        """function OVER (PARTITION BY .. ORDER BY ..): nulls come last; frame is ("rows" | "range", first, last), None unbounded."""
        w = Window.partitionBy(*map(column, partition or [])).orderBy(*map(sort_key, order or []))
        if frame:
            lo, hi = (Window.unboundedPreceding if frame[1] is None else frame[1]), (Window.unboundedFollowing if frame[2] is None else frame[2])
            w = w.rowsBetween(lo, hi) if frame[0] == "rows" else w.rangeBetween(lo, hi)
        if ignore_nulls:
            function = F.call_function(function.split("(")[0].strip(), F.expr(function.split("(", 1)[1].rsplit(")", 1)[0]), F.lit(True))
        return Plan(self.df.withColumn(name, column(function).over(w)))

    def scalar(self) -> Column:
        """The one value of this plan, as an expression of another plan; more rows are an error, none is null."""
        return self.df.scalar()

    def exists(self) -> Column:
        """Whether this plan has rows, as an expression of another plan."""
        return self.df.exists()

    def flatten_rows(self, rows: str, names: list[str] | None = None) -> Plan:
        """An array of rows as a column for each field; empty and null arrays give no rows."""
        fields = self.df.select(column(rows).alias("r")).schema[0].dataType.elementType.names
        e = free_name(self.df, "_row")
        wide = self.df.select("*", F.explode(column(rows)).alias(e))
        return Plan(wide.select(*[F.col(f"`{c}`") for c in self.df.columns], *[F.col(f"{e}.`{f}`").alias(n) for f, n in zip(fields, names or fields, strict=True)]))

    def unnest(self, *collections: str, names: list[str], ordinality: str | None = None, outer: bool = False) -> Plan:
        """Arrays (one name each) and maps (two names) side by side, padded with null to the longest; empty rows go unless outer."""
        o, e = free_name(self.df, "_place"), free_name(self.df, "_item")
        types = dict(self.df.select(*[column(c).alias(f"c{i}") for i, c in enumerate(collections)]).dtypes)
        parts, picks, left = [], [], list(names)
        for i, c in enumerate(collections):
            is_map = types[f"c{i}"].startswith("map")
            parts.append((F.map_entries(column(c)) if is_map else column(c)).alias(f"c{i}"))
            item = F.col(f"{e}.c{i}")
            picks += [item["key"].alias(left.pop(0)), item["value"].alias(left.pop(0))] if is_map else [item.alias(left.pop(0))]
        empty = [F.coalesce(p, F.array().cast(self.df.select(p).schema[0].dataType)).alias(f"c{i}") for i, p in enumerate(parts)]
        explode = F.posexplode_outer if outer else F.posexplode
        rows = self.df.select("*", explode(F.arrays_zip(*empty)).alias(o, e))
        extra = [(F.col(o) + 1).cast("long").alias(ordinality)] if ordinality else []
        return Plan(rows.select(*[F.col(f"`{c}`") for c in self.df.columns], *picks, *extra))

    def union_all(self, *others: Plan) -> Plan:
        return self.set_operation("union all", *others)

    def union(self, *others: Plan) -> Plan:
        return self.set_operation("union", *others)

    def intersect(self, *others: Plan) -> Plan:
        return self.set_operation("intersect", *others)

    def except_(self, *others: Plan) -> Plan:
        return self.set_operation("except", *others)

    def set_operation(self, kind: str, *others: Plan) -> Plan:
        for o in others:
            if [t for _, t in o.df.dtypes] != [t for _, t in self.df.dtypes]:
                raise ValueError(f"{kind}: column types differ: {self.df.dtypes} and {o.df.dtypes}")
        how = {
            "union all": DataFrame.union, "union": DataFrame.union, "intersect": DataFrame.intersect, "except": DataFrame.subtract,
            "intersect all": DataFrame.intersectAll, "except all": DataFrame.exceptAll,
        }[kind]
        out = reduce(how, [o.df for o in others], self.df)
        return Plan(out.distinct() if kind == "union" else out)

    def sort(self, *keys) -> Plan:
        return Plan(self.df.orderBy(*map(sort_key, keys)))

    def limit(self, count: int, offset: int = 0) -> Plan:
        return Plan((self.offset(offset).df if offset else self.df).limit(min(count, INT_MAX)))

    def offset(self, n: int) -> Plan:
        """Spark counts offsets in 32 bits; no table is skipped by more."""
        return Plan(self.df.limit(0) if n > INT_MAX else self.df.offset(n))

    def sample(self, percent: float, seed: int = 0) -> Plan:
        return Plan(self.df.sample(percent / 100, seed))

    def write(self, table: str, kind: str = "insert", columns: list[str] | None = None, exprs: list | None = None, options: dict | None = None) -> None:
        """create, insert or overwrite: columns of the table and as many expressions over this plan; columns left out are null."""
        from tessera.sources import tables

        rows = self.df.select(*[column(e).alias(c) for c, e in zip(columns, exprs or columns, strict=True)]) if columns else self.df
        if kind == "create":
            tables.create_table(rows.sparkSession, table, rows, options)
            return
        if kind not in ("insert", "overwrite"):
            raise ValueError(f"no such write: {kind}")
        target = rows.sparkSession.table(table).schema
        if columns:
            rows = rows.select(*[(F.col(f"`{f.name}`") if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target])
        rows.write.insertInto(table, overwrite=kind == "overwrite")

    def explain(self, kind: str = "executable", run: bool = False) -> str:
        """The plan as text: logical, optimized, executable or cost; run: with what a run measured."""
        from .explain import explain

        return explain(self.df, kind, run).first()["plan"]

    def build(self) -> DataFrame:
        return self.df
