"""Table names, creation with a layout, and writes that show only once finished."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableName:
    """table, schema.table or catalog.schema.table."""

    table: str
    schema: str = "default"
    catalog: str | None = None

    @staticmethod
    def parse(text: str, default: str = "default") -> TableName:
        parts = text.split(".")
        if not 1 <= len(parts) <= 3 or not all(parts):
            raise ValueError(f"Invalid table name: {text!r}")
        return TableName(parts[-1], parts[-2] if len(parts) > 1 else default, parts[0] if len(parts) == 3 else None)


def scale_of(schema: str) -> float | None:
    """The scale factor that a generated schema names: tiny is 0.01, sf1 is 1; None for no such schema."""
    if schema == "tiny":
        return 0.01
    m = re.fullmatch(r"sf(\d+(?:\.\d+)?)", schema)
    return float(m[1]) if m and float(m[1]) > 0 else None


@dataclass
class Layout:
    """Checked options of a new table; partition columns must be the last ones."""

    schema: T.StructType
    options: dict[str, object] = field(default_factory=dict)

    def __post_init__(self):
        known = {"bucketed_by", "bucket_count", "sorted_by", "partitioned_by", "file_format", "compression_kind"}
        if odd := set(self.options) - known:
            raise ValueError(f"Unknown table option: {sorted(odd)[0]}")
        names = self.schema.names
        for key in ("bucketed_by", "sorted_by", "partitioned_by"):
            if missing := set(self.list(key)) - set(names):
                raise ValueError(f"{key}: no such column: {sorted(missing)[0]}")
        if parts := self.list("partitioned_by"):
            if names[-len(parts) :] != parts:
                raise ValueError("Partition columns must be the last ones")
        n = self.options.get("bucket_count")
        if bool(self.list("bucketed_by")) != bool(n):
            raise ValueError("bucketed_by and bucket_count go together")
        if n and (n <= 0 or n & (n - 1)):
            raise ValueError("bucket_count must be a power of two")

    def list(self, key: str) -> list[str]:
        return list(self.options.get(key) or [])


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


class WriteSession:
    """begin, finish, abort: CREATE holds its frames and becomes visible at finish; INSERT appends in one commit."""

    def __init__(self, spark: SparkSession, name: str, kind: str, layout: Layout | None = None):
        if kind not in ("CREATE", "INSERT"):
            raise ValueError(f"Only CREATE/INSERT supported, not {kind}")
        if kind == "CREATE" and exists(spark, name):
            raise ValueError(f"Table {name} already exists")
        if kind == "INSERT" and not exists(spark, name):
            raise ValueError(f"Table {name} does not exist")
        self.spark, self.name, self.kind, self.layout, self.frames, self.made = spark, name, kind, layout, [], False

    def write(self, df: DataFrame) -> None:
        self.frames.append(df)

    def _writer(self, df: DataFrame, layout: Layout):
        out = df.write.format(layout.options.get("file_format", "parquet")).option("compression", layout.options.get("compression_kind", "zstd"))
        if layout.list("partitioned_by"):
            out = out.partitionBy(*layout.list("partitioned_by"))
        if layout.list("bucketed_by"):
            out = out.bucketBy(layout.options["bucket_count"], *layout.list("bucketed_by"))
            if layout.list("sorted_by"):
                out = out.sortBy(*layout.list("sorted_by"))
        return out

    def finish(self) -> DataFrame:
        if self.kind == "INSERT":
            columns = self.spark.table(self.name).columns
            if self.frames:
                reduce(DataFrame.union, [df.select(*columns) for df in self.frames]).write.insertInto(self.name)
            return self.spark.table(self.name)
        rows = self.frames or [self.spark.createDataFrame([], self.layout.schema)]
        whole = rows[0]
        for df in rows[1:]:
            whole = whole.unionByName(df)
        whole = whole.select(*[whole[f.name].cast(f.dataType) for f in self.layout.schema])
        if exists(self.spark, self.name):
            raise ValueError(f"Table {self.name} already exists")
        self.made = True
        try:
            self._writer(whole, self.layout).saveAsTable(self.name)
        except Exception as e:
            self.made = "TABLE_OR_VIEW_ALREADY_EXISTS" not in str(e)  # another session's table of that name stays
            self.abort()
            raise
        return self.spark.table(self.name)

    def abort(self) -> None:
        """Forgets the frames; drops the table if this session made it."""
        self.frames = []
        if self.kind == "CREATE" and self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
            self.made = False


def create_table(spark: SparkSession, name: str, df: DataFrame, options: dict | None = None) -> DataFrame:
    session = WriteSession(spark, name, "CREATE", Layout(df.schema, options or {}))
    session.write(df)
    return session.finish()


def _replace(spark: SparkSession, name: str, rows: DataFrame) -> None:
    """The table's rows become rows, which may be read from the table: they are written beside it first."""
    copy = f"{name}_{uuid.uuid4().hex}"
    rows.write.format("parquet").saveAsTable(copy)
    try:
        spark.table(copy).select(*spark.table(name).columns).write.mode("overwrite").option("partitionOverwriteMode", "static").insertInto(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {copy}")


def delete(spark: SparkSession, name: str, condition: str = "true") -> int:
    """Takes out the rows for which the condition is true and gives their number."""
    table = spark.table(name)
    gone = table.where(condition).count()
    if gone:
        _replace(spark, name, table.where(f"NOT coalesce({condition}, false)"))
    return gone


def update(spark: SparkSession, name: str, values: dict[str, str], condition: str = "true") -> int:
    """Sets columns where the condition is true and gives the number of rows."""
    table = spark.table(name)
    hit = table.where(condition).count()
    if hit:
        new = [F.expr(f"CASE WHEN {condition} THEN {values[f.name]} ELSE `{f.name}` END").cast(f.dataType).alias(f.name) if f.name in values else F.col(f.name) for f in table.schema]
        _replace(spark, name, table.select(*new))
    return hit


def read_layout(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A folder of files, k=v folders below it being partition columns; the widest schema wins and hidden files are skipped."""
    reader = spark.read.format(fmt).option("basePath", path)
    return (reader.option("mergeSchema", "true") if fmt in ("parquet", "orc") else reader).load(path)
