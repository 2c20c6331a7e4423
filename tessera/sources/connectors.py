"""Connectors: where tables of a plan come from, several of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import TableName, read_layout, scale_of


class MemoryConnector:
    """Append-only tables in memory, for tests and small inputs; filters are applied above the scan, never inside it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.parts, self.schemas = spark, {}, {}

    def create(self, name: TableName, schema: T.StructType) -> None:
        key = (name.schema, name.table)
        if key in self.schemas:
            raise ValueError(f"Table {name.table} already exists")
        self.schemas[key], self.parts[key] = schema, []

    def append(self, name: TableName, rows: DataFrame) -> None:
        """Rows are taken in now; later changes of their source are not seen."""
        key = (name.schema, name.table)
        schema = self.schemas[key]
        if [f.dataType for f in rows.schema] != [f.dataType for f in schema]:
            raise ValueError(f"columns differ: {rows.schema.simpleString()} and {schema.simpleString()}")
        self.parts[key].append(self.spark.createDataFrame(rows.toArrow()).toDF(*schema.names))

    def table(self, name: TableName) -> DataFrame | None:
        key = (name.schema, name.table)
        if key not in self.schemas:
            return None
        out = self.spark.createDataFrame([], self.schemas[key])
        for part in self.parts[key]:
            out = out.union(part)
        return out


class FolderConnector:
    """A folder of tables: <root>/<schema>/<table> or, for schema default, <root>/<table>, a folder or a .parquet file."""

    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt

    def path(self, name: TableName) -> str | None:
        base = self.root if name.schema == "default" else f"{self.root}/{name.schema}"
        for candidate in (f"{base}/{name.table}", f"{base}/{name.table}.{self.fmt}"):
            where = self.spark._jvm.org.apache.hadoop.fs.Path(candidate)
            if where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
                return candidate
        return None

    def table(self, name: TableName) -> DataFrame | None:
        path = self.path(name)
        if path is None:
            return None
        return self.spark.read.format(self.fmt).load(path) if path.endswith(f".{self.fmt}") else read_layout(self.spark, path, self.fmt)


class TpchConnector(FolderConnector):
    """Generated tables by scale: schema tiny or sfN; None for a schema that names no scale."""

    def table(self, name: TableName) -> DataFrame | None:
        scale = scale_of(name.schema)
        return None if scale is None else super().table(TableName(name.table, f"sf{scale:g}"))


def bucket_of(path: Column) -> Column:
    """The bucket of a row's file: the leading digits of the file's name, as 000012_0 or Spark's part-.._00012.c000; else null."""
    name = F.element_at(F.split(path, "/"), -1)
    digits = F.coalesce(F.nullif(F.regexp_extract(name, r"^([0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"_([0-9]{5})(?:\.|$)", 1), F.lit("")))
    return digits.cast("int")
