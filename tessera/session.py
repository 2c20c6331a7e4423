"""Settings, the tables of a data folder, and a session that runs Presto SQL over connectors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.parquet.inferTimestampNTZ.enabled": "true"}


def configure(spark: SparkSession) -> SparkSession:
    """Sets what can be set at run time; sizes and parallelism stay the cluster's."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_tables(spark: SparkSession, folder: str, names: list[str] | None = None, text: str | None = None) -> None:
    """Registers the folder's tables as temporary views: those named, or those that the text names, or all."""
    if names is None:
        words = None if text is None else {w.lower() for w in re.findall(r"[A-Za-z_]\w*", text)}
        names = [t for t in TABLES if words is None or t in words]
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def _parts(name: str) -> list[str]:
    """catalog, schema and table of a name; dots within backquotes are part of one."""
    parts = [quoted or plain for quoted, plain in re.findall(r"`([^`]*)`|([^.`]+)", name)]
    return [None, "default", parts[0]] if len(parts) == 1 else [None, *parts] if len(parts) == 2 else parts


class Session:
    """Presto SQL over Spark's tables and connectors; the first connector added is the default one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.connectors, self.default, self.variables, self.views = configure(spark), {}, None, {}, set()

    def add(self, name: str, connector) -> None:
        self.connectors[name] = connector
        self.default = self.default or name

    def _view(self, name: str) -> str:
        """A relation's name for Spark: the session's own view, else a view of the connector's table, else the name as it is."""
        from .sources.tables import TableName

        plain = TableName(*reversed(_parts(name)))
        connector = self.connectors.get(plain.catalog or self.default)
        found = connector.table(plain) if connector and name not in self.views else None
        if found is None:
            return name
        view = re.sub(r"\W", "_", f"{plain.catalog or self.default}__{plain.schema}__{plain.table}")
        found.createOrReplaceTempView(view)
        return f"{view} AS {plain.table}"

    def translate(self, text: str) -> str:
        from .sql.presto import translate

        return translate(self.spark, text, self._view)

    def sql(self, text: str) -> DataFrame:
        """A query, or a statement: EXPLAIN, SHOW, DESCRIBE, CREATE TABLE .. AS, CREATE VIEW, INSERT, DELETE, DROP, SET SESSION."""
        from .sql.statements import run

        return run(self, text)
