"""Statements around queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.explain import explain
from tessera.sources import tables

from .presto import PrestoError, translate_expression

_NAME = r'((?:[\w$]+|"[^"]+")(?:\.(?:[\w$]+|"[^"]+"))*)'


def _unquoted(name: str) -> str:
    return name.replace('"', "`")


def _options(text: str | None) -> dict:
    """WITH (a = 1, b = ARRAY['x']) as a dictionary."""
    out = {}
    for key, value in re.findall(r"(\w+)\s*=\s*(ARRAY\s*\[[^\]]*\]|'[^']*'|\d+)", text or "", re.I):
        strings = re.findall(r"'([^']*)'", value)
        out[key.lower()] = strings if value.upper().startswith("ARRAY") else (strings[0] if strings else int(value))
    return out


def _done(session, text: str) -> DataFrame:
    return session.spark.createDataFrame([(text,)], "result string")


def _explain(session, m) -> DataFrame:
    kind = (m["type"] or "executable").lower()
    kind = {"distributed": "executable"}.get(kind, kind)
    return explain(session.sql(m["query"]), kind, run=bool(m["analyze"]))


def _show_columns(session, m) -> DataFrame:
    name = session._view(_unquoted(m["name"])).split(" AS ")[0]
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in session.spark.table(name).schema]
    return session.spark.createDataFrame(rows, "column_name string, data_type string, nullable boolean")


def _create_table(session, m) -> DataFrame:
    name = _unquoted(m["name"])
    if m["unless"] and session.spark.catalog.tableExists(name):
        return _done(session, "CREATE TABLE: 0 rows")
    made = tables.create_table(session.spark, name, session.sql(m["query"]), _options(m["options"]))
    return _done(session, f"CREATE TABLE: {made.count()} rows")


def _create_view(session, m) -> DataFrame:
    session.sql(m["query"]).createOrReplaceTempView(_unquoted(m["name"]))
    session.views.add(_unquoted(m["name"]))
    return _done(session, "CREATE VIEW")


def _insert(session, m) -> DataFrame:
    name, rows = _unquoted(m["name"]), session.sql(m["query"])
    if m["columns"]:
        given = [c.strip().strip('"') for c in m["columns"].split(",")]
        rows = rows.toDF(*given)
        rows = rows.select(*[F.col(f.name).cast(f.dataType) if f.name in given else F.lit(None).cast(f.dataType).alias(f.name) for f in session.spark.table(name).schema])
    write = tables.WriteSession(session.spark, name, "INSERT")
    write.write(rows.toDF(*session.spark.table(name).columns))
    write.finish()
    return _done(session, "INSERT")


def _delete(session, m) -> DataFrame:
    name = _unquoted(m["name"])
    condition = translate_expression(session.spark, m["where"], name) if m["where"] else "true"
    return _done(session, f"DELETE: {tables.delete(session.spark, name, condition)} rows")


def _update(session, m) -> DataFrame:
    name = _unquoted(m["name"])
    assignments = {}
    for part in re.split(r",(?![^(]*\))", m["set"]):
        column, value = part.split("=", 1)
        assignments[column.strip().strip('"')] = translate_expression(session.spark, value, name)
    condition = translate_expression(session.spark, m["where"], name) if m["where"] else "true"
    return _done(session, f"UPDATE: {tables.update(session.spark, name, assignments, condition)} rows")


def _drop(session, m) -> DataFrame:
    name = _unquoted(m["name"])
    session.views.discard(name)
    if m["kind"].upper() == "VIEW" and session.spark.catalog.dropTempView(name):
        return _done(session, "DROP VIEW")
    session.spark.sql(f"DROP {m['kind']} {'IF EXISTS ' if m['unless'] else ''}{name}")
    return _done(session, f"DROP {m['kind'].upper()}")


def _set(session, m) -> DataFrame:
    session.variables[m["name"]] = m["value"].strip().strip("'")
    return _done(session, "SET SESSION")


def _plain(session, m) -> DataFrame:
    return session.spark.sql(m[0])


STATEMENTS = [
    (r"EXPLAIN\s+(?P<analyze>ANALYZE\s+)?(?:\(\s*TYPE\s+(?P<type>\w+)\s*\)\s*)?(?P<query>.+)", _explain),
    (rf"(?:SHOW\s+COLUMNS\s+(?:FROM|IN)|DESCRIBE|DESC)\s+(?P<name>{_NAME})", _show_columns),
    (rf"CREATE\s+TABLE\s+(?P<unless>IF\s+NOT\s+EXISTS\s+)?(?P<name>{_NAME})\s*(?:WITH\s*\((?P<options>.*?)\)\s*)?AS\s+(?P<query>.+)", _create_table),
    (rf"CREATE\s+(?:OR\s+REPLACE\s+)?VIEW\s+(?P<name>{_NAME})\s+AS\s+(?P<query>.+)", _create_view),
    (rf"INSERT\s+INTO\s+(?P<name>{_NAME})\s*(?:\((?P<columns>[\w\s,\"]+)\)\s*)?(?P<query>(?:SELECT|WITH|VALUES|TABLE|\().+)", _insert),
    (rf"DELETE\s+FROM\s+(?P<name>{_NAME})(?:\s+WHERE\s+(?P<where>.+))?", _delete),
    (rf"UPDATE\s+(?P<name>{_NAME})\s+SET\s+(?P<set>.+?)(?:\s+WHERE\s+(?P<where>.+))?", _update),
    (rf"DROP\s+(?P<kind>TABLE|VIEW|SCHEMA)\s+(?P<unless>IF\s+EXISTS\s+)?(?P<name>{_NAME})", _drop),
    (r"SET\s+SESSION\s+(?P<name>[\w.]+)\s*=\s*(?P<value>.+)", _set),
    (r"SHOW\s+(?:TABLES|SCHEMAS|FUNCTIONS|VIEWS|CATALOGS)\b.*|CREATE\s+SCHEMA\b.*|ALTER\s+(?:TABLE|VIEW|SCHEMA)\b.*|ANALYZE\b.*|USE\b.*|TRUNCATE\s+TABLE\b.*", _plain),
]


def run(session, text: str) -> DataFrame:
    text = text.strip().rstrip(";").strip()
    for pattern, act in STATEMENTS:
        if m := re.fullmatch(pattern, text, re.I | re.S):
            return act(session, m)
    if re.match(r"(?i)(GRANT|REVOKE|PREPARE|EXECUTE|DEALLOCATE|CALL|COMMIT|ROLLBACK|START)\b", text):
        raise PrestoError(f"not supported: {text.split()[0].upper()}")
    return session.spark.sql(session.translate(text))
