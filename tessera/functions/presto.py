"""Presto semantics as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def divide(a: Column, b: Column, integers: bool) -> Column:
    """Whole numbers: truncated, an error for 0. Doubles: infinities and NaN for 0, as IEEE has it."""
    if integers:
        return F.call_function("div", a.cast("long"), b.cast("long"))
    inf = F.lit(float("inf"))
    zero = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)
    return F.when(b == 0, F.when(a.isNotNull(), zero)).otherwise(a / b)


def day_of_week(x: Column) -> Column:
    """Monday is 1, Sunday 7."""
    return F.weekday(x) + 1


def ceiling(x: Column) -> Column:
    return F.ceil(x).cast("double")


def flooring(x: Column) -> Column:
    return F.floor(x).cast("double")


def element_at(container: Column, key) -> Column:
    """Null out of range or for a missing key."""
    return F.try_element_at(container, key if isinstance(key, Column) else F.lit(key))


def subscript(container: Column, key, is_map: bool = False) -> Column:
    """An error out of range or for a missing key."""
    key = key if isinstance(key, Column) else F.lit(key)
    if not is_map:
        return F.element_at(container, key)
    found = F.map_contains_key(container, key)
    return F.when(found | found.isNull(), F.try_element_at(container, key)).otherwise(F.raise_error(F.concat(F.lit("Key not present in map: "), key.cast("string"))))


def array_agg(x: Column) -> Column:
    """Keeps nulls."""
    return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"])


def array_agg_ordered(x: Column, *keys: tuple[Column, bool], distinct: bool = False, where: Column | None = None) -> Column:
    """array_agg(x ORDER BY key [DESC] NULLS LAST, ...) FILTER (WHERE ...); keys are (column, descending)."""
    row = F.struct(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)], x.alias("x"))
    rows = F.collect_set(row if where is None else F.when(where, row)) if distinct else F.collect_list(row if where is None else F.when(where, row))

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for i, (_, down) in reversed(list(enumerate(keys))):
            p, q = a[f"k{i}"], b[f"k{i}"]
            lower = F.lit(1 if down else -1)
            out = F.when(p.isNull() & q.isNull(), out).when(p.isNull(), 1).when(q.isNull(), -1).when(p < q, lower).when(p > q, -lower).otherwise(out)
        return out

    return F.transform(F.array_sort(rows, compare), lambda s: s["x"])


def row_from_map(m: Column, keys: list, names: list[str], default: Column | None = None) -> Column:
    """A struct of chosen keys; a missing key is null, or the default (0, an empty array or map) if one is given."""
    pick = lambda k: F.try_element_at(m, F.lit(k))
    return F.struct(*[(pick(k) if default is None else F.coalesce(pick(k), default)).alias(n) for k, n in zip(keys, names, strict=True)])


def dereference(df: DataFrame, struct: str, field: str | int) -> Column:
    """A field of a struct column by name, or by its place from 0."""
    names = df.select(struct).schema[0].dataType.names
    if isinstance(field, int) and not 0 <= field < len(names):
        raise ValueError(f"{struct} has no field {field}")
    return F.col(struct).getField(names[field] if isinstance(field, int) else field)


def map_as_struct(df: DataFrame, column: str, keys: list, names: list[str] | None = None) -> DataFrame:
    """A map column as a struct of known keys, each looked up once; names are k<key> unless given."""
    names = names or [f"k{k}" for k in keys]
    return df.withColumn(column, row_from_map(F.col(column), keys, names))


def histogram(df: DataFrame, keys: list[str], value: str, name: str = "histogram") -> DataFrame:
    """For each keys a map from value to how often it occurs; counted in two steps, so a map holds distinct values only."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(value, "n"))).alias(name))
