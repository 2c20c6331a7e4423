"""Column statistics, sampled selectivity and distinct-count estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: rows, nulls, min, max, distinct (approximate), mean and greatest length; one pass over df."""
    names = columns or df.columns
    aggs = []
    for i, c in enumerate(names):
        text = F.col(c).cast("string")
        aggs += [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"), F.approx_count_distinct(c).alias("distinct"), F.avg(F.length(text)).alias("mean_length"), F.max(F.length(text)).alias("max_length")).alias(f"s{i}")]
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def order_shares(df: DataFrame, column: str, by: str) -> DataFrame:
    """Shares of ascending, descending and equal steps of a column in the order of by, within the input's partitions."""
    from pyspark.sql import Window

    prev = F.lag(column).over(Window.partitionBy(F.spark_partition_id()).orderBy(by))
    step = df.select(F.signum(F.col(column) - prev).alias("s")).where("s is not null")
    return step.agg(*[F.avg((F.col("s") == v).cast("double")).alias(n) for n, v in (("ascending", 1), ("descending", -1), ("equal", 0))])


def sample_selectivity(df: DataFrame, condition: str | Column, percent: float = 1.0, seed: int = 7) -> tuple[int, int]:
    """(scanned, passed) over a sample of so many percent."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    row = df.sample(percent / 100, seed).agg(F.count("*").alias("n"), F.count_if(condition).alias("k")).first()
    return row["n"], row["k"]


def sample_statistics(df: DataFrame, condition: str | Column, columns: list[str], percent: float = 1.0, seed: int = 7) -> tuple[int, int, DataFrame]:
    """(scanned, passed, statistics of the columns over the rows that passed) over a sample of so many percent.

    distinct is carried on to the whole: rows stands for all rows that pass.
    """
    scanned, passed = sample_selectivity(df, condition, percent, seed)
    condition = F.expr(condition) if isinstance(condition, str) else condition
    stats = column_stats(df.sample(percent / 100, seed).where(condition), columns)
    whole = max(passed, round(passed * 100 / percent))
    few = F.col("distinct") * 50 <= F.col("rows")
    scaled = F.when(few | (F.col("rows") == 0), F.col("distinct")).otherwise(F.least(F.lit(whole), F.round(F.col("distinct") * (100 / percent)).cast("long")))
    return scanned, passed, stats.withColumn("distinct", scaled)


def estimate_distinct(sampled: int, distinct: int, rows: int, low: float | None = None, high: float | None = None) -> int:
    """Distinct values of the whole from a sample's: kept if few (under a fiftieth), else scaled, within rows and range."""
    if sampled <= 0:
        return 0
    found = distinct if distinct * 50 <= sampled else round(distinct * rows / sampled)
    most = rows if low is None or high is None else min(rows, int(high - low) + 1)
    return max(min(found, most), min(distinct, most))
