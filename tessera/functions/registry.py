"""Functions of the user's own: templates, rewrites by argument types, vectorised and simple UDFs, aggregates and table functions.

What is registered here can be called in Presto SQL and, by its name, in Spark SQL where it is a UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (arguments as translated text, their types or None) -> text, or None to leave the call as it is
Rewrite = Callable[[list[str], list[T.DataType] | None], str | None]


@dataclass(frozen=True)
class Metadata:
    """What is known of a function beside its value.

    paths says, for a function that returns a struct, which argument each field hangs on, so that only the arguments of the
    fields in use need be computed; explode makes one column of each field.
    """

    deterministic: bool = True
    cost: float = 1.0
    lambdas: tuple[int, ...] = ()
    paths: dict[str, int] = field(default_factory=dict)
    explode: bool = False


@dataclass(frozen=True)
class Function:
    name: str
    rewrite: Rewrite | None = None
    metadata: Metadata = field(default_factory=Metadata)

    def sql(self, arguments: list[str], types: Callable[..., list[T.DataType] | None]) -> str:
        known = types(*arguments) if self.rewrite and arguments else None
        out = self.rewrite(arguments, known) if self.rewrite else None
        return out if out is not None else f"{self.name}({', '.join(arguments)})"


REGISTRY: dict[str, Function] = {}


def register_rewrite(name: str, rewrite: Rewrite | str, metadata: Metadata | None = None) -> Function:
    """A function that is written as other ones: a template over {0}, {1}, .. or a callable that sees types and constants."""
    if isinstance(rewrite, str):
        template = rewrite
        rewrite = lambda arguments, types: template.format(*arguments)
    REGISTRY[name.lower()] = out = Function(name, rewrite, metadata or Metadata())
    return out


def register_vectorized(spark: SparkSession, name: str, function: Callable, returns: str, metadata: Metadata | None = None, kind: int = F.PandasUDFType.SCALAR) -> Function:
    """A scalar function over pandas Series, sent in Arrow batches."""
    made = F.pandas_udf(function, returns, kind)
    metadata = metadata or Metadata()
    spark.udf.register(name, made if metadata.deterministic else made.asNondeterministic())
    REGISTRY[name.lower()] = out = Function(name, None, metadata)
    return out


def register_aggregate(spark: SparkSession, name: str, function: Callable, returns: str) -> Function:
    """A function of a group's pandas Series that returns one value; a group is held whole by one task."""
    return register_vectorized(spark, name, function, returns, kind=F.PandasUDFType.GROUPED_AGG)


def register_simple(spark: SparkSession, name: str, function: Callable, returns: str, metadata: Metadata | None = None) -> Function:
    """A function of one row's values, for any number of arguments; Arrow carries them."""
    made = F.udf(function, returns, useArrow=True)
    metadata = metadata or Metadata()
    spark.udf.register(name, made if metadata.deterministic else made.asNondeterministic())
    REGISTRY[name.lower()] = out = Function(name, None, metadata)
    return out


def register_normalize(spark: SparkSession) -> None:
    """normalize(text [, form]): Unicode normal forms, NFC unless another is named."""

    def normal(text, form=None):
        import pandas as pd

        forms = form if form is not None else pd.Series(["NFC"] * len(text))
        return pd.Series([None if t is None else unicodedata.normalize(f, t) for t, f in zip(text, forms, strict=True)])

    spark.udf.register("unicode_normalize", F.pandas_udf(normal, "string", F.PandasUDFType.SCALAR))
    register_rewrite("normalize", lambda a, types: f"unicode_normalize({', '.join(a)})")


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """A class whose eval yields rows, callable in FROM."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def exploded(call: str, metadata: Metadata, arguments: list[str], fields: list[str]) -> list[str]:
    """Columns for some fields of a struct function: arguments that none of them hangs on are replaced by null."""
    used = {metadata.paths[f] for f in fields if f in metadata.paths}
    kept = [a if not metadata.paths or i in used or i not in metadata.paths.values() else "null" for i, a in enumerate(arguments)]
    return [f"{call}({', '.join(kept)}).{f} AS {f}" for f in fields]
