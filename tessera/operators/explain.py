"""Plans as text: trees, summaries and counts of nodes, and what a run measured."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

_NODE = re.compile(r"^[\s:+\-*|]*(?:\(\d+\)\s*)?([A-Z][A-Za-z]+)")
#: What EXPLAIN shows, and Spark's plan for it.
KINDS = {"logical": "analyzed", "graph": "optimizedPlan", "optimized": "optimizedPlan", "executable": "executedPlan"}


def plan_text(df: DataFrame, kind: str = "logical") -> str:
    """The tree of a plan: logical, optimized or executable."""
    if kind not in KINDS:
        raise ValueError(f"no such plan: {kind}")
    return getattr(df._jdf.queryExecution(), KINDS[kind])().toString().rstrip("\n")


def skeleton(df: DataFrame, kind: str = "logical") -> str:
    """The tree with node names only."""
    out = []
    for line in plan_text(df, kind).split("\n"):
        if m := _NODE.match(line):
            out.append("  " * (len(line) - len(line.lstrip(" :+-|"))) + m[1])
    return "\n".join(re.sub(r"^ +", lambda s: " " * (len(s[0]) // 3), x) for x in out)


def summary(df: DataFrame, kind: str = "logical") -> str:
    """Output columns, then how many nodes of each kind there are."""
    nodes = Counter(m[1] for line in plan_text(df, kind).split("\n") if (m := _NODE.match(line)))
    columns = ", ".join(f"{n}:{t}" for n, t in df.dtypes)
    return f"output: {columns}\n" + "\n".join(f"{n}: {c}" for n, c in sorted(nodes.items()))


def estimates(df: DataFrame) -> str:
    """The optimized plan with the sizes and row counts that the optimizer expects."""
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost"))


def analyze(df: DataFrame) -> str:
    """Runs df and gives the final executed plan with each node's metrics."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    jvm = df.sparkSession._jvm
    out: list[str] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), depth)
        metrics, found = node.metrics(), []
        keys = metrics.keys().iterator()
        while keys.hasNext():
            key = keys.next()
            metric = metrics.apply(key)
            if metric.value() > 0 and key in ("numOutputRows", "spillSize", "peakMemory", "numFiles", "dataSize", "shuffleBytesWritten"):
                found.append(f"{key}={metric.value()}")
        out.append("  " * depth + name + (f" ({', '.join(sorted(found))})" if found else ""))
        children = [node.plan()] if "QueryStage" in name else list(jvm.scala.jdk.javaapi.CollectionConverters.asJava(node.children()))
        for child in children:
            walk(child, depth + 1)

    walk(execution.executedPlan(), 0)
    return "\n".join(out)


def explain(df: DataFrame, kind: str = "executable", run: bool = False) -> DataFrame:
    """EXPLAIN as a table of one row."""
    text = analyze(df) if run else (estimates(df) if kind == "cost" else plan_text(df, kind))
    return df.sparkSession.createDataFrame([(text,)], "plan string")
