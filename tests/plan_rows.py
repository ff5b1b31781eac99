"""Rows that the operators of a finished plan have put out."""

from __future__ import annotations


def rows_made(df, kind: str) -> int:
    """Runs ``df`` and adds up the rows of all plan nodes whose name starts with ``kind``."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    total, waiting = 0, [execution.executedPlan()]
    while waiting:
        node = waiting.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            waiting.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            waiting.append(node.plan())
            continue
        if name.startswith(kind):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return total
