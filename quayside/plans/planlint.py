"""What the physical plans of queries must not hold: a lint over the plans that Spark makes, not over sources.

It looks for joins without keys, exchanges that gather unsummed rows in one partition,
Python functions that take a row at a time, and comparisons with constants that stay
above a file scan instead of reaching it.  Plans that a query runs on the way, before
a cut of its lineage, count like its last one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from quayside.plans import lineage

#: Findings that are as they should be, by query, and why.
ALLOWED: dict[tuple[str, str], str] = {
    ("text_ingest_reconciliation", "join without keys"): "sums in one row each",
    ("naive_baselines", "join without keys"): "a mean in one row",
    ("exact_percentile", "join without keys"): "a total in one row",
}

_NODE = re.compile(r"^[\s:+\-]*(?:\*\(\d+\) )?(\w+)(.*)$")
_SUMMED = re.compile(r"HashAggregate|SortAggregate|TakeOrdered|LocalLimit|CollectLimit|WindowGroupLimit")
_CONSTANT = re.compile(r"\((\w+)#\d+L? (?:=|<|>|<=|>=) (?:-?[\d.]+|[A-Za-z_][\w-]*)\)")


def nodes(plan: str) -> Iterator[tuple[int, str, str]]:
    """(depth, name, the rest of its line) of each node of a plan's text, parents first."""
    for line in plan.splitlines():
        m = _NODE.match(line)
        if m and not line.startswith("=="):
            yield len(line) - len(line.lstrip(" :+-")), m[1], m[2]


def findings(df: DataFrame) -> set[str]:
    """The kinds of what a frame's physical plan holds and should not."""
    return findings_of(df._jdf.queryExecution().executedPlan().toString())


def findings_of(plan: str) -> set[str]:
    found, listed = set(), list(nodes(plan))
    for i, (_, name, rest) in enumerate(listed):
        below = listed[i + 1] if i + 1 < len(listed) else (0, "", "")
        if name in ("CartesianProduct", "BroadcastNestedLoopJoin"):
            found.add("join without keys")
        elif name == "BatchEvalPython":
            found.add("row function")
        elif name == "Exchange" and "SinglePartition" in rest and not _SUMMED.search(below[1]) and below[1] != "Range":
            found.add("single partition")
        elif name == "Filter":
            scan = next((x for x in listed[i + 1 : i + 3] if x[1] == "FileScan"), None)
            pushed = re.search(r"PushedFilters: \[([^\]]*)", scan[2]) if scan else None
            if pushed and any(column not in pushed[1] for column in _CONSTANT.findall(rest)):
                found.add("filter above a scan")
    return found


def scan(spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]]) -> list[tuple[str, str, bool]]:
    """(query, finding, whether it is allowed) of all plans that the queries make."""
    out = []
    for name, make in queries.items():
        found: set[str] = set()
        watch = lambda df, found=found: found.update(findings(df))
        lineage.WATCHERS.append(watch)
        try:
            watch(make(spark, sf_dir))
        finally:
            lineage.WATCHERS.remove(watch)
        out += [(name, kind, (name, kind) in ALLOWED) for kind in sorted(found)]
    return out


def main(sf_dir: str) -> None:
    """Print what the plans of all registered queries hold that is not allowed."""
    from quayside import queries

    spark = SparkSession.builder.getOrCreate()
    for name, kind, allowed in scan(spark, sf_dir, queries.QUERIES):
        print(f"{name}: {kind}" + " (allowed)" * allowed)


if __name__ == "__main__":
    import sys

    main(sys.argv[1])
