"""Big-data safety: what may reach the driver or a single task, and checks of the sources against it."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Functions that pull rows to the driver or sort without a partition, and why what they take is small.
BOUNDED = {
    "boosting.Tree": "take() of numpy arrays in a task, no rows",
    "boosting._alone": "take() of numpy arrays in a task, no rows",
    "boosting._histograms": "take() of numpy arrays in a task, no rows",
    "boosting.thresholds": "one row of quantiles",
    "boosting._met": "a row for each open node of a level",
    "boosting.staged_search": "bins of SHARED_ROWS rows at most, and two numbers a model and task",
    "demand.week_span": "one row of two numbers",
    "demand.global_week_index": "a row for each week",
    "demand.add_regional_features": "a row for each state",
    "forecast.fit_and_score": "scalars",
    "forecast.forest_nodes": "the nodes of one forest, bounded by its trees and depth",
    "forecast.forest_errors": "a row a setting",
    "graph.connected_components": "one count",
    "graph.numbered": "a row for each partition of the sorted ids",
    "lists.laid": "one count",
    "lists.column": "a row for each of few() vertices",
    "motifs._searched": "SHARED_EDGES edges at most, and the names and targets of few() vertices",
    "motifs._wedges": "SHARED_EDGES edges at most",
    "profile.quantiles": "one row of quantiles",
    "profile.daily_counts_from_text": "the header line",
    "ranks.running_total": "a row for each range",
    "recurrent.fit_recurrent": "one model and a loss an epoch",
    "risk.percentile_norm": "one maximum",
    "text.frequent_words": "a vocabulary of bounded size",
    "text.negative_topics": "a row for each topic",
    "weekly.prepare_stream_source": "a demonstration's rows, limited",
}
PULLS = {"collect", "toPandas", "toArrow", "first", "head", "take", "tail", "toLocalIterator"}


def sources() -> list[Path]:
    """Modules of the engine without the text operators, which have their own bounds."""
    root = Path(__file__).resolve().parents[1]
    return sorted(p for p in root.rglob("*.py") if "llm" not in p.parts and p.name != "lint.py")


def _functions(path: Path) -> Iterator[tuple[str, ast.AST]]:
    for node in ast.parse(path.read_text()).body:
        if isinstance(node, ast.FunctionDef | ast.ClassDef):
            yield f"{path.stem}.{node.name}", node


def _calls(node: ast.AST) -> Iterator[ast.Call]:
    return (n for n in ast.walk(node) if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute))


def unguarded_pulls() -> list[str]:
    """Functions that pull rows and are not listed."""
    return sorted({name for p in sources() for name, f in _functions(p) for c in _calls(f) if c.func.attr in PULLS and not (isinstance(c.func.value, ast.Name) and c.func.value.id == "F")} - set(BOUNDED))


def unpartitioned_windows() -> list[str]:
    """Functions with Window.orderBy, which one task sorts, that are not listed."""
    return sorted({name for p in sources() for name, f in _functions(p) for c in _calls(f) if c.func.attr in ("orderBy", "rowsBetween") and isinstance(c.func.value, ast.Name) and c.func.value.id == "Window"} - set(BOUNDED))


def _chain(call: ast.Call) -> list[str]:
    names, node = [], call
    while isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
        names.append(node.func.attr)
        node = node.func.value
    return names


def unbounded_sorts() -> list[str]:
    """Functions that sort and pull in one chain without a limit."""
    return sorted({name for p in sources() for name, f in _functions(p) for c in _calls(f) if c.func.attr in PULLS and "orderBy" in _chain(c) and "limit" not in _chain(c)})


def stale_bounds() -> list[str]:
    """Listed functions that there are no more."""
    return sorted(set(BOUNDED) - {name for p in sources() for name, _ in _functions(p)})


def _has(module, *names: str) -> list[str]:
    return [f"{module.__name__.rpartition('.')[2]}.{n}" for n in names if not hasattr(module, n)]


def run_all(spark: SparkSession) -> DataFrame:
    """(check, passed, detail): safety of the sources and presence of every capability."""
    from quayside.operators import demand, forecast, graph, motifs, profile, recurrent, risk, sentiment, text
    from quayside.plans import stepcache
    from quayside.sources import tables
    from quayside.streaming import weekly

    checks = {
        "no unguarded collect": unguarded_pulls(),
        "no unpartitioned window": unpartitioned_windows(),
        "no unbounded sort and pull": unbounded_sorts(),
        "safety list is current": stale_bounds(),
        "raw text ingest and reconciliation": _has(profile, "daily_counts_from_text", "reconcile_daily_counts"),
        "SQL joins": [] if "INNER JOIN" in sentiment.REVIEWS_WITH_SELLER_SQL else ["sentiment"],
        "pipelines": _has(forecast, "feature_pipeline") + _has(text, "nlp_pipeline"),
        "cross-validation": _has(forecast, "cv_estimators") + _has(text, "fit_nlp"),
        "neural classifier": _has(recurrent, "fit_recurrent") + _has(text, "fit_mlp"),
        "graph operators": _has(graph, "pagerank", "connected_components", "label_propagation", "bfs_backups", "shared_customer_motifs", "degree_stats") + _has(motifs, "find", "bfs_paths"),
        "window features": _has(demand, "add_weekly_features"),
        "approximate statistics": _has(profile, "eda_stats", "shared_key_cardinality"),
        "outlier treatment": _has(profile, "winsorize"),
        "co-customer graph": _has(graph, "cocustomer_edges"),
        "two-hop substitutes": _has(graph, "two_hop_backups"),
        "category-region graph": _has(graph, "catregion_edges", "catregion_backups"),
        "negative topic model": _has(text, "negative_topics"),
        "demand features": [c for c in demand.LAG_COLS if c not in demand.FEATURE_COLS] + ([] if len(set(demand.FEATURE_COLS)) == 12 else ["12 columns"]),
        "batch inference": _has(text, "batch_predict"),
        "grouped pandas function": _has(sentiment, "sentiment_slopes_pandas"),
        "streaming": _has(weekly, "run_weekly_volume_stream"),
        "step cache": _has(stepcache, "StepCache"),
        "declared schemas": [k for k in tables.TABLES if k not in tables.SCHEMAS],
        "risk index columns": [] if len(risk.INDEX_COLUMNS) == 22 else ["22 columns"],
    }
    return spark.createDataFrame([(k, not v, ", ".join(v)) for k, v in checks.items()], "check string, passed boolean, detail string")
