"""Metric registry: named metrics declared once, computed in shared passes.

A metric is (name, label, description, table, expression, unit); the
expression is a Spark SQL aggregate over its table and may use
``FILTER (WHERE ...)``.  All metrics of one table are computed by **one**
aggregate over that table, unfolded with ``inline`` and unioned across
tables, so ten metrics over three tables cost three scans, not ten.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, functions as F

REQUIRED_KEYS = ("name", "label", "description", "table", "expression", "unit")


def validate_metrics(metrics: Sequence[Mapping] | None) -> list[dict]:
    """The registry as dicts.  All that is wrong with it is told in one error: no
    metric at all, keys that are absent or blank, names used twice."""
    registry = [dict(m) for m in metrics or ()]
    faults = [] if registry else ["the registry is empty"]
    for place, entry in enumerate(registry, 1):
        blank = sorted(set(REQUIRED_KEYS) - {k for k, v in entry.items() if str(v or "").strip()})
        if blank:
            faults.append(f"metric {place} ({entry.get('name') or 'unnamed'}) lacks {', '.join(blank)}")
    uses = Counter(entry["name"] for entry in registry if entry.get("name"))
    faults += [f"{n} metrics are called {name}" for name, n in uses.items() if n > 1]
    if faults:
        raise ValueError("; ".join(faults))
    return registry


def load_metrics(path: str | Path) -> list[dict]:
    """Load a registry from YAML (``metrics:`` list) or JSON."""
    text = Path(path).read_text()
    if str(path).endswith((".yml", ".yaml")):
        try:
            import yaml
        except ImportError as exc:  # pragma: no cover
            raise RuntimeError("PyYAML is needed for YAML registries") from exc
        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text or "{}")
    return validate_metrics(data.get("metrics"))


def metric_table(tables: Mapping[str, DataFrame], metrics: Sequence[Mapping]) -> DataFrame:
    """One row per metric: metric_name, label, description, unit, value (DOUBLE)."""
    metrics = validate_metrics(metrics)
    by_table: dict[str, list[dict]] = {}
    for m in metrics:
        if m["table"] not in tables:
            raise KeyError(f"metric {m['name']!r} reads unknown table {m['table']!r}")
        by_table.setdefault(m["table"], []).append(m)
    parts = []
    for tname, ms in by_table.items():
        one = tables[tname].agg(*[F.expr(m["expression"]).cast("double").alias(f"m{i}")
                                  for i, m in enumerate(ms)])
        rows = F.array(*[
            F.struct(F.lit(m["name"]).alias("metric_name"), F.lit(m["label"]).alias("label"),
                     F.lit(m["description"]).alias("description"),
                     F.lit(m["unit"]).alias("unit"), F.col(f"m{i}").alias("value"))
            for i, m in enumerate(ms)])
        parts.append(one.select(F.inline(rows)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("metric_name")


def metric(metrics_df: DataFrame, name: str) -> float | None:
    """Read one metric's value by name; an unknown name raises (MET2)."""
    rows = metrics_df.filter(F.col("metric_name") == name).select("value").take(1)
    if not rows:
        raise KeyError(f"unknown metric {name!r}")
    return rows[0][0]
