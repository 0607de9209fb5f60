"""Metric registry: validation, one pass per table, lookup by name."""

import json

import pytest

from tidewell.operators.metrics import load_metrics, metric, metric_table, validate_metrics

M1 = {"name": "total_a", "label": "A's total", "description": "Sum of a.", "table": "t",
      "expression": "sum(a)", "unit": "count"}
M2 = {"name": "big_a", "label": "Big", "description": "Rows with a > 1.", "table": "t",
      "expression": "count(*) filter (where a > 1)", "unit": "count"}
M3 = {"name": "max_b", "label": "Max b", "description": "Largest b.", "table": "u",
      "expression": "max(b)", "unit": "usd"}


def test_validate(tmp_path):
    assert [m["name"] for m in validate_metrics([M1, M2])] == ["total_a", "big_a"]
    with pytest.raises(ValueError, match=r"metric 1 \(total_a\) lacks unit"):
        validate_metrics([{**M1, "unit": ""}])
    with pytest.raises(ValueError, match="registry is empty"):
        validate_metrics([])
    with pytest.raises(ValueError, match=r"metric 2 \(unnamed\) lacks label, name; 2 metrics are called total_a"):
        validate_metrics([M1, {**M2, "name": None, "label": " "}, M1])
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"metrics": [M1, M2]}))
    assert [m["name"] for m in load_metrics(p)] == ["total_a", "big_a"]
    y = tmp_path / "m.yml"
    y.write_text("metrics:\n  - name: x\n    label: \"it's\"\n    description: d\n"
                 "    table: t\n    expression: count(*)\n    unit: count\n")
    assert load_metrics(y)[0]["label"] == "it's"


def test_metric_table(spark):
    t = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    u = spark.createDataFrame([(1.5,), (9.25,)], "b double")
    out = metric_table({"t": t, "u": u}, [M1, M2, M3])
    rows = {r.metric_name: r for r in out.collect()}
    assert [r.metric_name for r in out.collect()] == ["big_a", "max_b", "total_a"]
    assert rows["total_a"].value == 6.0 and rows["big_a"].value == 2.0 and rows["max_b"].value == 9.25
    assert rows["total_a"].label == "A's total"
    assert metric(out, "max_b") == 9.25
    with pytest.raises(KeyError):
        metric(out, "nope")
