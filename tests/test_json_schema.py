"""JSON Schema as Columns: good and broken documents, by keyword."""

import json

import pytest

from cairnspark.operators import json_schema as js

GOOD = {"id": "QUAL001", "name": "No unwrap", "category": "quality", "severity": "error", "description": "Unwrap panics at run time.", "rule": {"when": "x"}}
CASES = [
    (GOOD, []),
    ({**GOOD, "id": "q1", "severity": "fatal"}, [("$.id", "pattern"), ("$.severity", "enum")]),
    ({k: v for k, v in GOOD.items() if k not in ("name", "rule")}, [("$", "required"), ("$", "anyOf")]),
    ({**GOOD, "enabled": "yes", "lint_select": ["F401", 3, "F401"]}, [("$.enabled", "type"), ("$.lint_select", "uniqueItems"), ("$.lint_select[1]", "type")]),
    ({**GOOD, "metrics": {"cognitive": {"threshold": 0}, "lines": {"severity": "info"}, "n": {"threshold": 2.5}}}, [("$.metrics.cognitive.threshold", "minimum"), ("$.metrics.lines", "required"), ("$.metrics.n.threshold", "type")]),
    ({**GOOD, "fixes": [{"message": "a"}, {"pattern": "b", "other": 1}, "c"]}, [("$.fixes[1]", "required"), ("$.fixes[1].other", "additionalProperties"), ("$.fixes[2]", "type")]),
    ({**GOOD, "name": "é" * 101, "description": "short"}, [("$.name", "maxLength"), ("$.description", "minLength")]),
    ([], [("$", "type")]), (None, [("$", "type")]),
]


def check(spark, schema, cases):
    rows = [(i, x if isinstance(x, str) and x.startswith("text:") else json.dumps(x, ensure_ascii=False)) for i, (x, _) in enumerate(cases)]
    docs = spark.createDataFrame([(i, t.removeprefix("text:")) for i, t in rows], "id long, value string")
    got = sorted((r.id, r.path, r.keyword) for r in js.violations(docs, schema).collect())
    assert got == sorted((i, p, k) for i, (_, want) in enumerate(cases) for p, k in want)


def test_rules_good_and_broken(spark):
    check(spark, js.RULE_SCHEMA, CASES)


@pytest.mark.parametrize(
    "schema,cases",
    [
        ({"type": ["integer", "null"], "minimum": 2, "exclusiveMaximum": 5}, [(2, []), (4.0, []), (4.5, [("$", "type")]), (5, [("$", "exclusiveMaximum")]), (1, [("$", "minimum")]), (None, []), ("3", [("$", "type")])]),
        ({"const": {"a": [1, None]}}, [({"a": [1, None]}, []), ({"a": [1]}, [("$", "const")])]),
        ({"oneOf": [{"type": "string"}, {"maxLength": 2}], "not": {"const": "x"}}, [("abc", []), ("ab", [("$", "oneOf")]), ("x", [("$", "oneOf"), ("$", "not")]), (3, [])]),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "boolean"}, "minItems": 1, "maxItems": 3}, [(["a", True], []), ([1, 2], [("$[0]", "type"), ("$[1]", "type")]), ([], [("$", "minItems")]), (["a", True, True, True], [("$", "maxItems")])]),
        ({"properties": {"it's": {"type": "string"}, "none": False}, "additionalProperties": {"type": "number"}}, [({"it's": "a", "b": 1}, []), ({"it's": 1, "b": "x", "none": 0}, [("$.it's", "type"), ("$.b", "type"), ("$.none", "false")])]),
        ({"allOf": [{"minLength": 2}, {"pattern": "^a"}]}, [("ab", []), ("b", [("$", "minLength"), ("$", "pattern")]), (1, [])]),
        (True, [({}, []), ("text:{no json", [("$", "json")])]),
        ({"enum": ["a", 1, None]}, [("a", []), (1, []), (None, []), ("b", [("$", "enum")])]),
    ],
)
def test_keywords(spark, schema, cases):
    check(spark, schema, cases)


def test_null_texts_and_references(spark):
    docs = spark.createDataFrame([(1, None), (2, "1")], "id long, value string")
    assert [r.id for r in js.violations(docs, {"type": "null"}).collect()] == [2]
    with pytest.raises(ValueError):
        js.violations(docs, {"$ref": "#/$defs/a", "$defs": {"a": {"properties": {"next": {"$ref": "#/$defs/a"}}}}})
    plan = js.violations(docs, js.RULE_SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
