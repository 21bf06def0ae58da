"""Rule engines: routing, boolean conditions, expressions over facts, batches."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILE_LINES = 500
_OPS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "contains": lambda a, b: F.contains(a.cast("string"), F.lit(b)),
    "starts_with": lambda a, b: F.startswith(a.cast("string"), F.lit(b)), "matches": lambda a, b: a.cast("string").rlike(b),
}


def condition(tree: dict) -> Column:
    """A Column of a tree of {"all": [..]}, {"any": [..]}, {"not": ..} and {"field", "operator", "value"}.

    An empty "all" is true, an empty "any" false.
    """
    if "all" in tree:
        return reduce(lambda a, b: a & b, map(condition, tree["all"]), F.lit(True))
    if "any" in tree:
        return reduce(lambda a, b: a | b, map(condition, tree["any"]), F.lit(False))
    if "not" in tree:
        return ~condition(tree["not"])
    if tree["operator"] not in _OPS:
        raise ValueError(f"unknown operator {tree['operator']!r}")
    return _OPS[tree["operator"]](F.col(tree["field"]), tree["value"])


def route(rule: dict) -> str:
    """Which engine a rule goes to: the one it names, or by the shape of its definition."""
    if rule.get("engine"):
        return rule["engine"]
    text = str(rule.get("rule") or rule.get("when") or "").lower()
    if "when" in text and "then" in text:
        return "grl"
    if rule.get("expression"):
        return "expression"
    return "conditions"


def route_column(definition: Column, engine: Column) -> Column:
    """``route`` for a table of rules: JSON text and an explicit engine or null."""
    low = F.lower(definition)
    return (
        F.when(F.length(engine) > 0, engine)
        .when(F.contains(low, F.lit("when")) & F.contains(low, F.lit("then")), "grl")
        .when(F.get_json_object(definition, "$.expression").isNotNull(), "expression")
        .otherwise("conditions")
    )


def facts(files: DataFrame, text: str = "content") -> DataFrame:
    """One row: file_count, has_unwrap, has_expect, has_async, has_tests."""
    any_of = lambda s: F.coalesce(F.bool_or(F.contains(F.col(text), F.lit(s))), F.lit(False))
    return files.agg(
        F.count(F.lit(1)).alias("file_count"), any_of(".unwrap()").alias("has_unwrap"), any_of(".expect(").alias("has_expect"),
        any_of("async fn").alias("has_async"), any_of("#[test]").alias("has_tests"),
    )


_ALLOWED = re.compile(r"\s*(?:\d+(?:\.\d+)?|[A-Za-z_]\w*|&&|\|\||[<>=!]=|[<>!+\-*/%()])")


def expression_sql(text: str, names: set[str]) -> str:
    """SQL of an evalexpr-style boolean; only numbers, known names and operators pass."""
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _ALLOWED.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        t, at = m[0].strip(), m.end()
        if re.match(r"[A-Za-z_]", t) and t not in names | {"true", "false"}:
            raise ValueError(f"unknown name {t!r}")
        out.append({"&&": "AND", "||": "OR", "!": "NOT", "==": "="}.get(t, t))
    return " ".join(out)


def expression_rules(facts_row: DataFrame, rules: list[dict]) -> DataFrame:
    """id, severity, category, message of the rules whose expression holds on the facts.

    A rule that cannot be read gives a warning of category Configuration.
    """
    rows = []
    names = set(facts_row.columns)
    for r in rules:
        try:
            hit = F.expr(expression_sql(r["expression"], names))
            rows.append((hit, r["id"], r.get("severity", "warning"), r.get("category", "quality"), r.get("message", "")))
        except ValueError as e:
            rows.append((F.lit(True), r["id"], "warning", "configuration", str(e)))
    parts = F.array(*[F.struct(h.alias("hit"), *[F.lit(v).alias(k) for k, v in zip(("id", "severity", "category", "message"), x, strict=True)]) for h, *x in rows])
    return facts_row.select(F.inline(parts)).where("hit").drop("hit")


def large_files(files: DataFrame, key: str, n_lines: Column, limit: int = FILE_LINES) -> DataFrame:
    return files.where(n_lines > limit).select(F.col(key).alias("file"), n_lines.cast("long").alias("n_lines"))


def containing(files: DataFrame, key: str, literals: dict[str, str], text: str = "content") -> DataFrame:
    """id, file for every rule whose literal a file contains; all rules in one scan."""
    hits = F.array(*[F.when(F.contains(F.col(text), F.lit(s)), F.lit(i)) for i, s in literals.items()])
    return files.select(F.col(key).alias("file"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("id"))


def run_batch(rules: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL of every rule's findings, missing columns null."""
    frames = iter(rules.items())
    name, out = next(frames)
    out = out.withColumn("rule", F.lit(name))
    for name, df in frames:
        out = out.unionByName(df.withColumn("rule", F.lit(name)), allowMissingColumns=True)
    return out


def load_rules(spark: SparkSession, folder: str, variables: dict[str, str] | None = None) -> DataFrame:
    """The rule catalogue of a folder of YAML files, one row a rule.

    ``_extends`` names a template (a file with ``_template: name``), whose keys a
    rule overrides; ``${name}`` is replaced from ``variables``.  Read on the
    driver: a catalogue is configuration, not data.
    """
    import yaml

    docs = [yaml.safe_load(p.read_text()) or {} for p in sorted(Path(folder).rglob("*.y*ml"))]
    templates = {d["_template"]: d for d in docs if "_template" in d}

    def fill(x):
        if isinstance(x, str):
            return re.sub(r"\$\{(\w+)\}", lambda m: str((variables or {}).get(m[1], m[0])), x)
        if isinstance(x, dict):
            return {k: fill(v) for k, v in x.items() if not k.startswith("_")}
        return [fill(v) for v in x] if isinstance(x, list) else x

    rows = []
    for d in docs:
        if "_template" not in d:
            r = fill({**templates.get(d.get("_extends"), {}), **d})
            for need in ("id", "category", "severity"):
                if need not in r:
                    raise ValueError(f"a rule lacks {need}: {r}")
            rows.append((r["id"], r.get("name", r["id"]), r["category"], r["severity"], bool(r.get("enabled", True)), route(r), [str(x) for x in r.get("lint_select", [])], r.get("message", "")))
    return spark.createDataFrame(rows, "id string, name string, category string, severity string, enabled boolean, engine string, lint_select array<string>, message string")
