"""Size and complexity metrics, thresholds and levels."""

from __future__ import annotations

import ast
import io
import math
import tokenize
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import in_frames
from .chunking import UNPARSED

# Default thresholds and the levels of multi-level metrics.
LIMITS = {"cyclomatic": 15, "cognitive": 10, "function_length": 50, "nesting": 4}
MI_LEVELS = ((85, "excellent"), (65, "good"), (50, "moderate"))
CYCLOMATIC_LEVELS = ((50, "extreme"), (20, "high"), (10, "moderate"))


def line_metrics(lines: DataFrame, key: str, comment: str = r"^\s*(//|#)") -> DataFrame:
    """key, sloc (all lines), blank, cloc (comment lines), ploc (the rest), longest line in bytes."""
    blank = F.col("line").rlike(r"^\s*$")
    note = F.col("line").rlike(comment)
    return lines.groupBy(key).agg(
        F.count(F.lit(1)).alias("sloc"), F.count_if(blank).alias("blank"), F.count_if(note).alias("cloc"),
        F.count_if(~blank & ~note).alias("ploc"), F.max(F.octet_length("line")).cast("long").alias("longest"),
    )


def unpivot(metrics: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, metric, value."""
    return metrics.select(key, F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))


def violations(metrics: DataFrame, key: str, limits: dict[str, float]) -> DataFrame:
    """key, metric, value, threshold of the values above their limit."""
    long = unpivot(metrics, key, list(limits))
    limit = F.get(F.array(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, float(v))])[F.col("metric")]), F.lit(0))
    return long.withColumn("threshold", limit).where(F.col("value") > F.col("threshold"))


def maintainability(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    return 171 - 5.2 * F.ln(F.greatest(volume, F.lit(1.0))) - 0.23 * cyclomatic - 16.2 * F.ln(F.greatest(loc, F.lit(1)))


def level(value: Column, levels, last: str) -> Column:
    """Name of the first level that the value reaches."""
    out = F.lit(last)
    for least, name in reversed(levels):
        out = F.when(value >= least, name).otherwise(out)
    return out


_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Match)


def function_metrics_of(source: str) -> list[tuple]:
    """Per function: name, start, end, cyclomatic, cognitive, Halstead volume, difficulty and
    effort, maintainability, sloc, ploc, cloc, blank, lloc, nargs, nexits, nesting."""
    tree, rows = ast.parse(source), source.split("\n")
    notes = {t.start[0] for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type == tokenize.COMMENT and rows[t.start[0] - 1].strip().startswith("#")}
    out = []
    for f in ast.walk(tree):
        if not isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        ops, opnds = [], []
        cyclo, cogn, deepest, lloc, exits = 1, 0, 0, 0, 0

        def walk(node: ast.AST, nest: int) -> None:
            nonlocal cyclo, cogn, deepest, lloc, exits
            for c in ast.iter_child_nodes(node):
                if isinstance(c, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                    continue
                cyclo += isinstance(c, _BRANCH)
                if isinstance(c, ast.BoolOp):
                    cyclo, cogn = cyclo + len(c.values) - 1, cogn + 1
                nested = isinstance(c, _NEST)
                if nested:
                    cogn += 1 + nest
                    deepest = max(deepest, nest + 1)
                lloc += isinstance(c, ast.stmt)
                exits += isinstance(c, ast.Return | ast.Raise)
                if isinstance(c, ast.operator | ast.unaryop | ast.boolop | ast.cmpop):
                    ops.append(type(c).__name__)
                elif isinstance(c, ast.Name):
                    opnds.append(c.id)
                elif isinstance(c, ast.Constant):
                    opnds.append(repr(c.value))
                elif isinstance(c, ast.Call | ast.Assign | ast.AugAssign | ast.Return | ast.If | ast.For | ast.While):
                    ops.append(type(c).__name__)
                walk(c, nest + nested)

        walk(f, 0)
        n1, n2, big1, big2 = len(set(ops)), len(set(opnds)), len(ops), len(opnds)
        volume = (big1 + big2) * math.log2(n1 + n2) if n1 + n2 > 1 else 0.0
        hard = n1 / 2 * big2 / n2 if n2 else 0.0
        own = range(f.lineno, f.end_lineno + 1)
        blank = sum(not rows[i - 1].strip() for i in own)
        cloc = sum(i in notes for i in own)
        mi = 171 - 5.2 * math.log(max(volume, 1)) - 0.23 * cyclo - 16.2 * math.log(len(own))
        args = f.args
        out.append((f.name, f.lineno, f.end_lineno, cyclo, cogn, volume, hard, hard * volume, mi, len(own), len(own) - blank - cloc, cloc, blank, lloc,
                    len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs), exits, deepest))
    return sorted(out, key=lambda r: r[1])


FUNCTION_METRICS = (
    "name string, start_line long, end_line long, cyclomatic long, cognitive long, halstead_volume double, halstead_difficulty double, halstead_effort double, "
    "maintainability_index double, sloc long, ploc long, cloc long, blank long, lloc long, nargs long, nexits long, nesting long"
)


def function_metrics(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """key and the metrics of every Python function; files that do not parse give no rows."""
    kind = files.schema[key].dataType.simpleString()
    names = [key, *[x.split()[0] for x in FUNCTION_METRICS.split(", ")]]

    def rows(b: pd.DataFrame) -> Iterator[tuple]:
        for k, t in zip(b[key], b[text], strict=True):
            try:
                found = function_metrics_of(t or "")
            except (*UNPARSED, tokenize.TokenError):
                continue
            yield from ((k, *r) for r in found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from in_frames(rows(b), names)

    return files.select(key, text).mapInPandas(run, f"{key} {kind}, {FUNCTION_METRICS}")
