"""Source validators: line rules, line state, and the findings relation.

Findings share one schema (FINDING).  A line rule is a row of LINE_RULES; all
rules run in one pass over the line table.  What needs state along a file (brace
depth, loops, async functions, blocks) is a window where state never resets, and
per-file pandas otherwise; a group is one file.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

FINDING = "id string, category string, severity string, file string, line long, message string"
SEVERITIES = ("error", "warning", "info")


@dataclass(frozen=True)
class LineRule:
    """``pattern`` must and ``unless`` must not occur in the line; ``path`` in the file's path."""

    id: str
    category: str
    severity: str
    pattern: str
    message: str
    unless: str = ""
    path: str = ""
    skip_tests: bool = True


#: Stateless rules for Rust sources.  Thresholds and word lists are the rules' fixed values.
LINE_RULES = (
    LineRule("QUAL001", "quality", "warning", r"\.unwrap\(\)", "unwrap in production code", r"// SAFETY:|lock\(\)"),
    LineRule("QUAL002", "quality", "warning", r"\.expect\(", "expect in production code", r"// SAFETY:|lock\(\)"),
    LineRule("QUAL003", "quality", "error", r"\bpanic!\s*\(", "panic in production code"),
    LineRule("QUAL005", "quality", "info", r"(?i)\b(TODO|FIXME|XXX|HACK)\b", "comment marks unfinished work", skip_tests=False),
    LineRule("QUAL020", "quality", "warning", r"#\[allow\(dead_code\)\]", "dead code is allowed"),
    LineRule("PAT004", "architecture", "warning", r"->\s*(std::result::)?Result<[^,<>]+,", "raw Result in a signature", r"type "),
    LineRule("PERF003", "performance", "warning", r"Arc<Mutex<(bool|u\d+|i\d+|usize|isize)>>", "atomic type would do"),
    LineRule("PERF004", "performance", "info", r"\.collect::<Vec<[^>]*>>\(\)\.(iter|into_iter)\(\)", "collected only to iterate"),
    LineRule("PERF005", "performance", "info", r"format!\(\"\{\}\",\s*\w+\)", "to_string would do"),
    LineRule("ASYNC002", "async", "warning", r"\bblock_on\(", "blocks in async code"),
    LineRule("ASYNC003", "async", "warning", r"std::sync::(Mutex|RwLock)", "std lock in async code"),
    LineRule("ERR001", "error-boundary", "info", r"\?\s*;?\s*$", "error passes a boundary without context", r"context\(|map_err|^\s*return |Ok\(", path=r"/(handlers|adapters|application)/"),
    LineRule("ORG001", "organization", "info", r"\b[0-9]{5,}\b", "magic number", r"^\s*(pub\s+)?(const|static)\b|^\s*#|assert|^\s*///", path=r"^(?!.*(constant|config)).*$"),
    LineRule("TST001", "testing", "info", r"#\[ignore\]", "ignored test", skip_tests=False),
    LineRule("TST002", "testing", "warning", r"\b(todo|unimplemented)!\s*\(", "stub macro", skip_tests=False),
    LineRule("IMPL005", "implementation", "warning", r"\b(todo|unimplemented)!\s*\(", "stub implementation"),
    LineRule("CFG001", "configuration", "warning", r"\"(https?://(localhost|127\.0\.0\.1)|[A-Za-z0-9.-]+:[0-9]{2,5})\"", "hard-coded address", r"^\s*//"),
    LineRule("VIS001", "visibility", "info", r"^\s*pub (fn|struct) (helper|internal|util)\w*", "helper is public"),
    LineRule("LAYER001", "layers", "error", r"^\s*use \w+_(infrastructure|server|providers)::", "forbidden import", path=r"/domain/"),
    LineRule("QUAL021", "quality", "info", r"#\[allow\(unused", "unused code is allowed"),
    LineRule("QUAL022", "quality", "info", r"#!?\[allow\(clippy::", "a lint is switched off"),
    LineRule("PAT001", "architecture", "warning", r"\bArc<(?!dyn\b|Mutex\b|RwLock\b|Atomic|str\b|\[)[A-Z]\w*>", "concrete type where an interface is injected", r"^\s*(let|//)", path=r"(?i)(di/|container|bootstrap)"),
    LineRule("PAT002", "architecture", "info", r"^\s*pub trait \w+\s*(<[^>]*>)?\s*\{", "trait without Send + Sync", path=r"/ports/"),
    LineRule("SOLID004", "solid", "warning", r"^\s*(pub\s+)?\w+\s*:\s*(Box|Arc)<(?!dyn\b)[A-Z]\w*(Service|Repository|Provider)>", "field depends on a concrete type"),
    LineRule("SOLID008", "solid", "info", r"\bmatch\s+[\w.]+\.as_str\(\)", "dispatch on strings"),
    LineRule("ORG003", "organization", "info", r"^\s*(pub\s+)?const \w+", "constant outside a constants module", path=r"^(?!.*(constant|config)).*$"),
    LineRule("IMPL006", "implementation", "warning", r"^\s*_\s*=>\s*(\{\s*\}|\(\))\s*,?\s*$", "catch-all arm does nothing"),
    LineRule("ERR002", "error-boundary", "warning", r"\b(std::io::Error|reqwest::Error|sqlx::Error)\b", "error type of an outer layer", path=r"/domain/"),
    LineRule("ERR003", "error-boundary", "warning", r"(Json|body|respond)\w*\(.*\b(err|error|e)\.to_string\(\)", "internal error text leaves the boundary", path=r"/handlers/"),
    LineRule("TST005", "testing", "warning", r"\bassert!\(\s*true\s*[,)]", "assertion that cannot fail", skip_tests=False),
    LineRule("CFG002", "configuration", "info", r"\"(Content-Type|Authorization|X-[A-Za-z-]+)\"", "hard-coded header", path=r"^(?!.*constant).*$"),
    LineRule("CFG003", "configuration", "info", r"\bnamespace\s*[:=]\s*\"", "hard-coded namespace"),
    LineRule("CA004", "clean-architecture", "warning", r"\b[A-Z]\w*(Service|Repository)::new\(", "handler builds its dependency", path=r"/handlers/"),
    LineRule("CA006", "clean-architecture", "warning", r"^\s*pub fn set_\w+\(&mut self", "value object can be changed", path=r"/value_objects/"),
    LineRule("LAYER003", "layers", "error", r"^\s*use (tokio|reqwest|axum|sqlx|redis)\b", "outer library in the domain", path=r"/domain/"),
    LineRule("PORT004", "ports", "warning", r"^\s*use .*::adapters?::\w+", "adapter uses another adapter", path=r"/adapters?/"),
    LineRule("VIS002", "visibility", "info", r"^\s*pub(\(crate\))? struct \w*(Internal|Private)\b", "internal type is visible"),
    LineRule("CA001", "clean-architecture", "error", r"^\s*use \w+_(infrastructure|server)::", "outer layer imported", path=r"/(domain|application)/"),
)


def production_lines(lines: DataFrame, key: str) -> DataFrame:
    """Lines before the file's first ``#[cfg(test)]`` that are no ``//`` comments."""
    cut = F.min(F.when(F.contains("line", F.lit("#[cfg(test)]")), F.col("line_no"))).over(W.partitionBy(key))
    cutoff = lines.withColumn("__cut", cut)
    return cutoff.where(F.col("__cut").isNull() | (F.col("line_no") < F.col("__cut"))).drop("__cut").where(~F.startswith(F.ltrim("line"), F.lit("//")))


def line_findings(lines: DataFrame, rules: tuple[LineRule, ...] = LINE_RULES, key: str = "file") -> DataFrame:
    """Findings of all rules on (file, line_no, line); ``line`` in a finding is 1-based."""

    def run(part: DataFrame, some: list[LineRule]) -> DataFrame:
        hits = []
        for r in some:
            ok = F.col("line").rlike(r.pattern)
            ok = ok & ~F.col("line").rlike(r.unless) if r.unless else ok
            ok = ok & F.col(key).cast("string").rlike(r.path) if r.path else ok
            hits.append(F.when(ok, F.struct(F.lit(r.id).alias("id"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.lit(r.message).alias("message"))))
        found = part.select(F.col(key).cast("string").alias("file"), (F.col("line_no") + 1).cast("long").alias("line"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r"))
        return found.select("r.id", "r.category", "r.severity", "file", "line", "r.message")

    tested, plain = [r for r in rules if r.skip_tests], [r for r in rules if not r.skip_tests]
    parts = ([run(production_lines(lines, key), tested)] if tested else []) + ([run(lines, plain)] if plain else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def justified(lines: DataFrame, hit: Column, reason: Column, key: str = "file", reach: int = 2) -> DataFrame:
    """Lines that ``hit``, with ``justified``: a reason within ``reach`` lines to either side."""
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(-reach, reach)
    return lines.withColumn("justified", F.max(reason.cast("int")).over(w) == 1).where(hit)


def nesting(lines: DataFrame, key: str = "file") -> DataFrame:
    """``lines`` with the depth of braces after each line; never reset."""
    net = F.regexp_count("line", F.lit(r"\{")) - F.regexp_count("line", F.lit(r"\}"))
    return lines.withColumn("depth", F.sum(net).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))


LOOP = re.compile(r"^\s*(for\b.*\bin\b|while\b|loop\b)")
ASYNC_FN = re.compile(r"\basync\s+(move\s+)?(fn|\{)")
BLOCK = re.compile(r"^\s*(?:pub(?:\([a-z]+\))?\s+)?(?:async\s+)?(fn|impl|trait|struct|enum|match)\b\s*([A-Za-z_]\w*)?")
IN_LOOP = (
    ("PERF001", "performance", "warning", re.compile(r"\.clone\(\)"), re.compile(r"^\s*(fn |let .*=|\w+:.*\.clone\(\),)|\.insert\(|\.push\("), "clone in a loop"),
    ("PERF002", "performance", "info", re.compile(r"\b(Vec::new|String::new|vec!|HashMap::new)\b"), None, "allocation in a loop"),
)
IN_ASYNC = (("ASYNC001", "async", "warning", re.compile(r"\bstd::(fs|thread)::|\bthread::sleep"), None, "blocking call in an async function"),)


def state_findings(rows: list[str]) -> list[tuple[str, str, str, int, str]]:
    """(id, category, severity, line, message) of the rules that hold inside loops and async functions.

    A region begins at its first line's brace and ends where the depth returns to
    what it was before, so an inner block's end does not end it.
    """
    out, depth, regions = [], 0, []
    for i, row in enumerate(rows):
        if "#[cfg(test)]" in row:
            break
        if row.lstrip().startswith("//"):
            continue
        inside = {kind for kind, _ in regions}
        for kind, checks in (("loop", IN_LOOP), ("async", IN_ASYNC)):
            if kind in inside:
                out += [(a, b, c, i + 1, msg) for a, b, c, p, unless, msg in checks if p.search(row) and not (unless and unless.search(row))]
        if LOOP.search(row):
            regions.append(("loop", depth))
        if ASYNC_FN.search(row):
            regions.append(("async", depth))
        depth += row.count("{") - row.count("}")
        if "}" in row:
            regions = [(k, d) for k, d in regions if depth > d]
    return out


def block_table(rows: list[str]) -> list[tuple[str, str | None, int, int, int]]:
    """(kind, name, start_line, end_line, items) of brace-matched blocks, 1-based.

    ``items``: methods of an impl or trait, fields of a struct or enum, arms of a match.
    """
    out, open_, depth = [], [], 0
    counted = {"impl": re.compile(r"^\s*(pub\s+)?(async\s+)?fn\b"), "trait": re.compile(r"^\s*(async\s+)?fn\b"), "struct": re.compile(r"^\s*(pub\s+)?\w+\s*:"),
               "enum": re.compile(r"^\s*[A-Z]\w*\s*[,({]?"), "match": re.compile(r"=>")}
    for i, row in enumerate(rows):
        if row.lstrip().startswith("//"):
            continue
        for b in open_:
            if depth == b[3] + 1 and b[0] in counted and counted[b[0]].search(row):
                b[4] += 1
        if (m := BLOCK.search(row)) or (m := re.search(r"\b(match)\b\s*()[^{]*\{\s*$", row)):
            open_.append([m[1], m[2] or None, i + 1, depth, 0])
        depth += row.count("{") - row.count("}")
        if "}" in row or ";" in row:
            for b in [b for b in open_ if depth <= b[3]]:
                out.append((b[0], b[1], b[2], i + 1, b[4]))
                open_.remove(b)
    return sorted(out, key=lambda b: b[2])


#: rule: (kind, what is counted, limit, category, message)
BLOCK_LIMITS = {
    "KISS005": ("fn", "lines", 50, "kiss", "function is long"),
    "KISS001": ("struct", "items", 7, "kiss", "struct has many fields"),
    "SOLID001": ("impl", "lines", 200, "solid", "impl block is long"),
    "SOLID002": ("match", "items", 10, "solid", "match has many arms"),
    "SOLID003": ("trait", "items", 10, "solid", "trait has many methods"),
    "SOLID007": ("impl", "items", 15, "solid", "impl block has many methods"),
    "PORT001": ("trait", "items", 10, "ports", "port is large"),
}


FUNCTION = re.compile(r"^\s*(pub(?:\([a-z]+\))?\s+)?(?:const\s+|async\s+|unsafe\s+)*fn\s+(\w+)")
ASSERTS = re.compile(r"\b(assert\w*|panic|unreachable|matches)!|\.unwrap_err\(|#\[should_panic")
BACKGROUND = ("spawn", "background", "graceful", "shutdown", "start", "run", "worker", "daemon", "listener", "handler", "process", "new", "with_", "init", "create", "build")


def functions(rows: list[str]) -> list[dict]:
    """Functions with name, line (1-based), parameters, body (stripped lines without
    comments), notes (comment lines), tests (whether #[test] stands above) and documented."""
    out, i = [], 0
    while i < len(rows):
        m = FUNCTION.search(rows[i])
        if not m or rows[i].lstrip().startswith("//"):
            i += 1
            continue
        head, j = rows[i], i
        while "{" not in head and ";" not in head and j + 1 < len(rows):
            j += 1
            head += " " + rows[j]
        above, k = [], i - 1
        while k >= 0 and re.match(r"\s*(#\[|///|//)", rows[k]):
            above.append(rows[k].strip())
            k -= 1
        f = {"name": m[2], "line": i + 1, "public": bool(m[1]), "parameters": parameters(head), "tests": any(re.match(r"#\[(\w+::)?test\b", a) for a in above),
             "documented": any(a.startswith("///") for a in above), "body": [], "notes": 0}
        if "{" in head and head.index("{") < (head.index(";") if ";" in head.split("{")[0] else len(head)):
            depth, text = 0, []
            for r in [head[head.index("{") :], *rows[j + 1 :]]:
                depth += r.count("{") - r.count("}")
                text.append(r)
                if depth <= 0:
                    break
            whole = "\n".join(text).strip()[1:]
            whole = whole[: whole.rindex("}")] if "}" in whole else whole
            inner = [r.strip() for r in whole.split("\n") if r.strip()]
            f["notes"] = sum(r.startswith("//") for r in inner)
            f["body"] = [r for r in inner if not r.startswith("//")]
            out.append(f)
        i = j + 1
    return out


def parameters(head: str) -> int:
    """Parameters of a signature besides self."""
    at = head.index("(") if "(" in head else len(head)
    depth, parts, part = 0, [], ""
    for c in head[at:]:
        depth += (c in "([{<") - (c in ")]}>")
        if depth == 0:
            break
        if c == "," and depth == 1:
            parts.append(part)
            part = ""
        elif not (c == "(" and depth == 1 and not part):
            part += c
    return sum(bool(p.strip()) and not re.fullmatch(r"(&\s*)?('\w+\s+)?(mut\s+)?self(:.*)?", p.strip()) for p in [*parts, part])


def function_findings_of(rows: list[str]) -> list[tuple[str, str, str, int, str]]:
    """(id, category, severity, line, message) of the rules on single functions."""
    out = []
    cut = next((i for i, r in enumerate(rows) if "#[cfg(test)]" in r), len(rows))
    for f in functions(rows):
        body, add = f["body"], lambda i, c, s, m, line=f["line"]: out.append((i, c, s, line, m))
        one = body[0].rstrip(";") if len(body) == 1 else ""
        if f["tests"]:
            if not f["name"].startswith("test_"):
                add("TEST003", "testing", "info", "test's name does not begin with test_")
            if not body:
                add("TEST007" if f["notes"] else "TST003", "testing", "warning", "test holds only comments" if f["notes"] else "test is empty")
            elif not any(ASSERTS.search(r) for r in body):
                unwraps = any(".unwrap()" in r for r in body)
                add("TEST006" if unwraps else "TEST004", "testing", "warning", "test asserts nothing but unwrap" if unwraps else "test has no assertion")
            if not f["documented"]:
                add("TST004", "testing", "info", "test lacks documentation")
        elif f["line"] <= cut:
            if f["parameters"] > 5:
                add("KISS002", "kiss", "warning", "function has many parameters")
            if not body:
                add("IMPL001", "implementation", "warning", "function is empty")
            elif re.fullmatch(r"(return\s+)?(Ok\()?(true|false|None|\d+|\"[^\"]*\"(\.to_string\(\)|\.into\(\))?|Vec::new\(\)|String::new\(\)|\(\))\)?", one):
                add("IMPL002", "implementation", "info", "function returns a fixed value")
            elif re.fullmatch(r"self\.\w+\." + re.escape(f["name"]) + r"\([\w\s,&]*\)(\.await)?\??", one):
                add("IMPL003", "implementation", "info", "function only passes its call on")
            elif all(re.match(r"(log::|tracing::)?(trace|debug|info|warn|error|println|eprintln)!\(.*\);?$|Ok\(\(\)\)$", r) for r in body):
                add("IMPL004", "implementation", "info", "function only logs")
            if any("tokio::spawn(" in r and not re.search(r"\blet\b|=\s*tokio|\.await|\.push\(", r) for r in body) and not any(w in f["name"] for w in BACKGROUND):
                add("ASYNC004", "async", "info", "spawned task is not awaited")
    return out


def file_findings_of(rows: list[str]) -> list[tuple[str, str, str, int, str]]:
    """Rules on a whole file: its length, module documentation, nesting, and its blocks' make-up."""
    out, depth, base = [], 0, []
    if len(rows) > 500:
        out.append(("QUAL004", "quality", "warning", 1, "file has more than 500 lines"))
    if any(r.strip() for r in rows) and not next(r for r in rows if r.strip()).lstrip().startswith("//!"):
        out.append(("DOC001", "documentation", "info", 1, "module lacks documentation"))
    last = -5
    for i, r in enumerate(rows):
        if "#[cfg(test)]" in r:
            break
        if FUNCTION.search(r):
            base.append(depth)
        depth += r.count("{") - r.count("}")
        while base and "}" in r and depth <= base[-1]:
            base.pop()
        # a function's own brace is the first level; one finding in five lines
        if base and depth - base[-1] - 1 > 3 and "{" in r and i - last >= 5:
            out.append(("KISS004", "kiss", "warning", i + 1, "code is nested deeper than three levels"))
            last = i
    found = block_table(rows)
    structs = [b for b in found if b[0] == "struct"]
    if len(structs) > 3 and len({(re.match(r"[A-Z][a-z0-9]*", b[1] or "") or [""])[0] for b in structs}) > 3:
        out.append(("SOLID005", "solid", "info", structs[0][2], "file defines several unrelated structs"))
    for kind, _, start, end, _ in found:
        text = rows[start - 1 : end]
        if kind == "impl" and any(re.search(r"\b(todo|unimplemented)!", r) for r in text):
            out.append(("SOLID006", "solid", "warning", start, "impl block is not complete"))
        if kind == "struct" and "Builder" in text[0] and sum("Option<" in r for r in text) > 7:
            out.append(("KISS003", "kiss", "warning", start, "builder has many optional fields"))
        if kind == "trait" and sum(bool(FUNCTION.search(r)) for r in text) < 2:
            out.append(("PORT002", "ports", "info", start, "port is small"))
        if kind == "trait" and any("async fn" in r for r in text) and (start < 2 or "async_trait" not in rows[start - 2]):
            out.append(("PAT003", "architecture", "info", start, "trait with async functions lacks async_trait"))
    tests = [i for i, r in enumerate(rows) if "#[cfg(test)]" in r]
    if tests and tests[0] + 1 < len(rows) and re.match(r"\s*mod tests?\b", rows[tests[0] + 1]):
        out.append(("TEST001", "testing", "info", tests[0] + 1, "tests stand in the source file"))
    return out


def _per_file(files: DataFrame, key: str, text: str, schema: str, rows_of) -> DataFrame:
    kind = files.schema[key].dataType.simpleString()
    names = [key, *[x.split()[0] for x in schema.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, *r) for k, t in zip(b[key], b[text], strict=True) for r in rows_of((t or "").split("\n"))], columns=names)

    return files.select(key, text).mapInPandas(run, f"{key} {kind}, {schema}")


def blocks(files: DataFrame, key: str = "file", text: str = "content") -> DataFrame:
    return _per_file(files, key, text, "kind string, name string, start_line long, end_line long, items long", block_table)


def block_findings(found: DataFrame, key: str = "file") -> DataFrame:
    parts = []
    for rule, (kind, what, limit, category, message) in BLOCK_LIMITS.items():
        n = F.col("end_line") - F.col("start_line") + 1 if what == "lines" else F.col("items")
        f = F.struct(F.lit(rule).alias("id"), F.lit(category).alias("category"), F.lit("warning").alias("severity"), F.lit(message).alias("message"))
        parts.append(F.when((F.col("kind") == kind) & (n > limit), f))
    hit = found.select(F.col(key).cast("string").alias("file"), F.col("start_line").alias("line"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("r"))
    return hit.select("r.id", "r.category", "r.severity", "file", "line", "r.message")


def stateful_findings(files: DataFrame, key: str = "file", text: str = "content") -> DataFrame:
    out = _per_file(files, key, text, "id string, category string, severity string, line long, message string", state_findings)
    return out.select("id", "category", "severity", F.col(key).cast("string").alias("file"), "line", "message")


def _rows_as_findings(files: DataFrame, key: str, text: str, of) -> DataFrame:
    out = _per_file(files, key, text, "id string, category string, severity string, line long, message string", of)
    return out.select("id", "category", "severity", F.col(key).cast("string").alias("file"), "line", "message")


def function_findings(files: DataFrame, key: str = "file", text: str = "content") -> DataFrame:
    return _rows_as_findings(files, key, text, function_findings_of)


def file_findings(files: DataFrame, key: str = "file", text: str = "content") -> DataFrame:
    return _rows_as_findings(files, key, text, file_findings_of)


def path_findings(files: DataFrame, key: str = "file") -> DataFrame:
    """NAME004: a source file's name is not snake_case.  TEST002: a file in tests/ is not named for its kind."""
    name = F.regexp_extract(F.col(key), r"([^/]+)\.rs$", 1)
    rules = (
        ("NAME004", "naming", (name != "") & ~T.is_snake_case(name), "file is not snake_case"),
        ("TEST002", "testing", F.col(key).rlike(r"/tests/.*\.rs$") & ~name.rlike(r"(_tests?|^mod|^test_.*|^integration.*|^common|^utils)$"), "test file is not named for its kind"),
    )
    hits = [F.when(ok, F.struct(F.lit(i).alias("id"), F.lit(c).alias("category"), F.lit(m).alias("message"))) for i, c, ok, m in rules]
    out = files.select(F.col(key).cast("string").alias("file"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r"))
    return out.select("r.id", "r.category", F.lit("info").alias("severity"), "file", F.lit(1).cast("long").alias("line"), "r.message")


def utility_findings(lines: DataFrame, key: str = "file", limit: int = 3) -> DataFrame:
    """VIS003: a utility module with more than ``limit`` public functions."""
    pub = lines.where(F.col(key).rlike(r"(utils?|helpers?)(/mod)?\.rs$") & F.col("line").rlike(r"^\s*pub fn\b"))
    many = pub.groupBy(F.col(key).cast("string").alias("file")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return many.select(F.lit("VIS003").alias("id"), F.lit("visibility").alias("category"), F.lit("info").alias("severity"), "file", F.lit(1).cast("long").alias("line"), F.lit("utility module has many public functions").alias("message"))


def naming_findings(lines: DataFrame, key: str = "file") -> DataFrame:
    """NAME001 types, NAME002 functions, NAME003 constants that miss their case."""
    name = lambda p: F.regexp_extract("line", p, 1)
    kinds = (
        ("NAME001", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)", T.is_camel_case, "type is not CamelCase"),
        ("NAME002", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)", T.is_snake_case, "function is not snake_case"),
        ("NAME003", r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)\s*:", T.is_screaming_case, "constant is not SCREAMING_CASE"),
    )
    hits = [F.when((name(p) != "") & ~ok(name(p)), F.struct(F.lit(i).alias("id"), F.lit(m).alias("message"))) for i, p, ok, m in kinds]
    out = production_lines(lines, key).select(F.col(key).cast("string").alias("file"), (F.col("line_no") + 1).cast("long").alias("line"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("r"))
    return out.select("r.id", F.lit("naming").alias("category"), F.lit("warning").alias("severity"), "file", "line", "r.message")


def undocumented(lines: DataFrame, key: str = "file") -> DataFrame:
    """DOC002: public items whose line before is neither a doc comment nor an attribute."""
    before = F.lag("line").over(W.partitionBy(key).orderBy("line_no"))
    hit = lines.withColumn("__b", F.coalesce(before, F.lit(""))).where(F.col("line").rlike(r"^\s*pub (fn|struct|enum|trait|async fn)\b") & ~F.col("__b").rlike(r"^\s*(///|#\[)"))
    return hit.select(F.lit("DOC002").alias("id"), F.lit("documentation").alias("category"), F.lit("warning").alias("severity"), F.col(key).cast("string").alias("file"), (F.col("line_no") + 1).cast("long").alias("line"), F.lit("public item lacks documentation").alias("message"))


def duplicate_literals(lines: DataFrame, pattern: str, least_length: int = 15, least_files: int = 4, key: str = "file") -> DataFrame:
    """value, files, occurrences of literals in at least ``least_files`` files."""
    each = lines.select(key, F.explode(F.regexp_extract_all("line", F.lit(pattern), F.lit(0))).alias("value")).where(F.char_length("value") >= least_length)
    return each.groupBy("value").agg(F.count_distinct(key).alias("files"), F.count(F.lit(1)).alias("occurrences")).where(F.col("files") >= least_files)


def duplicate_definitions(defs: DataFrame, name: str, owner: str, folder: str) -> DataFrame:
    """name, owners, folders, kind of names defined in several owners, or several folders of one."""
    by = defs.groupBy(F.col(name).alias("name")).agg(F.count_distinct(owner).alias("owners"), F.count_distinct(folder).alias("folders"))
    return by.where("owners > 1 or folders > 1").withColumn("kind", F.when(F.col("owners") > 1, "across").otherwise("within"))


def summary(findings: DataFrame) -> DataFrame:
    """category, severity, n."""
    return findings.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))


def totals(findings: DataFrame) -> DataFrame:
    """One row: total, errors, warnings, infos, passed."""
    n = lambda s: F.count_if(F.col("severity") == s)
    return findings.agg(F.count(F.lit(1)).alias("total"), n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos")).withColumn("passed", F.col("errors") == 0)


def by_category(findings: DataFrame) -> DataFrame:
    """category, n, entries: the report's nested form, entries sorted."""
    entry = F.struct("id", "file", "line", "severity", "message")
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(entry)).alias("entries"))


def ci_annotations(findings: DataFrame) -> DataFrame:
    """One workflow annotation a finding; infos are left out."""
    kept = findings.where("severity in ('error', 'warning')")
    return kept.select(F.format_string("::%s file=%s,line=%d::[%s] %s", "severity", "file", "line", "id", "message").alias("annotation"))


VALIDATORS = {
    "lines": lambda files, lines: line_findings(lines),
    "naming": lambda files, lines: naming_findings(lines),
    "documentation": lambda files, lines: undocumented(lines),
    "state": lambda files, lines: stateful_findings(files),
    "blocks": lambda files, lines: block_findings(blocks(files)),
    "functions": lambda files, lines: function_findings(files),
    "files": lambda files, lines: file_findings(files),
    "paths": lambda files, lines: path_findings(files),
    "utilities": lambda files, lines: utility_findings(lines),
}


def validate(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """UNION ALL of the named validators (all by default) on (file, content).

    A validator whose plan is refused is skipped with a warning.
    """
    lines = T.line_table(files.select("file", "content"))
    out = None
    for n in names or VALIDATORS:
        try:
            part = VALIDATORS[n](files, lines)
        except AnalysisException as e:
            warnings.warn(f"validator {n} is skipped: {e}", stacklevel=2)
            continue
        out = part if out is None else out.unionByName(part)
    return out
