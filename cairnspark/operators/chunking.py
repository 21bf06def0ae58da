"""Language detection and chunking."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.batches import in_frames
from ..functions.text import lines, trim
from ..sources.tables import extension

WINDOW_LINES, MIN_BYTES, MAX_CHUNKS, CONTEXT_LINES = 15, 20, 50, 3
#: Least bytes of a chunk that a syntax tree gives.
MIN_NODE_BYTES = 30
#: What a text that is no Python, or is nested too deeply for the parser, raises.
UNPARSED = (SyntaxError, ValueError, RecursionError, MemoryError)

# Extensions by language.
LANGUAGES = {
    "rust": ("rs",),
    "python": ("py", "pyw", "pyi"),
    "javascript": ("js", "mjs", "cjs", "jsx"),
    "typescript": ("ts", "tsx", "mts", "cts"),
    "go": ("go",),
    "java": ("java",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx", "hh"),
    "csharp": ("cs",),
    "ruby": ("rb", "rake", "gemspec"),
    "php": ("php", "phtml"),
    "swift": ("swift",),
    "kotlin": ("kt", "kts"),
}
# Patterns that start a block, by language; see chunk_by_pattern.
_C_FUNCTION = r"^[a-zA-Z_].*\(.*\)\s*\{"
BLOCK_STARTS = {
    "python": (r"^(async )?def ", r"^class "),
    "go": (r"^func ", r"^type "),
    "javascript": (r"^(export )?(async )?function ", r"^(export )?class "),
    "rust": (r"^(pub )?(async )?fn ", r"^(pub )?(struct|enum|trait) ", r"^impl\b"),
    "java": (r"^(public|private|protected) ", r"^(class|interface) "),
    "typescript": (r"^function ", r"^class ", r"^const .* = ", r"^export ", r"^interface ", r"^type "),
    "c": (_C_FUNCTION,),
    "cpp": (r"^class ", r"^struct ", _C_FUNCTION),
    "csharp": (r"^\s*public ", r"^\s*private ", r"^\s*class ", r"^\s*interface "),
    "ruby": (r"^def ", r"^class ", r"^module "),
    "php": (r"^function ", r"^\s*public function ", r"^class "),
    "swift": (r"^func ", r"^class ", r"^struct ", r"^protocol "),
    "kotlin": (r"^fun ", r"^class ", r"^data class ", r"^object "),
}


def language_of(path: Column, languages: dict[str, tuple[str, ...]] = LANGUAGES) -> Column:
    """Language by extension, "unknown" for others; the table is a parameter."""
    ext, out = extension(path), F.lit("unknown")
    for name, known in languages.items():
        out = F.when(ext.isin(*known), name).otherwise(out)
    return out


def chunk_by_lines(files: DataFrame, text: str = "content", size: int = WINDOW_LINES) -> DataFrame:
    """Windows of ``size`` lines: the other columns, chunk_no, start_line, end_line (0-based), content.

    Chunks of less than 20 bytes after trimming are dropped but counted in
    chunk_no.  No shuffle: a file's windows are slices of its own lines.
    """
    rest = [c for c in files.columns if c != text]

    def window(ls: Column) -> Column:
        last = F.size(ls) - 1
        starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts,
            lambda s: F.struct(
                (s / size).cast("long").alias("chunk_no"), s.cast("long").alias("start_line"),
                F.least(s + size - 1, last).cast("long").alias("end_line"),
                trim(F.array_join(F.slice(ls, s + 1, F.lit(size)), "\n")).alias("content"),
            ),
        )

    windows = F.transform(F.array(lines(F.col(text))), window)[0]
    out = files.select(*rest, F.inline(windows).alias("chunk_no", "start_line", "end_line", "content"))
    return out.where(F.octet_length("content") >= MIN_BYTES)


def pattern_blocks(text: str, starts: list) -> list[tuple[int, int, str]]:
    """(start, end, content) of a text's blocks.

    A line that matches opens a block and closes the one before; a block also
    closes after more than two lines whose braces balance; the last ends with
    the text.  Lines outside a block are dropped.
    """
    body = text[:-1] if text.endswith("\n") else text
    rows = [x.removesuffix("\r") for x in body.split("\n")] if text else []
    out: list[tuple[int, int, str]] = []
    held: list[str] = []
    first = opened = closed = 0

    def close(last: int) -> None:
        content = "\n".join(held).strip()
        if len(content.encode()) >= MIN_BYTES:
            out.append((first, last, content))

    for i, row in enumerate(rows):
        if any(p.search(row.strip()) for p in starts):
            if held:
                close(i - 1)
            held, first, opened, closed = [row], i, row.count("{"), row.count("}")
        elif held:
            held.append(row)
            opened, closed = opened + row.count("{"), closed + row.count("}")
            if opened == closed > 0 and len(held) > 2:
                close(i)
                held = []
    if held:
        close(len(rows) - 1)
    return out


def chunk_by_pattern(files: DataFrame, patterns: tuple[str, ...], key: str = "doc_id", text: str = "content") -> DataFrame:
    """key, start_line, end_line, content of the blocks; see pattern_blocks."""
    import re

    compiled = [re.compile(p) for p in patterns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = ((k, *x) for k, t in zip(b[key], b[text], strict=True) for x in pattern_blocks(t or "", compiled))
            yield from in_frames(rows, [key, "start_line", "end_line", "content"])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, text).mapInPandas(run, f"{key} {kind}, start_line long, end_line long, content string")


def best_chunks(chunks: DataFrame, key: str, priority: Column, limit: int = MAX_CHUNKS) -> DataFrame:
    """At most ``limit`` chunks a file, by priority descending, then start line."""
    w = W.partitionBy(key).orderBy(F.desc("priority"), "start_line")
    ranked = chunks.withColumn("priority", priority).withColumn("position", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("position") <= limit)


def priority_of(content: Column, n_lines: Column) -> Column:
    """Priority by the first preset whose least bytes and lines a chunk reaches, else null."""
    size = F.octet_length(content)
    return F.when((size >= 40) & (n_lines >= 2), 10).when((size >= 25) & (n_lines >= 1), 5).when((size >= 15) & (n_lines >= 1), 1)


def with_context(chunks: DataFrame, files: DataFrame, key: str, text: str = "content", reach: int = CONTEXT_LINES) -> DataFrame:
    """key, start_line, context: the chunk's first line and ``reach`` lines to either side."""
    at = chunks.select(key, "start_line")
    both = at.join(files.select(key, lines(F.col(text)).alias("ls")), key)
    lo = F.greatest(F.col("start_line") - reach, F.lit(0)).cast("int")
    hi = F.least(F.col("start_line") + reach, F.size("ls") - 1).cast("int")
    return both.select(key, "start_line", F.array_join(F.slice("ls", lo + 1, hi - lo + 1), "\n").alias("context"))


def python_nodes(source: str) -> list[tuple]:
    """(node_id, parent_id, depth, kind, name, start_line, end_line, parameters, is_async, has_return_type) of Python source."""
    out: list[tuple] = []

    def walk(node: ast.AST, parent: int, depth: int) -> None:
        me = parent
        if isinstance(node, ast.stmt | ast.ExceptHandler | ast.Call):
            me = len(out)
            args = getattr(node, "args", None)
            count = len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs) if isinstance(args, ast.arguments) else None
            out.append((me, parent, depth, type(node).__name__, getattr(node, "name", None), node.lineno, node.end_lineno, count,
                        isinstance(node, ast.AsyncFunctionDef), getattr(node, "returns", None) is not None))
            depth += 1
        for child in ast.iter_child_nodes(node):
            walk(child, me, depth)

    walk(ast.parse(source), -1, 0)
    return out


NODE_SCHEMA = "node_id long, parent_id long, depth long, kind string, name string, start_line long, end_line long, parameters long, is_async boolean, has_return_type boolean"


def ast_nodes(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """key and the flat node table of Python files; files that do not parse give no rows."""
    kind = files.schema[key].dataType.simpleString()
    names = [key, *[x.split()[0] for x in NODE_SCHEMA.split(", ")]]

    def rows(b: pd.DataFrame) -> Iterator[tuple]:
        for k, t in zip(b[key], b[text], strict=True):
            try:
                nodes = python_nodes(t or "")
            except UNPARSED:
                continue
            yield from ((k, *x) for x in nodes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for out in in_frames(rows(b), names):
                out["parameters"] = out["parameters"].astype("Int64")
                yield out

    return files.select(key, text).mapInPandas(run, f"{key} {kind}, {NODE_SCHEMA}")


def query_nodes(nodes: DataFrame, kind: str, key: str = "path", name_like: str | None = None, child: str | None = None, without_child: str | None = None) -> DataFrame:
    """Nodes of a kind, by name pattern and by kinds of children they must or must not have."""
    out = nodes.where(F.col("kind") == kind)
    if name_like is not None:
        out = out.where(F.col("name").rlike(name_like))
    for want, how in ((child, "left_semi"), (without_child, "left_anti")):
        if want is not None:
            kids = nodes.where(F.col("kind") == want).select(F.col(key).alias("__k"), F.col("parent_id").alias("__p"))
            out = out.join(kids, (F.col(key) == F.col("__k")) & (F.col("node_id") == F.col("__p")), how)
    return out


def structure_chunks(language: str, text: str, starts: dict[str, list]) -> list[tuple[int, int, str]]:
    """(start, end, content) of one file by its structure: Python that parses by its
    top definitions, all else by its language's patterns."""
    if language == "python":
        try:
            nodes = python_nodes(text)
        except UNPARSED:
            return pattern_blocks(text, starts["python"])
        rows = [x.removesuffix("\r") for x in text.split("\n")]
        top = [(n[5] - 1, n[6] - 1) for n in nodes if n[3] in ("FunctionDef", "AsyncFunctionDef", "ClassDef") and n[2] <= 2]
        out = [(i, j, "\n".join(rows[i : j + 1]).strip()) for i, j in top]
        return [x for x in out if len(x[2].encode()) >= MIN_NODE_BYTES]
    return pattern_blocks(text, starts[language]) if language in starts else []


def chunk_dispatch(files: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Each file by the best chunker there is: Python by its syntax tree, other known
    languages, and Python that does not parse, by block patterns; whatever gives
    no chunk by windows of lines.  All languages are cut in one scan."""
    import re

    starts = {name: [re.compile(p) for p in patterns] for name, patterns in BLOCK_STARTS.items()}
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = ((k, *x) for k, t, n in zip(b[key], b[text], b["language"], strict=True) for x in structure_chunks(n, t or "", starts))
            yield from in_frames(rows, [key, "start_line", "end_line", "content"])

    known = files.select(key, text, language_of(F.col(key)).alias("language"))
    out = known.where(F.col("language").isin(*BLOCK_STARTS)).mapInPandas(run, f"{key} {kind}, start_line long, end_line long, content string").withColumn("chunker", F.lit("structure"))
    rest = known.join(out.select(key).distinct(), key, "left_anti").select(key, text)
    plain = chunk_by_lines(rest.withColumnRenamed(text, "content")).select(key, "start_line", "end_line", "content")
    return out.unionByName(plain.withColumn("chunker", F.lit("lines")))
