"""The tree of a source file's blocks, without a parser.

Blocks are nested intervals.  In brace languages each brace is an event and a
block goes from an opening one to the closing one of its depth; in languages by
indentation a header ends with a colon and its block goes on until a line that
is indented no deeper.  Depths are running sums, partners and parents are the
next or last row of the same depth: windows over a file's events, linear in
them.  A node has its place on opening and on closing (``pre``, ``post``), so it
is an ancestor of another if it encloses that one's interval.

Strings, character literals and comments are blanked first, a line at a time
(block comments over several lines too).  A closing brace without an opening
one is skipped; an opening one without a closing one goes on to the file's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: kind: what a block's header looks like, in the order in which they are tried; the first group is its name.
KINDS = {
    "function": r"\b(?:fn|func|function|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)",
    "implementation": r"\bimpl\b(?:<[^>]*>)?\s*(?:[\w:<>, ]+\s+for\s+)?([A-Za-z_]\w*)",
    "type": r"\b(?:struct|class|enum|trait|interface|union|record)\s+([A-Za-z_]\w*)",
    "module": r"\b(?:mod|namespace|module|package)\s+([A-Za-z_]\w*)",
    "match": r"\b(?:match|switch)\b()",
    "loop": r"\b(?:for|while|loop)\b()",
    "condition": r"\b(?:if|else|elif|unless)\b()",
    "handler": r"\b(?:try|catch|except|finally|with)\b()",
    "method": r"([A-Za-z_]\w*)\s*\([^;=]*\)\s*(?:const\s*|throws\s[\w, .]+)?$",
}
INDENTED = ("py", "pyw")
BRANCHES = ("condition", "loop", "match", "handler")


def code_lines(lines: DataFrame, key: str = "file") -> DataFrame:
    """``lines`` (key, line_no, line) with ``code``: the line without strings and comments.

    A hash opens a comment only in languages by indentation.
    """
    c = F.regexp_replace("line", r"""b?r?"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])'""", '""')
    c = F.regexp_replace(c, r"/\*.*?\*/", " ")
    by_indent = F.regexp_extract(F.col(key), r"\.(\w+)$", 1).isin(*INDENTED)
    c = F.when(by_indent, F.regexp_replace(c, r"#.*$", "")).otherwise(F.regexp_replace(c, r"//.*$", ""))
    # within a comment of several lines: more were opened than closed before this line
    opened = F.when(by_indent, 0).otherwise(c.contains("/*").cast("int") - c.contains("*/").cast("int"))
    before = F.coalesce(F.sum("__o").over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = lines.withColumn("code", c).withColumn("__o", opened).withColumn("__b", before)
    cut = F.when(F.col("__b") <= 0, F.regexp_replace("code", r"/\*.*$", "")).when(F.col("code").contains("*/"), F.regexp_replace("code", r"^.*\*/", "")).otherwise("")
    return out.withColumn("code", cut).drop("__o", "__b")


def kind_of(header: Column) -> tuple[Column, Column]:
    """Kind (``block`` if none fits) and name of a block's header."""
    kind, name = F.lit("block"), F.lit("")
    for k, p in reversed(KINDS.items()):
        kind = F.when(header.rlike(p), k).otherwise(kind)
        name = F.when(header.rlike(p), F.regexp_extract(header, p, 1)).otherwise(name)
    return kind, F.nullif(name, F.lit(""))


def brace_blocks(code: DataFrame, key: str = "file") -> DataFrame:
    """key, pre, post, depth, start_line, end_line, header of brace-delimited blocks; ``code`` has key, line_no, code."""
    marks = F.regexp_replace("code", r"[^{}]", "")
    each = F.posexplode(F.filter(F.split(marks, ""), lambda x: x != "")).alias("at", "mark")
    events = code.where(F.length(marks) > 0).select(key, "line_no", "code", each)
    # the text between this brace and the one before it
    piece = F.get(F.split("code", r"[{}]"), F.col("at"))
    order = W.partitionBy(key).orderBy("line_no", "at")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    step = F.when(F.col("mark") == "{", 1).otherwise(-1)
    events = events.select(key, "line_no", "mark", F.trim(piece).alias("header"), F.row_number().over(order).alias("seq"), F.sum(step).over(upto).alias("sum"))
    by_seq = W.partitionBy(key).orderBy("seq")
    low = F.least(F.min("sum").over(by_seq.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    before = F.coalesce(F.least(F.min("sum").over(by_seq.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    events = events.withColumn("low", low).withColumn("before", before).where("mark = '{' or low = before")
    # an opening brace and its partner have one depth
    events = events.withColumn("depth", F.col("sum") - F.col("low") + F.when(F.col("mark") == "{", 0).otherwise(1))
    same = W.partitionBy(key, "depth").orderBy("seq")
    events = events.withColumn("post", F.lead("seq").over(same)).withColumn("end_line", F.lead("line_no").over(same))
    last = code.groupBy(F.col(key).alias("__k")).agg(F.max("line_no").alias("__last"))
    out = events.where("mark = '{'").join(last, F.col(key) == F.col("__k"))
    return out.select(
        key, F.col("seq").cast("long").alias("pre"), F.coalesce("post", F.lit(2**31)).cast("long").alias("post"), F.col("depth").cast("int").alias("depth"),
        F.col("line_no").alias("start_line"), F.coalesce("end_line", "__last").alias("end_line"), "header",
    )


def indent_blocks(code: DataFrame, key: str = "file") -> DataFrame:
    """The same for blocks by indentation; a tab counts as eight spaces."""
    spaces = F.length(F.regexp_replace(F.regexp_extract("code", r"^([ \t]*)", 1), "\t", " " * 8))
    rows = code.where(F.length(F.trim("code")) > 0).select(key, "line_no", "code", spaces.alias("indent"), F.rtrim("code").endswith(":").alias("opens"))
    levels = rows.where("opens").groupBy(F.col(key).alias("__k")).agg(F.collect_set("indent").alias("levels"))
    # a line ends the blocks of all levels that are indented no less; a file has few levels
    ends = rows.join(levels, F.col(key) == F.col("__k")).select(key, "line_no", "code", "indent", "opens", F.explode(F.filter("levels", lambda x: x >= F.col("indent"))).alias("level"))
    nxt = F.lead("line_no").over(W.partitionBy(key, "level").orderBy("line_no"))
    before = F.lag("line_no").over(W.partitionBy(key).orderBy("line_no"))
    opened = ends.withColumn("__end", nxt).where("opens and level = indent")
    back = rows.select(F.col(key).alias("__k"), F.col("line_no").alias("__l"), before.alias("__p"))
    last = rows.groupBy(F.col(key).alias("__f")).agg(F.max("line_no").alias("__last"))
    out = opened.join(back, (F.col(key) == F.col("__k")) & (F.col("__end") == F.col("__l")), "left").join(last, F.col(key) == F.col("__f"))
    out = out.select(key, F.col("line_no").alias("start_line"), F.coalesce("__p", "__last").alias("end_line"), F.trim("code").alias("header"))
    # depth: how many begin before and have not ended; order of opening, and of closing after all that lie inside
    marks = out.select(key, F.explode(F.array(F.struct(F.col("start_line").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end_line") + 1).alias("at"), F.lit(-1).alias("d")))).alias("m")).select(key, "m.*")
    run = marks.groupBy(key, "at").agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("opened"), F.sum(F.when(F.col("d") < 0, 1).otherwise(0)).alias("closed"))
    w = W.partitionBy(key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    run = run.select(F.col(key).alias("__k"), F.col("at").alias("__at"), F.sum(F.col("opened") - F.col("closed")).over(w).alias("depth"))
    out = out.join(run, (F.col(key) == F.col("__k")) & (F.col("start_line") == F.col("__at")))
    pre = F.col("start_line") * 2
    return out.select(key, pre.cast("long").alias("pre"), (F.col("end_line") * 2 + 1).cast("long").alias("post"), F.col("depth").cast("int").alias("depth"), "start_line", "end_line", "header")


def block_nodes(lines: DataFrame, key: str = "file") -> DataFrame:
    """key, pre, post, depth, parent (its pre, null at the top), kind, name, start_line, end_line, header of all files' blocks."""
    code = code_lines(lines, key)
    by_indent = F.regexp_extract(F.col(key), r"\.(\w+)$", 1).isin(*INDENTED)
    nodes = brace_blocks(code.where(~by_indent), key).unionByName(indent_blocks(code.where(by_indent), key))
    # a parent is the last node before that is one level up
    both = nodes.select("*", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(False).alias("up")), F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("up")))).alias("r")).select("*", "r.level", "r.up").drop("r")
    w = W.partitionBy(key, "level").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("parent", F.last(F.when(F.col("up"), F.col("pre")), ignorenulls=True).over(w)).where("not up")
    kind, name = kind_of(F.col("header"))
    return both.select(key, "pre", "post", "depth", "parent", kind.alias("kind"), name.alias("name"), "start_line", "end_line", "header")


def ancestors(nodes: DataFrame, key: str = "file") -> DataFrame:
    """key, pre, ancestor (pre), distance: one row for each node and each block around it."""
    own = F.struct(F.col("depth").alias("level"), F.lit(True).alias("is"))
    asks = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda d: F.struct(d.alias("level"), F.lit(False).alias("is")))
    rows = nodes.select(key, "pre", "depth", F.explode(F.when(F.col("depth") > 1, F.concat(F.array(own), asks)).otherwise(F.array(own))).alias("r")).select(key, "pre", "depth", "r.*")
    w = W.partitionBy(key, "level").orderBy("pre").rowsBetween(W.unboundedPreceding, -1)
    found = rows.withColumn("ancestor", F.last(F.when(F.col("is"), F.col("pre")), ignorenulls=True).over(w)).where("not is")
    return found.select(key, "pre", "ancestor", (F.col("depth") - F.col("level")).alias("distance"))


def select_nodes(
    nodes: DataFrame, kind: str | None = None, where: Column | None = None, name_like: str | None = None,
    has_child: str | None = None, no_child: str | None = None, inside: str | None = None, key: str = "file",
) -> DataFrame:
    """Nodes of a kind that meet all conditions: a Column over their fields, a pattern of
    the name, a child of a kind or none, a block of a kind around them."""
    out = nodes if kind is None else nodes.where(F.col("kind") == kind)
    out = out if where is None else out.where(where)
    out = out if name_like is None else out.where(F.col("name").rlike(name_like))
    for child, how in ((has_child, "left_semi"), (no_child, "left_anti")):
        if child is not None:
            parents = nodes.where((F.col("kind") == child) & F.col("parent").isNotNull()).select(key, F.col("parent").alias("pre")).distinct()
            out = out.join(parents, [key, "pre"], how)
    if inside is not None:
        around = nodes.where(F.col("kind") == inside).select(key, F.col("pre").alias("ancestor"))
        out = out.join(ancestors(nodes, key).join(around, [key, "ancestor"]).select(key, "pre").distinct(), [key, "pre"], "left_semi")
    return out


def function_metrics(nodes: DataFrame, lines: DataFrame, key: str = "file") -> DataFrame:
    """For each function: lines, blank and comment lines left out (sloc), parameters, branches
    below it (cyclomatic complexity less one), and how deep they nest (cognitive: each counts its depth)."""
    fn = nodes.where("kind in ('function', 'method')").select(key, F.col("pre").alias("fn"), "name", "start_line", "end_line", F.col("depth").alias("fn_depth"), "header")
    inner = nodes.where(F.col("kind").isin(*BRANCHES)).join(ancestors(nodes, key), [key, "pre"]).select(key, "pre", "depth", F.col("ancestor").alias("fn"))
    # a branch belongs to the innermost function around it
    own = inner.join(fn.select(key, "fn", "fn_depth"), [key, "fn"]).groupBy(key, "pre", "depth").agg(F.max_by(F.struct("fn", "fn_depth"), "fn_depth").alias("f"))
    branches = own.groupBy(key, F.col("f.fn").alias("fn")).agg(F.count(F.lit(1)).alias("branches"), F.sum(F.col("depth") - F.col("f.fn_depth")).alias("cognitive"), F.max(F.col("depth") - F.col("f.fn_depth")).alias("nesting"))
    # code lines up to each line, so that a range is a difference of two
    code = code_lines(lines, key)
    upto = F.sum((F.length(F.trim("code")) > 0).cast("long")).over(W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    sums = code.select(F.col(key).alias("__k"), F.col("line_no").alias("__l"), upto.alias("__s"), (F.length(F.trim("code")) > 0).cast("long").alias("__c"))
    out = fn.join(branches, [key, "fn"], "left")
    out = out.join(sums.select("__k", "__l", (F.col("__s") - F.col("__c")).alias("before")), (F.col(key) == F.col("__k")) & (F.col("start_line") == F.col("__l"))).drop("__k", "__l")
    out = out.join(sums.select("__k", "__l", F.col("__s").alias("after")), (F.col(key) == F.col("__k")) & (F.col("end_line") == F.col("__l"))).drop("__k", "__l")
    inside = F.regexp_extract("header", r"\(([^()]*(?:\([^()]*\)[^()]*)*)\)", 1)
    parameters = F.when(F.trim(inside) == "", 0).otherwise(F.size(F.split(inside, ",")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select(
        key, "name", "start_line", "end_line", (F.col("end_line") - F.col("start_line") + 1).cast("long").alias("lines"), (F.col("after") - F.col("before")).alias("sloc"),
        parameters.cast("long").alias("parameters"), (zero("branches") + 1).alias("cyclomatic"), zero("cognitive").alias("cognitive"), zero("nesting").alias("nesting"),
    )


def nesting(nodes: DataFrame, key: str = "file") -> DataFrame:
    """key, blocks, deepest, longest (lines) of every file with a block."""
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("blocks"), F.max("depth").alias("deepest"), F.max((F.col("end_line") - F.col("start_line") + 1).cast("long")).alias("longest"))
