"""The block tree against a stack, line by line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cairnspark.functions.text import line_table
from cairnspark.operators import block_tree as bt


def lines_of(spark, files):
    return line_table(spark.createDataFrame(list(files.items()), "file string, content string"))


def braces_by_hand(text):
    """(pre, depth, parent, start_line, end_line) with a stack."""
    lines = text.split("\n")
    out, stack, seq = {}, [], 0
    for n, line in enumerate(lines):
        for c in line:
            if c == "{":
                seq += 1
                out[seq] = [seq, len(stack) + 1, stack[-1] if stack else None, n, len(lines) - 1]
                stack.append(seq)
            elif c == "}":
                seq += 1
                if stack:
                    out[stack.pop()][4] = n
    return sorted(map(tuple, out.values()))


def rows(nodes):
    return sorted((r.pre, r.depth, r.parent, r.start_line, r.end_line) for r in nodes.collect())


@pytest.mark.parametrize("seed", range(4))
def test_braces_match_as_with_a_stack(spark, seed):
    rng = random.Random(seed)
    files = {f"{i}.rs": "\n".join("".join(rng.choices("{}x ", [3, 3, 2, 1], k=rng.randrange(6))) for _ in range(rng.randrange(1, 25))) + "\nend" for i in range(15)}
    nodes = bt.block_nodes(lines_of(spark, files))
    for name, text in files.items():
        assert rows(nodes.where(F.col("file") == name)) == braces_by_hand(text), text


RUST = '''
pub mod shapes {
    // a { brace in a comment
    pub struct Circle { r: f64 }
    /* and { several
       lines { of one */
    impl Area for Circle {
        fn area(&self, scale: f64) -> f64 {
            let s = "text with } and {";
            if self.r > 0.0 {
                for i in 0..3 {
                    if i > 1 { total += 1.0; }
                }
            } else {
                return 0.0;
            }
            match self.r { _ => 3.14 }
        }
    }
}
'''
PYTHON = '''import os

class Circle:
    """Doc: not a block"""

    def area(self, scale, power=2):
        if scale:  # a comment
            for i in range(3):
                print(i)

            return 1
        else:
            return 2

    def name(self):
        return "x:"

def last(a): return a
while True:
    pass
'''


def test_kinds_names_and_parents(spark):
    nodes = bt.block_nodes(lines_of(spark, {"a.rs": RUST}))
    got = {(r.kind, r.name, r.start_line, r.end_line) for r in nodes.collect()}
    assert got == {
        ("module", "shapes", 1, 19), ("type", "Circle", 3, 3), ("implementation", "Circle", 6, 18), ("function", "area", 7, 17), ("condition", None, 9, 13),
        ("loop", None, 10, 12), ("condition", None, 11, 11), ("condition", None, 13, 15), ("match", None, 16, 16),
    }
    up = nodes.alias("n").join(nodes.alias("p"), F.col("n.parent") == F.col("p.pre")).select("n.start_line", F.col("p.kind").alias("over")).collect()
    assert {(r.start_line, r.over) for r in up} >= {(7, "implementation"), (10, "condition"), (16, "function"), (3, "module")}


def test_blocks_by_indentation(spark):
    nodes = bt.block_nodes(lines_of(spark, {"a.py": PYTHON}))
    got = {(r.kind, r.name, r.start_line, r.end_line, r.depth) for r in nodes.collect()}
    assert got == {
        ("type", "Circle", 2, 15, 1), ("function", "area", 5, 12, 2), ("condition", None, 6, 10, 3), ("loop", None, 7, 8, 4), ("condition", None, 11, 12, 3),
        ("function", "name", 14, 15, 2), ("loop", None, 18, 19, 1),
    }
    parent = {r.start_line: r.parent for r in nodes.collect()}
    assert parent[2] is None and parent[5] == 4 and parent[6] == 10 and parent[7] == 12 and parent[11] == 10 and parent[18] is None


def test_ancestors_and_conditions(spark):
    nodes = bt.block_nodes(lines_of(spark, {"a.rs": RUST, "b.py": PYTHON})).cache()
    anc = bt.ancestors(nodes).where("file = 'a.rs'").collect()
    by_hand = {(a.pre, b.pre) for a in nodes.where("file = 'a.rs'").collect() for b in nodes.where("file = 'a.rs'").collect() if b.pre < a.pre and b.post > a.post}
    assert {(r.pre, r.ancestor) for r in anc} == by_hand and max(r.distance for r in anc) == 5
    pick = lambda **kw: sorted((r.file, r.start_line) for r in bt.select_nodes(nodes, **kw).collect())
    assert pick(kind="function", has_child="condition") == [("a.rs", 7), ("b.py", 5)]
    assert pick(kind="function", no_child="condition") == [("b.py", 14)]
    assert pick(kind="function", name_like="^n") == [("b.py", 14)]
    assert pick(kind="loop", inside="function") == [("a.rs", 10), ("b.py", 7)]
    assert pick(where=F.col("depth") >= 5) == [("a.rs", 10), ("a.rs", 11)]


def test_metrics_of_functions(spark):
    files = lines_of(spark, {"a.rs": RUST, "b.py": PYTHON})
    got = {(r.file, r.name): r for r in bt.function_metrics(bt.block_nodes(files), files).collect()}
    a = got["a.rs", "area"]
    # if, for, if, else, match at depths 1, 2, 3, 1, 1 below the function
    assert (a.lines, a.sloc, a.parameters, a.cyclomatic, a.cognitive, a.nesting) == (11, 11, 2, 6, 8, 3)
    b = got["b.py", "area"]
    assert (b.lines, b.sloc, b.parameters, b.cyclomatic, b.cognitive) == (8, 7, 3, 4, 4)
    n = bt.nesting(bt.block_nodes(files)).where("file = 'a.rs'").first()
    assert (n.blocks, n.deepest, n.longest) == (9, 6, 19)


def test_files_without_blocks(spark):
    files = lines_of(spark, {"a.rs": "", "b.py": "x = 1\n", "c.rs": "}}}\n"})
    nodes = bt.block_nodes(files)
    assert nodes.collect() == [] and bt.function_metrics(nodes, files).collect() == [] and not re.search("Python|Arrow", nodes._jdf.queryExecution().executedPlan().toString())
