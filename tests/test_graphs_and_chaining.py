"""Strongly connected components, shortest cycles and forward chaining against brute force."""

import collections
import random

import pytest

from cairnspark.operators import chaining, graphs
from cairnspark.operators.chaining import Condition, Rule


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def reach(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    closed = {}
    for a in list(out):
        seen, stack = set(), [a]
        while stack:
            for b in out.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        closed[a] = seen
    return closed


def components_by_hand(edges):
    r = reach(edges)
    return {a: min(b for b in seen if a in r.get(b, ())) for a, seen in r.items() if a in seen}


def cycle_by_hand(edges, root):
    """Length of a shortest cycle through root."""
    depth, at = 0, {root}
    while True:
        depth, at = depth + 1, {b for a, b in edges if a in at}
        if root in at:
            return depth


def check(spark, edges):
    df = frame(spark, edges)
    comps = graphs.components(df)
    want = components_by_hand(edges)
    assert {r.node: r.component for r in comps.collect()} == want
    got = graphs.shortest_cycles(df, comps).collect()
    assert {r.component: r.length for r in got} == {c: cycle_by_hand([e for e in edges if want.get(e[0]) == want.get(e[1]) == c], c) for c in set(want.values())}
    for r in got:
        assert r.path[0] == r.component and len(set(r.path)) == r.length
        assert all(e in set(edges) for e in zip(r.path, [*r.path[1:], r.path[0]], strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(rng.choice([30, 45, 60]))]
    check(spark, edges + edges[:3])


def test_a_dense_core_ends(spark):
    """50 nodes, each with an edge to each: far too many simple paths to list."""
    check(spark, [(a, b) for a in range(50) for b in range(50) if a != b] + [(60, 0), (0, 61)])


def test_loops_and_trees(spark):
    check(spark, [(1, 1), (2, 3), (3, 4), (5, 5), (5, 6), (7, 8), (8, 7)])
    none = graphs.components(frame(spark, [(1, 2), (2, 3)]))
    assert none.collect() == [] and graphs.shortest_cycles(frame(spark, [(1, 2)])).collect() == []
    assert graphs.components(frame(spark, [(1, 2)]).limit(0)).collect() == []


def test_dependents_are_rows(spark):
    out = graphs.dependents(frame(spark, [(1, 9), (2, 9), (2, 9), (3, 8)])).collect()
    assert sorted((r.dst, r.src, r.n) for r in out) == [(8, 3, 1), (9, 1, 2), (9, 2, 2)]


def facts(spark, rows):
    return spark.createDataFrame(rows, "subject string, attribute string, value string")


def chained(spark, rows, rules):
    return {(r.subject, r.attribute, r.value): (r.rule, r.round) for r in chaining.forward_chain(facts(spark, rows), rules).collect()}


def test_a_chain_of_three_rules(spark):
    rules = [
        Rule("c", (Condition("?m", "noisy", "true"), Condition("?m", "owner", "?p")), (("?p", "told", "?m"), ("?p", "busy", "true"))),
        Rule("a", (Condition("?m", "lines", "500", ">"),), (("?m", "large", "true"),)),
        Rule("b", (Condition("?m", "large", "true"), Condition("?m", "tests", "0", "<=")), (("?m", "noisy", "true"),)),
    ]
    rows = [("m1", "lines", "900"), ("m1", "tests", "0"), ("m1", "owner", "ann"), ("m2", "lines", "90"), ("m2", "tests", "0"), ("m3", "lines", "many"), (None, "lines", "900"), ("m1", "lines", "900")]
    got = chained(spark, rows, rules)
    assert {k: v for k, v in got.items() if v[0]} == {("m1", "large", "true"): ("a", 1), ("m1", "noisy", "true"): ("b", 2), ("ann", "told", "m1"): ("c", 3), ("ann", "busy", "true"): ("c", 3)}
    assert sum(v[0] is None for v in got.values()) == 6


def test_a_rule_that_feeds_itself(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)]
    rules = [Rule("far", (Condition("?a", "to", "?b"), Condition("?b", "to", "?c")), (("?a", "to", "?c"),)), Rule("loop", (Condition("?a", "to", "?a"),), (("?a", "kind", "cyclic"),))]
    got = chained(spark, [(a, "to", b) for a, b in edges], rules)
    r = reach(edges)
    assert {(a, b) for a, k, b in got if k == "to"} == {(a, b) for a, s in r.items() for b in s}
    assert {a for a, k, _ in got if k == "kind"} == {a for a, s in r.items() if a in s}


def test_rules_as_text(spark):
    text = '''
    rule "Independence" salience 10 {
        when Facts.layer == "domain" && Facts.internal_deps > 0
        then Facts.violation = true; Facts.message = "domain depends on others";
    }
    rule "Report" { when Facts.violation == true then Facts.reported = "yes"; }
    '''
    rows = [("crate-a", "layer", "domain"), ("crate-a", "internal_deps", "2"), ("crate-b", "layer", "domain"), ("crate-b", "internal_deps", "0"), ("crate-c", "internal_deps", "9")]
    got = chained(spark, rows, chaining.rules_of(text))
    assert {k: v for k, v in got.items() if v[0]} == {
        ("crate-a", "violation", "true"): ("Independence", 1), ("crate-a", "message", "domain depends on others"): ("Independence", 1), ("crate-a", "reported", "yes"): ("Report", 2),
    }
    for bad in ('rule "x" { when Facts.a ~ 1 then Facts.b = 2; }', "nothing", 'rule "x" { when Facts.a == 1 then print; }'):
        with pytest.raises(ValueError):
            chaining.rules_of(bad)


def test_rules_that_cannot_be_joined():
    for when, then in (
        ((Condition("?a", "x", "1"), Condition("?b", "y", "2")), (("?a", "z", "1"),)), ((Condition("?a", "x", "1"),), (("?q", "z", "1"),)),
        ((Condition("?a", "x", "?b", ">"),), ()), ((Condition("?a", "x", "1", "~"),), ()),
    ):
        with pytest.raises(ValueError):
            Rule("r", when, then)


def test_no_rules_and_no_facts(spark):
    assert chained(spark, [("a", "b", "c")], []) == {("a", "b", "c"): (None, 0)}
    assert chained(spark, [], [Rule("r", (Condition("?a", "x", "?b"),), (("?b", "x", "?a"),))]) == {}
