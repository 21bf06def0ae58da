"""Forward chaining of rules over a table of facts.

A fact is (subject, attribute, value).  A rule has conditions on facts, in which
``?x`` stands for whatever is equal in all its places, and conclusions.  Rules
are joins: a round joins only the last round's new facts with all facts, once
for each condition that a new fact can meet (semi-naive evaluation), and the
rounds end when nothing new follows.  Rules only add facts, so the order of
rules does not matter; a chain of rules and a rule that feeds itself both end
with the same table, each fact with the rule and the round that first gave it.

Each round's facts are a table of their own; no fact reaches the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize

FACT = ("subject", "attribute", "value")
#: How a value is compared with a constant; numbers if both sides are.
COMPARE = {"==": "=", "!=": "!=", ">": ">", ">=": ">=", "<": "<", "<=": "<="}


@dataclass(frozen=True)
class Condition:
    """A fact's subject and value may be ``?variables``; with another operator than ``==`` the value is a constant."""

    subject: str
    attribute: str
    value: str
    operator: str = "=="

    @property
    def variables(self) -> set[str]:
        return {x for x in (self.subject, self.value) if x.startswith("?")}


@dataclass(frozen=True)
class Rule:
    name: str
    when: tuple[Condition, ...]
    then: tuple[tuple[str, str, str], ...]

    def __post_init__(self):
        if any(c.operator not in COMPARE or (c.operator != "==" and c.value.startswith("?")) for c in self.when):
            raise ValueError(f"{self.name}: a condition's operator is one of {list(COMPARE)}, and not == only with a constant")
        bound = set().union(*[c.variables for c in self.when])
        if any(x.startswith("?") and x not in bound for t in self.then for x in t):
            raise ValueError(f"{self.name}: a conclusion has a variable that no condition has")
        for i in range(len(self.when)):
            self.order(i)

    def order(self, first: int) -> list[int]:
        """Conditions from ``first`` on, each sharing a variable with those before it: no cross join."""
        out, left, bound = [first], set(range(len(self.when))) - {first}, set(self.when[first].variables)
        while left:
            following = [i for i in sorted(left) if self.when[i].variables & bound]
            if not following:
                raise ValueError(f"{self.name}: condition {min(left)} shares no variable with the others")
            out.append(following[0])
            left.remove(following[0])
            bound |= self.when[following[0]].variables
        return out


def matches(facts: DataFrame, c: Condition) -> DataFrame:
    """One column for each variable of the condition, a row a matching fact."""
    rows = facts.where(F.col("attribute") == c.attribute)
    if not c.subject.startswith("?"):
        rows = rows.where(F.col("subject") == c.subject)
    if not c.value.startswith("?"):
        v, op = F.col("value"), COMPARE[c.operator]
        if op in ("=", "!="):
            rows = rows.where(v == c.value if op == "=" else v != c.value)
        else:
            number = v.try_cast("double")
            rows = rows.where({">": number > float(c.value), ">=": number >= float(c.value), "<": number < float(c.value), "<=": number <= float(c.value)}[op])
    if c.subject == c.value:
        rows = rows.where("subject = value")
    return rows.select(*{n: F.col(p).alias(n) for p, n in (("subject", c.subject), ("value", c.value)) if n.startswith("?")}.values()).distinct()


def conclusions(rule: Rule, new: DataFrame, known: DataFrame) -> DataFrame:
    """What the rule gives for bindings that use a new fact."""
    found = []
    for i in range(len(rule.when)):
        first, *others = rule.order(i)
        rows = matches(new, rule.when[first])
        for j in others:
            side = matches(known, rule.when[j])
            rows = rows.join(side, sorted(set(rows.columns) & set(side.columns)))
        for t in rule.then:
            found.append(rows.select(*[(F.col(x) if x.startswith("?") else F.lit(x)).cast("string").alias(n) for n, x in zip(FACT, t, strict=True)]))
    return reduce(DataFrame.unionByName, found).select(*FACT, F.lit(rule.name).alias("rule"))


def forward_chain(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """subject, attribute, value, rule (null for a given fact), round: all facts that follow.

    A fact that several rules give in one round has the rule that comes first by name.
    """
    given = facts.select(*[F.col(c).cast("string").alias(c) for c in FACT]).where(" and ".join(f"{c} is not null" for c in FACT)).distinct()
    new = known = materialize(given.select("*", F.lit(None).cast("string").alias("rule"), F.lit(0).alias("round")))
    n = 0
    while rules:
        n += 1
        # old and new facts as one relation, so that a join of a relation with itself keeps its columns apart
        derived = reduce(DataFrame.unionByName, [conclusions(r, new, known) for r in rules])
        fresh = derived.groupBy(*FACT).agg(F.min("rule").alias("rule")).join(known.select(*FACT), list(FACT), "left_anti")
        new = materialize(fresh.withColumn("round", F.lit(n)))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


_RULE = re.compile(r'rule\s+"([^"]+)"[^{]*\{\s*when\s+(.*?)\s+then\s+(.*?)\}', re.DOTALL)
_TERM = re.compile(r'Facts\.(\w+)\s*(==|!=|>=|<=|>|<)\s*("[^"]*"|[\w.]+)')
_SET = re.compile(r'Facts\.(\w+)\s*=\s*("[^"]*"|[\w.]+)')


def rules_of(text: str) -> list[Rule]:
    """Rules as ``rule "name" { when Facts.a == true && ... then Facts.b = "x"; }``: conditions on, and facts of, one subject."""
    out = []
    for name, when, then in _RULE.findall(text):
        terms = [_TERM.fullmatch(t.strip()) for t in when.split("&&")]
        sets = [_SET.fullmatch(t.strip()) for t in then.split(";") if t.strip()]
        if not all(terms) or not all(sets):
            raise ValueError(f"cannot read rule {name!r}")
        out.append(Rule(name, tuple(Condition("?s", a, v.strip('"'), op) for a, op, v in (t.groups() for t in terms)), tuple(("?s", a, v.strip('"')) for a, v in (s.groups() for s in sets))))
    if not out or len(out) != len(re.findall(r"\brule\s+\"", text)):
        raise ValueError("cannot read the rules")
    return out
