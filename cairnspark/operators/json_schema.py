"""JSON documents checked against a JSON Schema, as Columns over Variant.

A schema is compiled once, on the driver, to one expression: an array of
(path, keyword, message) for what a document breaks.  Nothing is parsed twice and
no row leaves the JVM.  Understood: type, enum, const, required, properties,
additionalProperties (false or a schema), items, prefixItems, pattern,
minLength, maxLength, minimum, maximum, exclusiveMinimum, exclusiveMaximum,
minItems, maxItems, uniqueItems, anyOf, oneOf, allOf, not and references to
``#/$defs`` or ``#/definitions``; other keywords say nothing about validity here.

As in the standard a keyword holds for values of its own type only, ``integer``
is a number without a fraction, and lengths are code points.  A text that is no
JSON breaks ``json`` at the root; a null text is the JSON null.  References may
nest but not recur; a schema that does raises.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERROR = "array<struct<path:string,keyword:string,message:string>>"


def _none() -> Column:
    return F.array().cast(ERROR)


def _error(broken: Column, path: Column, keyword: str, message: str) -> Column:
    one = F.array(F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), F.lit(message).alias("message"))).cast(ERROR)
    return F.when(broken, one).otherwise(_none())


def type_of(v: Column) -> Column:
    """JSON type of a variant: object, array, string, boolean, null, integer or number."""
    s = F.lower(F.schema_of_variant(v))
    number = F.try_variant_get(v, "$", "double")
    whole = number == F.floor(number)
    return (
        F.when(v.isNull() | F.is_variant_null(v) | (s == "void"), "null").when(s.startswith("object"), "object").when(s.startswith("array"), "array").when(s == "string", "string").when(s == "boolean", "boolean")
        .when(number.isNotNull(), F.when(whole, "integer").otherwise("number")).otherwise(s)
    )


class Compiler:
    def __init__(self, schema: dict):
        self.root = schema

    def resolve(self, schema: dict, seen: tuple[str, ...]) -> tuple[dict, tuple[str, ...]]:
        while "$ref" in schema:
            ref = schema["$ref"]
            if ref in seen or not ref.startswith("#/"):
                raise ValueError(f"a reference that recurs, or leads elsewhere: {ref}")
            seen, node = (*seen, ref), self.root
            for part in ref[2:].split("/"):
                node = node[part]
            schema = {**node, **{k: v for k, v in schema.items() if k != "$ref"}}
        return schema, seen

    def errors(self, schema: dict | bool, v: Column, path: Column, seen: tuple[str, ...] = ()) -> Column:
        """What the value breaks; ``path`` is where it stands."""
        if schema is True or schema is False:
            return _none() if schema else _error(F.lit(True), path, "false", "no value is allowed here")
        schema, seen = self.resolve(schema, seen)
        # bound as variables, the value and what is known of it once, so that expressions grow with the schema and not with its depth

        def known(x: Column) -> Column:
            t = type_of(x)
            members = F.when(t == "object", x.try_cast("map<string,variant>")).alias("members")
            return F.transform(F.array(F.struct(x.alias("v"), t.alias("type"), members)), lambda b: self._errors(schema, b["v"], b["type"], b["members"], path, seen))

        return F.flatten(F.flatten(F.transform(F.array(v), known)))

    def _errors(self, schema: dict, v: Column, kind: Column, members: Column, path: Column, seen: tuple[str, ...]) -> Column:
        out: list[Column] = []
        text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        is_text, is_number, is_object, is_array = kind == "string", kind.isin("integer", "number"), kind == "object", kind == "array"
        add = lambda broken, keyword, message: out.append(_error(broken, path, keyword, message))
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            add(~reduce(Column.__or__, [is_number if t == "number" else kind == t for t in names]), "type", f"is not of type {' or '.join(names)}")
        for keyword, allowed in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if allowed is not None:
                same = [F.to_json(v) == F.lit(json.dumps(x, separators=(",", ":"), ensure_ascii=False)) for x in allowed]
                add(~F.coalesce(reduce(Column.__or__, same, F.lit(False)), F.lit(None in allowed)), keyword, f"is not one of {json.dumps(allowed, ensure_ascii=False)}")
        if "pattern" in schema:
            add(is_text & ~text.rlike(schema["pattern"]), "pattern", f"does not match {schema['pattern']}")
        for keyword, broken, message in (
            ("minLength", lambda n: is_text & (F.char_length(text) < n), "is shorter than"), ("maxLength", lambda n: is_text & (F.char_length(text) > n), "is longer than"),
            ("minimum", lambda n: is_number & (number < n), "is less than"), ("maximum", lambda n: is_number & (number > n), "is more than"),
            ("exclusiveMinimum", lambda n: is_number & (number <= n), "is not more than"), ("exclusiveMaximum", lambda n: is_number & (number >= n), "is not less than"),
        ):
            if keyword in schema:
                add(broken(schema[keyword]), keyword, f"{message} {schema[keyword]}")
        keys = F.coalesce(F.map_keys(members), F.array().cast("array<string>"))
        for name in schema.get("required", []):
            add(is_object & ~F.array_contains(keys, name), "required", f"lacks {name}")
        below = lambda name: F.concat(path, F.lit("." + name))
        for name, sub in schema.get("properties", {}).items():
            inner = self.errors(sub, members[name], below(name), seen)
            out.append(F.when(is_object & F.array_contains(keys, name), inner).otherwise(_none()))
        if "additionalProperties" in schema and schema["additionalProperties"] is not True:
            known = F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>")
            others = F.array_except(keys, known)
            each = F.transform(others, lambda k: self.errors(schema["additionalProperties"], members[k], F.concat(path, F.lit("."), k), seen))
            if schema["additionalProperties"] is False:
                each = F.transform(others, lambda k: _error(F.lit(True), F.concat(path, F.lit("."), k), "additionalProperties", "is not known here"))
            out.append(F.flatten(each))
        items = F.coalesce(F.when(is_array, v.try_cast("array<variant>")), F.array().cast("array<variant>"))
        at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        first = schema.get("prefixItems", [])
        for i, sub in enumerate(first):
            out.append(F.when(F.size(items) > i, self.errors(sub, F.get(items, F.lit(i)), at(F.lit(i)), seen)).otherwise(_none()))
        if "items" in schema:
            each = F.transform(items, lambda x, i: F.when(i >= len(first), self.errors(schema["items"], x, at(i), seen)).otherwise(_none()))
            out.append(F.flatten(each))
        for keyword, broken, message in (("minItems", lambda n: F.size(items) < n, "has fewer items than"), ("maxItems", lambda n: F.size(items) > n, "has more items than")):
            if keyword in schema:
                add(is_array & broken(schema[keyword]), keyword, f"{message} {schema[keyword]}")
        if schema.get("uniqueItems"):
            add(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items), "uniqueItems", "has an item twice")
        for sub in schema.get("allOf", []):
            out.append(self.errors(sub, v, path, seen))
        fits = lambda keyword: reduce(Column.__add__, [(F.size(self.errors(s, v, path, seen)) == 0).cast("int") for s in schema[keyword]])
        if "anyOf" in schema:
            add(fits("anyOf") == 0, "anyOf", "fits none of the alternatives")
        if "oneOf" in schema:
            add(fits("oneOf") != 1, "oneOf", "does not fit exactly one of the alternatives")
        if "not" in schema:
            add(F.size(self.errors(schema["not"], v, path, seen)) == 0, "not", "fits what it must not")
        return F.concat(*out) if out else _none()


def schema_errors(schema: dict, document: Column) -> Column:
    """Array of (path, keyword, message) of a JSON text; empty if it is valid."""
    v = F.try_parse_json(F.coalesce(document, F.lit("null")))
    found = Compiler(schema).errors(schema, v, F.lit("$"))
    return F.when(v.isNull(), _error(F.lit(True), F.lit("$"), "json", "is no JSON")).otherwise(found)


def violations(docs: DataFrame, schema: dict, key: str = "id", column: str = "value") -> DataFrame:
    """key, path, keyword, message: one row for each thing a document breaks."""
    return docs.select(key, F.explode(schema_errors(schema, F.col(column))).alias("e")).select(key, "e.*")


#: What a rule file has to look like: the keys that every rule needs, and those of each kind of rule.
RULE_SCHEMA = {
    "type": "object",
    "required": ["id", "name", "category", "severity", "description"],
    "properties": {
        "id": {"type": "string", "pattern": "^[A-Z]{2,}[0-9]{3,}$"},
        "name": {"type": "string", "minLength": 3, "maxLength": 100},
        "category": {"enum": ["architecture", "quality", "organization", "solid", "testing", "documentation", "performance", "duplication", "metrics", "migration"]},
        "severity": {"enum": ["error", "warning", "info"]},
        "description": {"type": "string", "minLength": 10},
        "enabled": {"type": "boolean"},
        "lint_select": {"type": "array", "items": {"type": "string"}, "uniqueItems": True},
        "metrics": {"type": "object", "additionalProperties": {"$ref": "#/$defs/limit"}},
        "fixes": {"type": "array", "items": {"type": "object", "required": ["message"], "properties": {"message": {"type": "string"}, "pattern": {"type": "string"}}, "additionalProperties": False}},
    },
    "anyOf": [{"required": ["rule"]}, {"required": ["lint_select"]}, {"required": ["metrics"]}, {"required": ["selectors"]}],
    "$defs": {"limit": {"type": "object", "required": ["threshold"], "properties": {"threshold": {"type": "integer", "minimum": 1}, "severity": {"enum": ["error", "warning", "info"]}}}},
}
