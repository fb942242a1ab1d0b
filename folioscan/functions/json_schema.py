"""JSON Schema as a column: a schema is compiled once, on the driver, to one
expression that gives every broken rule of a JSON value with its path.

The value is a variant, so types are those of the JSON text, whatever columns it
is read into.  Draft 7 without remote references: $ref (into the schema itself or
a store of schemas, `other.json#/$defs/x`), type, enum, const, required,
properties, patternProperties, additionalProperties, minProperties,
maxProperties, propertyNames, items, additionalItems, contains, minItems,
maxItems, uniqueItems, minLength, maxLength, pattern, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, multipleOf, allOf, anyOf, oneOf, not, if,
then, else, and the format date-time.  Notes (title, description, examples,
default and so on) say nothing about values; an unknown word is an error of the
schema, so that no rule is left out in silence.

A schema that refers to itself without end has no expression and is an error.
Patterns are those of Java, which agree with others on what schemas commonly use.
A text that is no JSON breaks the rule `json`; null as a whole is a JSON null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

NOTES = frozenset("$schema $id $comment $defs definitions title description default examples readOnly writeOnly deprecated contentMediaType contentEncoding".split())
#: How deep references may nest.
DEPTH = 24
DATE_TIME = r"(?i)^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[t ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


class SchemaError(ValueError):
    pass


def _none() -> Column:
    return F.array().cast("array<string>")


def _told(ok: Column, path: Column, rule: str) -> Column:
    """One broken rule, unless it holds; what is not known counts as broken."""
    return F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(F.array(F.concat(path, F.lit(f": {rule}"))))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once a row: a column is computed again in each place
    where it stands, the variable of a lambda is not."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _kind_named(name: Column) -> Column:
    """object, array, string, boolean, null or number, by the schema of a variant."""
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def _kind(v: Column) -> Column:
    return _once(F.schema_of_variant(v), _kind_named)


def _text(v: Column, kind: Column) -> Column:
    """Equal values have equal texts: keys of a variant are in order."""
    return F.when(kind == "number", _as(v, "double").cast("string")).otherwise(F.to_json(v))


def _canonical(value) -> Column:
    """A value of the schema, as a text to compare with; without a lambda Spark
    computes it when it plans."""
    v = F.parse_json(F.lit(json.dumps(value)))
    return _text(v, _kind_named(F.schema_of_variant(v)))


@dataclass(frozen=True)
class _Value:
    """A value and what its rules ask of it; members and items are null of other kinds."""

    variant: Column
    kind: Column
    members: Column
    items: Column

    @staticmethod
    def held(x: Column, use: Callable[[_Value], Column]) -> Column:
        """use of the value of x, which is taken apart once for all its rules."""

        def parts(v: Column) -> Column:
            return F.struct(
                v.alias("variant"), _kind(v).alias("kind"),
                _as(v, "map<string,variant>").alias("members"), _as(v, "array<variant>").alias("items"),
            )

        return _once(x, lambda v: _once(parts(v), lambda p: use(_Value(p["variant"], p["kind"], p["members"], p["items"]))))

    @staticmethod
    def of_record(record: Column, fields: StructType, use: Callable[[_Value], Column]) -> Column:
        """use of the object that a record makes: fields that are null are not there.
        Texts become members as they are; other fields go by their JSON."""

        def member(f: StructField) -> Column:
            if isinstance(f.dataType, StringType):
                return record[f.name].cast("variant")
            return F.variant_get(F.parse_json(F.to_json(F.struct(record[f.name].alias("x")))), "$.x", "variant")

        # in the order of names, as an object of a variant has them
        named = sorted(fields.fields, key=lambda f: f.name)
        entries = F.array(*[F.struct(F.lit(f.name).alias("key"), member(f).alias("value")) for f in named])
        members = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
        whole = F.parse_json(F.coalesce(F.to_json(record), F.lit("null")))
        kind = F.when(record.isNull(), "null").otherwise("object")
        return _once(members, lambda m: use(_Value(whole, kind, m, F.lit(None).cast("array<variant>"))))

    def string(self) -> Column:
        return _as(self.variant, "string")

    def number(self) -> Column:
        return _as(self.variant, "double")

    def text(self) -> Column:
        return _text(self.variant, self.kind)


class _Compiler:
    def __init__(self, root: dict, store: dict[str, dict]):
        self.root, self.store = root, {self._name(k): v for k, v in store.items()}

    @staticmethod
    def _name(name: str) -> str:
        return name.removeprefix("./")

    def resolve(self, ref: str, base: dict) -> tuple[dict, dict]:
        name, _, pointer = ref.partition("#")
        if name and self._name(name) not in self.store:
            raise SchemaError(f"no schema {name} for the reference {ref}")
        base = self.store[self._name(name)] if name else base
        at = base
        for part in [p for p in pointer.split("/") if p]:
            part = part.replace("~1", "/").replace("~0", "~")
            if not isinstance(at, dict) or part not in at:
                raise SchemaError(f"nothing at the reference {ref}")
            at = at[part]
        return at, base

    def broken(self, schema, v: Column | _Value, path: Column, base: dict, depth: int = 0) -> Column:
        """Broken rules of a value that is there: a column, or one that is held already."""
        if depth > DEPTH:
            raise SchemaError("the schema refers to itself without end")
        if schema is True:
            return _none()
        if schema is False:
            return F.array(F.concat(path, F.lit(": false")))
        if not isinstance(schema, dict):
            raise SchemaError(f"not a schema: {schema!r}")
        if "$ref" in schema:  # in draft 7 it stands alone
            target, base = self.resolve(schema["$ref"], base)
            return self.broken(target, v, path, base, depth + 1)
        if isinstance(v, _Value):
            return self._words(schema, v, path, base, depth)
        return _Value.held(v, lambda held: self._words(schema, held, path, base, depth))

    def _words(self, schema: dict, v: _Value, path: Column, base: dict, depth: int) -> Column:
        parts = []
        for word in schema:
            if word in NOTES or word in ("then", "else", "additionalItems"):
                continue
            make = getattr(self, "_" + re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), word), None)
            if make is None:
                raise SchemaError(f"unknown word {word}")
            parts.append(make(schema, v, path, lambda s, x, p: self.broken(s, x, p, base, depth + 1)))
        return F.concat(*parts) if parts else _none()

    # --- any value

    def _type(self, schema, v, path, inner) -> Column:
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        whole = v.number() == F.floor(v.number())
        known = {
            "integer": (v.kind == "number") & whole, **{k: v.kind == k for k in ("object", "array", "string", "boolean", "null", "number")}
        }
        if bad := [n for n in names if n not in known]:
            raise SchemaError(f"unknown type {bad[0]}")
        ok = F.lit(False)
        for n in names:
            ok = ok | known[n]
        return _told(ok, path, "type")

    def _enum(self, schema, v, path, inner) -> Column:
        return _told(F.array_contains(F.array(*[_canonical(x) for x in schema["enum"]]), v.text()), path, "enum")

    def _const(self, schema, v, path, inner) -> Column:
        return _told(v.text() == _canonical(schema["const"]), path, "const")

    def _all_of(self, schema, v, path, inner) -> Column:
        return F.concat(_none(), *[inner(s, v, path) for s in schema["allOf"]])

    def _some(self, schemas, v, path, inner) -> Column:
        return sum((F.size(inner(s, v, path)) == 0).cast("int") for s in schemas)

    def _any_of(self, schema, v, path, inner) -> Column:
        return _told(self._some(schema["anyOf"], v, path, inner) > 0, path, "anyOf")

    def _one_of(self, schema, v, path, inner) -> Column:
        return _told(self._some(schema["oneOf"], v, path, inner) == 1, path, "oneOf")

    def _not(self, schema, v, path, inner) -> Column:
        return _told(F.size(inner(schema["not"], v, path)) > 0, path, "not")

    def _if(self, schema, v, path, inner) -> Column:
        holds = F.size(inner(schema["if"], v, path)) == 0
        return F.when(holds, inner(schema.get("then", True), v, path)).otherwise(inner(schema.get("else", True), v, path))

    # --- of one kind: other kinds keep the rule

    def _of(self, kind: str, v, path, rule: str, ok: Callable[[], Column]) -> Column:
        return F.when(v.kind == kind, _told(ok(), path, rule)).otherwise(_none())

    def _min_length(self, schema, v, path, inner) -> Column:
        return self._of("string", v, path, "minLength", lambda: F.length(v.string()) >= schema["minLength"])

    def _max_length(self, schema, v, path, inner) -> Column:
        return self._of("string", v, path, "maxLength", lambda: F.length(v.string()) <= schema["maxLength"])

    def _pattern(self, schema, v, path, inner) -> Column:
        return self._of("string", v, path, "pattern", lambda: v.string().rlike(schema["pattern"]))

    def _format(self, schema, v, path, inner) -> Column:
        if schema["format"] != "date-time":
            return _none()
        return self._of("string", v, path, "format", lambda: v.string().rlike(DATE_TIME))

    def _minimum(self, schema, v, path, inner) -> Column:
        return self._of("number", v, path, "minimum", lambda: v.number() >= schema["minimum"])

    def _maximum(self, schema, v, path, inner) -> Column:
        return self._of("number", v, path, "maximum", lambda: v.number() <= schema["maximum"])

    def _exclusive_minimum(self, schema, v, path, inner) -> Column:
        return self._of("number", v, path, "exclusiveMinimum", lambda: v.number() > schema["exclusiveMinimum"])

    def _exclusive_maximum(self, schema, v, path, inner) -> Column:
        return self._of("number", v, path, "exclusiveMaximum", lambda: v.number() < schema["exclusiveMaximum"])

    def _multiple_of(self, schema, v, path, inner) -> Column:
        parts = v.number() / F.lit(float(schema["multipleOf"]))
        return self._of("number", v, path, "multipleOf", lambda: parts == F.floor(parts))

    # --- objects

    def _required(self, schema, v, path, inner) -> Column:
        if not schema["required"]:
            return _none()
        have = F.map_keys(v.members)
        missing = F.array_except(F.array(*[F.lit(n) for n in schema["required"]]), have)
        told = F.transform(missing, lambda n: F.concat(path, F.lit("."), n, F.lit(": required")))
        return F.when(v.kind == "object", told).otherwise(_none())

    def _properties(self, schema, v, path, inner) -> Column:
        members, parts = v.members, []
        for name, s in schema["properties"].items():
            x = F.try_element_at(members, F.lit(name))
            parts.append(F.when(F.map_contains_key(members, name), inner(s, x, F.concat(path, F.lit("." + name)))).otherwise(_none()))
        return F.when(v.kind == "object", F.concat(_none(), *parts)).otherwise(_none())

    def _each_member(self, v, path, wanted: Callable[[Column], Column], inner, s) -> Column:
        entries = F.filter(F.map_entries(v.members), lambda e: wanted(e["key"]))
        told = F.flatten(F.transform(entries, lambda e: inner(s, e["value"], F.concat(path, F.lit("."), e["key"]))))
        return F.when(v.kind == "object", told).otherwise(_none())

    def _pattern_properties(self, schema, v, path, inner) -> Column:
        each = [self._each_member(v, path, lambda k, p=p: k.rlike(p), inner, s) for p, s in schema["patternProperties"].items()]
        return F.concat(_none(), *each)

    def _additional_properties(self, schema, v, path, inner) -> Column:
        known, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))

        def other(k: Column) -> Column:
            out = ~k.isin(*known) if known else F.lit(True)
            for p in patterns:
                out = out & ~k.rlike(p)
            return out

        if schema["additionalProperties"] is not False:
            return self._each_member(v, path, other, inner, schema["additionalProperties"])
        extra = F.filter(F.map_keys(v.members), other)
        told = F.transform(extra, lambda k: F.concat(path, F.lit("."), k, F.lit(": additionalProperties")))
        return F.when(v.kind == "object", told).otherwise(_none())

    def _property_names(self, schema, v, path, inner) -> Column:
        named = F.transform(F.map_keys(v.members), lambda k: F.size(inner(schema["propertyNames"], k.cast("variant"), path)) == 0)
        return self._of("object", v, path, "propertyNames", lambda: F.forall(named, lambda ok: ok))

    def _min_properties(self, schema, v, path, inner) -> Column:
        return self._of("object", v, path, "minProperties", lambda: F.size(F.map_keys(v.members)) >= schema["minProperties"])

    def _max_properties(self, schema, v, path, inner) -> Column:
        return self._of("object", v, path, "maxProperties", lambda: F.size(F.map_keys(v.members)) <= schema["maxProperties"])

    # --- arrays

    def _at(self, path, i: Column) -> Column:
        return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))

    def _items(self, schema, v, path, inner) -> Column:
        s = schema["items"]
        if isinstance(s, list):
            found, n = [], len(s)
            for i, one in enumerate(s):
                x = F.get(v.items, F.lit(i))
                found.append(F.when(F.size(v.items) > i, inner(one, x, self._at(path, F.lit(i)))).otherwise(_none()))
            rest = schema.get("additionalItems", True)
            more = F.transform(v.items, lambda x, i: F.when(i >= n, inner(rest, x, self._at(path, i))).otherwise(_none()))
            told = F.concat(_none(), *found, F.flatten(more))
        else:
            told = F.flatten(F.transform(v.items, lambda x, i: inner(s, x, self._at(path, i))))
        return F.when(v.kind == "array", told).otherwise(_none())

    def _contains(self, schema, v, path, inner) -> Column:
        ok = lambda: F.exists(v.items, lambda x: F.size(inner(schema["contains"], x, path)) == 0)
        return self._of("array", v, path, "contains", ok)

    def _min_items(self, schema, v, path, inner) -> Column:
        return self._of("array", v, path, "minItems", lambda: F.size(v.items) >= schema["minItems"])

    def _max_items(self, schema, v, path, inner) -> Column:
        return self._of("array", v, path, "maxItems", lambda: F.size(v.items) <= schema["maxItems"])

    def _unique_items(self, schema, v, path, inner) -> Column:
        if not schema["uniqueItems"]:
            return _none()
        texts = F.transform(v.items, lambda x: _text(x, _kind(x)))
        return self._of("array", v, path, "uniqueItems", lambda: F.size(F.array_distinct(texts)) == F.size(texts))


def broken_rules(schema: dict, json_text: Column, store: dict[str, dict] | None = None) -> Column:
    """array<string> of `path: word` for every rule that the JSON text breaks; the
    path of the whole is $."""
    compiler = _Compiler(schema, store or {})

    def of(v: Column) -> Column:
        return F.when(v.isNull(), F.array(F.lit("$: json"))).otherwise(compiler.broken(schema, v, F.lit("$"), schema))

    return _once(F.try_parse_json(F.coalesce(json_text, F.lit("null"))), of)


def broken_fields(schema: dict, record: Column, fields: StructType, store: dict[str, dict] | None = None) -> Column:
    """broken_rules of the JSON text that a record of these fields makes; the text is
    not made, so long contents are neither written as JSON nor parsed."""
    compiler = _Compiler(schema, store or {})
    return _Value.of_record(record, fields, lambda v: compiler.broken(schema, v, F.lit("$"), schema))
