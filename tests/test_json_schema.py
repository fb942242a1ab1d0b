"""Compiled JSON schemas on planted faults of every word."""

import json

import pytest
from pyspark.sql import functions as F

from folioscan import schemas
from folioscan.functions import json_schema as J

CASES = [
    ({"type": "string"}, ["a", 1, None, True], [[], ["$: type"], ["$: type"], ["$: type"]]),
    ({"type": "integer"}, [1, 1.0, 1.5, "1", 2**40, -3], [[], [], ["$: type"], ["$: type"], [], []]),
    ({"type": ["null", "number"]}, [None, 1.5, {}, []], [[], [], ["$: type"], ["$: type"]]),
    ({"type": "object"}, [{}, [], {"a": 1}], [[], ["$: type"], []]),
    ({"type": "boolean"}, [True, 0], [[], ["$: type"]]),
    ({"enum": ["a", 1, None, [1, 2], {"x": 1, "y": 2}]}, ["a", 1.0, None, [1, 2], {"y": 2, "x": 1}, "b", True, [2, 1]], [[], [], [], [], [], ["$: enum"], ["$: enum"], ["$: enum"]]),
    ({"const": "x"}, ["x", "y"], [[], ["$: const"]]),
    ({"minLength": 2, "maxLength": 3}, ["é", "éé", "éééé", 5], [["$: minLength"], [], ["$: maxLength"], []]),
    ({"pattern": "^a.c$"}, ["abc", "abd", 7], [[], ["$: pattern"], []]),
    ({"format": "date-time"}, ["2024-02-03T04:05:06Z", "2024-02-03 4:05", "2024-13-03T04:05:06+01:00"], [[], ["$: format"], ["$: format"]]),
    ({"minimum": 0, "exclusiveMaximum": 10}, [0, 9.9, 10, -1, "x"], [[], [], ["$: exclusiveMaximum"], ["$: minimum"], []]),
    ({"maximum": 3, "exclusiveMinimum": 1, "multipleOf": 0.5}, [1, 1.5, 3.2], [["$: exclusiveMinimum"], [], ["$: maximum", "$: multipleOf"]]),
    ({"required": ["a", "b"]}, [{"a": 1, "b": None}, {"b": 1}, {}, []], [[], ["$.a: required"], ["$.a: required", "$.b: required"], []]),
    ({"properties": {"a": {"type": "string"}, "b c": {"minimum": 1}}}, [{"a": 1, "b c": 0}, {"a": None}, {}], [["$.a: type", "$.b c: minimum"], ["$.a: type"], []]),
    ({"properties": {"a": True}, "additionalProperties": False}, [{"a": 1}, {"a": 1, "z": 1, "y": 2}], [[], ["$.y: additionalProperties", "$.z: additionalProperties"]]),
    ({"properties": {"a": True}, "patternProperties": {"^x": {"type": "string"}}, "additionalProperties": {"type": "integer"}}, [{"a": "s", "x1": "s", "n": 1}, {"x1": 1, "n": "s"}], [[], ["$.n: type", "$.x1: type"]]),
    ({"minProperties": 1, "maxProperties": 2}, [{}, {"a": 1}, {"a": 1, "b": 1, "c": 1}], [["$: minProperties"], [], ["$: maxProperties"]]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, [{"ab": 1}, {"A": 1}], [[], ["$: propertyNames"]]),
    ({"items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer"}}}}, [[{"k": 1}, {}, {"k": "s"}], []], [["$[1].k: required", "$[2].k: type"], []]),
    ({"items": [{"type": "string"}, {"type": "integer"}], "additionalItems": False}, [["a", 1], ["a"], [1, "a", 2]], [[], [], ["$[0]: type", "$[1]: type", "$[2]: false"]]),
    ({"minItems": 1, "maxItems": 2, "uniqueItems": True}, [[], [1, 2], [1, 1.0], [1, 2, 3]], [["$: minItems"], [], ["$: uniqueItems"], ["$: maxItems"]]),
    ({"contains": {"const": 2}}, [[1, 2], [1]], [[], ["$: contains"]]),
    ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, [1, 3], [[], ["$: maximum"]]),
    ({"anyOf": [{"required": ["a"]}, {"required": ["b"]}]}, [{"b": 1}, {"c": 1}], [[], ["$: anyOf"]]),
    ({"oneOf": [{"minimum": 1}, {"maximum": 5}]}, [0, 3, 9], [[], ["$: oneOf"], []]),
    ({"not": {"type": "string"}}, ["a", 1], [["$: not"], []]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"minimum": 5}}, ["a", "ab", 4, 5], [["$: minLength"], [], ["$: minimum"], []]),
    ({"properties": {"a": {"properties": {"b": {"items": {"enum": ["x"]}}}}}}, [{"a": {"b": ["x", "y"]}}], [["$.a.b[1]: enum"]]),
    ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "integer"}}}, [1, "a"], [[], ["$: type"]]),
    ({"properties": {"a": {"$ref": "./common.json#/$defs/t"}}}, [{"a": "x"}, {"a": "z"}], [[], ["$.a: enum"]]),
]
STORE = {"common.json": {"$defs": {"t": {"$ref": "#/$defs/u"}, "u": {"enum": ["x", "y"]}}}}


@pytest.mark.parametrize(("schema", "values", "want"), CASES, ids=lambda x: next(iter(x)) if isinstance(x, dict) else "")
def test_words(spark, schema, values, want):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, j string")
    got = {r.i: sorted(r.b) for r in df.select("i", J.broken_rules(schema, F.col("j"), STORE).alias("b")).collect()}
    assert [got[i] for i in range(len(values))] == want


def test_no_json_and_null(spark):
    df = spark.createDataFrame([(1, "{"), (2, None), (3, "")], "i int, j string")
    got = {r.i: r.b for r in df.select("i", J.broken_rules({"type": "object"}, F.col("j")).alias("b")).collect()}
    assert got == {1: ["$: json"], 2: ["$: type"], 3: ["$: json"]}


def test_bad_schemas(spark):
    for schema in ({"typo": 1}, {"type": "text"}, {"$ref": "#/nowhere"}, {"$ref": "other.json#"}, {"$ref": "#"}, {"items": 3}):
        with pytest.raises(J.SchemaError):
            J.broken_rules(schema, F.lit("1"))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_taken_apart_once(spark):
    """Each rule parsed the text anew: 226 parses stood in this plan."""
    names = {n: {"type": "string", "minLength": 1} for n in "abcdefgh"}
    schema = {"type": "object", "required": ["a"], "properties": {**names, "in": {"type": "object", "properties": names}}, "additionalProperties": False}
    made = plan(spark.createDataFrame([("{}",)], "j string").select(J.broken_rules(schema, F.col("j")).alias("b")))
    assert made.count("parseJson(") == 1
    # of the whole, and of each of its 9 and of the 8 members within
    assert made.count("schemaOfVariant(") == 18


FIELDS = "a: string, n: int, x: double, s: array<string>, r: struct<p: string, q: int>, t: timestamp, `b c`: boolean"
RECORDS = [
    ("é\"\n", 1, 1.5, ["u", None], ("p", None), None, True),
    ("", None, float("nan"), [], (None, 7), None, None),
    (None, 0, None, None, None, None, False),
    (None, None, None, None, (None, None), None, None),
]


@pytest.mark.parametrize(
    "schema",
    [
        {"type": "object", "required": ["a", "n", "r"], "minProperties": 3, "additionalProperties": {"type": "string"}},
        {"properties": {"a": {"minLength": 1, "pattern": "^.\"\\n$"}, "n": {"enum": [1]}, "x": {"type": "number"}, "b c": {"const": True}}},
        {"properties": {"s": {"minItems": 1, "items": {"type": "string"}}, "r": {"required": ["p"], "properties": {"q": {"maximum": 5}}}}, "additionalProperties": False},
        {"if": {"required": ["a"]}, "then": {"required": ["n"]}, "else": {"maxProperties": 2}, "patternProperties": {"^r": {"minProperties": 2}}},
        {"anyOf": [{"const": {"n": 0, "b c": False}}, {"enum": [{"r": {}}]}], "propertyNames": {"pattern": "^.$"}},
        {"type": "string"},
        {"$ref": "#/$defs/o", "$defs": {"o": {"not": {"required": ["x"]}}}},
    ],
)
def test_records_are_judged_as_their_json(spark, schema):
    df = spark.createDataFrame([(r,) for r in RECORDS] + [(None,)], f"r struct<{FIELDS}>")
    kind = df.schema["r"].dataType
    both = df.select(J.broken_fields(schema, F.col("r"), kind).alias("a"), J.broken_rules(schema, F.to_json("r")).alias("b")).collect()
    assert [r.a for r in both] == [r.b for r in both]


def test_rules_of_chunks_stand_once_and_make_no_json(spark):
    """A filter behind the rules computed them once more, and contents were parsed."""
    rows = [(f"c{i}", "d", "generic", "t" * 70, ["p"], "s", "e", "core", "primary", "T") for i in range(3)] + [("c9", "d", "no", None, ["p"], "s", "e", "core", "primary", "T")]
    names = "chunk_id string, document_id string, chunk_type string, content string, section_path array<string>, source_id string, edition string, source_type string, authority_level string, source_title string"
    found = schemas.broken_chunks(spark.createDataFrame(rows, names), None, {schemas.COMMON: schemas.common(("core",), ("primary",))})
    assert [(r.chunk_id, r.broken) for r in found.collect()] == [("c9", ["$.chunk_type: enum", "$.content: required"])]
    assert plan(found).count("$.chunk_type: enum") == 1


def test_long_contents(spark):
    """The parser takes no text of over 20 million characters."""
    df = spark.range(1).select(F.struct(F.repeat(F.lit("é"), 21_000_000).alias("content")).alias("record"), F.lit("c").alias("k"))
    assert schemas.broken(df, "k", "record", {"properties": {"content": {"type": "string"}}}).collect() == []
