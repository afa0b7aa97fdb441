"""Values of JSON at any depth against a walk in Python."""

from __future__ import annotations

import json
import random

from claimloom.operators import nested


def walk(value, path="$", depth=0):
    kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
    yield path, depth, kind
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        step = f"[{k}]" if isinstance(value, list) else "['" + k.replace("'", "\\'") + "']"
        yield from walk(v, path + step, depth + 1)


def made(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, 1, -2.5, "", "é" * 50, "short", {}, []])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice("abc d'."): made(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_values_at_any_depth(spark):
    rng = random.Random(4)
    values = [made(rng, rng.randint(0, 7)) for _ in range(60)]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{bad"), (901, None), (902, "")]
    df = spark.createDataFrame(rows, "id long, body string")
    got = sorted((r.id, r.path, r.depth, r.kind) for r in nested.json_values(df, "id", "body").collect())
    assert got == sorted((i, *x) for i, v in enumerate(values) for x in walk(v))
    assert {r.id for r in nested.malformed(df, "id", "body").collect()} == {900, 902}
    assert nested.json_values(df.limit(0), "id", "body").count() == 0


def test_long_strings_are_texts(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": ["x" * 39, {"b": "y" * 40}], "c": 10 ** 50})), (2, "[]"), (3, "nope")], "id long, body string")
    assert {tuple(r) for r in nested.embedded_texts(df, "id", "body").collect()} == {(1, 1, 40), (2, 0, 0)}
