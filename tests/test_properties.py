"""Event properties that may be recorded, by hand."""

import json

import pytest

from attestlake.plans.texts import typed_properties
from pyspark.sql import functions as F

ROWS = [
    ('{"b": 1, "a": " x ", "d": true, "e": null, "f": [1], "g": {"h": 1}}', {"a": "x", "b": 1, "d": True, "e": None}),
    ('{"user_id": 1, "nickname": 2, "Case": 3, "9x": 4, "ok_9": 5}', {"ok_9": 5}),
    ('{"n": 1e999, "m": -1e999, "k": 9007199254740993, "q": -0.25}', {"k": 9007199254740993, "q": -0.25}),
    (json.dumps({"s": "y" * 120, "t": "y" * 121, "u": " " * 200 + "z"}), {"s": "y" * 120, "u": "z"}),
    (json.dumps({f"k{i}": "y" * 120 for i in range(40)}), {}),
    ('{"a": 1, "a": 2}', {}), ('[1]', {}), ('"text"', {}), ("broken{", {}), ("", {}), (None, {}), ("{}", {}),
]


@pytest.mark.parametrize(("props", "kept"), ROWS)
def test_typed_properties(spark, props, kept):
    [row] = spark.createDataFrame([(props,)], "p string").select(typed_properties(F.col("p")).alias("kept")).collect()
    assert json.loads(row.kept) == kept and list(json.loads(row.kept)) == sorted(kept)
