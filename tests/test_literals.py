"""One-call constants equal their element-wise forms, including values that
need the fallback (quotes, backslashes) and empty values."""
from pyspark.sql import functions as F

from revlens.functions import literals as L


def _one(spark, c):
    return spark.range(1).select(c.alias("v")).collect()[0]["v"]


def test_const_array_and_map(spark):
    words = ["doctor", "wi-fi", "air conditioning", "é", "ñandú"]
    assert _one(spark, L.const(words)) == words
    assert _one(spark, L.const({"a": [0, 3], "b": [1]})) == {"a": [0, 3], "b": [1]}
    assert _one(spark, L.const({"x": 2, "y": -1})) == {"x": 2, "y": -1}


def test_const_fallback_and_empty(spark):
    odd = ["it's", "back\\slash", "plain"]
    assert _one(spark, L.const(odd)) == odd
    assert _one(spark, L.const([], "array<string>")) == []
    df = spark.range(1).select(L.const([], "array<string>").alias("v"))
    assert df.schema["v"].dataType.simpleString() == "array<string>"


def test_struct_array(spark):
    rows = [("Cost", "cheap"), ("Cost", "o'clock")]
    got = _one(spark, L.struct_array(rows, ("aspect", "keyword")))
    assert [tuple(r) for r in got] == rows
    got = _one(spark, L.struct_array(rows[:1], ("aspect", "keyword")))
    assert got[0]["aspect"] == "Cost" and got[0]["keyword"] == "cheap"


def test_const_folds_to_literal(spark):
    plan = spark.range(1).select(F.array_contains(L.const(["a", "b"]), F.lit("a")).alias("v")) \
        ._jdf.queryExecution().optimizedPlan().toString()
    # the whole expression is constant-folded: no function left, only the value
    assert "array_contains" not in plan and "true AS v" in plan
