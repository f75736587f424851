import pytest
from pyspark.sql import functions as F

from feedloom.functions import values


@pytest.mark.parametrize("text, kind, data", [
    ("null", "null", False), ("true", "bool", True), ("false", "bool", False), ("0", "number", False), ("0.0", "number", False), ("-3", "number", True),
    ('""', "string", False), ('"0"', "string", True), ("[]", "json", False), ("[0]", "json", True), ("{}", "json", False), (None, None, False),
])
def test_kind_and_data(spark, text, kind, data):
    row = spark.createDataFrame([(text,)], "t string").select(values.kind(F.col("t")).alias("k"), values.has_data(F.col("t")).alias("d")).first()
    assert (row.k, row.d) == (kind, data)


@pytest.mark.parametrize("a, b, same", [
    ("1", "1.0", True), ("true", "1", True), ("false", "0.0", True), (None, "null", True), ('"1"', "1", False), ('"[1]"', "[1]", False),
    ("1.50", "1.5", True), ("9007199254740993", "9007199254740992", False), ("1E2", "100", True), ("0.1", "0.10000000001", False),
])
def test_equality(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select((values.equality_key(F.col("a")) == values.equality_key(F.col("b"))).alias("e")).first().e is same
