import pytest
from pyspark.sql import functions as F

from lakecheck.operators import compare, keys
from tests.conftest import rows

A = [(1, "x", "a"), (2, "x", "b"), (None, "x", "n"), (3, None, "c"), (3, None, "c2")]
B = [(1, "x", "A"), (2, "y", "b"), (None, "x", "n"), (3, None, "c")]
SCHEMA = "k int, s string, v string"


@pytest.fixture(scope="module")
def sides(spark):
    return spark.createDataFrame(A, SCHEMA), spark.createDataFrame(B, SCHEMA)


def one(spark, value, kind="double"):
    return spark.createDataFrame([(value,)], f"v {kind}")


def holds(spark, a, b, rule, **options):
    return compare.compare(one(spark, a), one(spark, b), rule, **options).first()["status"] == "PASS"


def test_scalar_rules(spark):
    assert holds(spark, 1.0, 1.0, "match") and not holds(spark, 1.0, 2.0, "match")
    assert holds(spark, None, None, "match")
    assert holds(spark, 1.0, 3.0, "difference_within", tolerance=2)
    assert holds(spark, 0.0, 0.0, "percentage_within")
    assert holds(spark, -100.0, -90.0, "percentage_within", tolerance=10)
    assert not holds(spark, None, 1.0, "difference_within", tolerance=9)
    assert holds(spark, 2.0, 1.0, "a_greater_than_b") and holds(spark, 1.0, 2.0, "a_less_than_b")
    assert holds(spark, 0.0, 5.0, "a_equals_zero") and not holds(spark, None, 5.0, "a_equals_zero")
    assert not holds(spark, None, 5.0, "a_not_zero") and holds(spark, None, 5.0, "b_not_zero")
    assert holds(spark, 3.0, 4.0, "custom", expression="max(a_val, b_val) - min(a_val, b_val) <= 1")
    with pytest.raises(ValueError):
        holds(spark, 1.0, 1.0, "nearly")


def test_first_numeric_column_is_compared(spark):
    a = spark.createDataFrame([("x", 5)], "name string, n int")
    assert compare.compare(a, a, "match").first()["value_a"] == 5.0
    assert compare.compare(a, a, "match", column="name").first()["value_a"] == "x"


def test_difference_of_rows(sides):
    a, b = sides
    got = rows(compare.data_diff(a, b, ["k", "s"], ["v"]))
    assert got == [(1, "x", "mismatch", "v"), (2, "x", "only_in_a", ""), (2, "y", "only_in_b", "")]
    assert rows(compare.data_diff(a, b, ["k", "s"], ["v"], case_sensitive=False)) == [
        (2, "x", "only_in_a", ""),
        (2, "y", "only_in_b", ""),
    ]
    summary = compare.data_diff_summary(a, b, ["k", "s"], ["v"]).first()
    assert tuple(summary) == (5, 4, 1, 1, 1, 1, 0, "FAIL")


def test_difference_with_itself_is_empty(sides):
    a, _ = sides
    assert compare.data_diff(a, a, ["k", "s"], ["v"]).count() == 0
    assert compare.data_diff_summary(a, a, ["k"], []).first()["status"] == "PASS"


def test_sides_are_symmetric(sides):
    a, b = sides
    there = rows(compare.data_diff(a, b, ["k", "s"], ["v"]).filter("kind = 'only_in_a'"), "k", "s")
    back = rows(compare.data_diff(b, a, ["k", "s"], ["v"]).filter("kind = 'only_in_b'"), "k", "s")
    assert there == back


def test_null_and_blank(spark):
    a = spark.createDataFrame([(1, None)], "k int, v string")
    b = spark.createDataFrame([(1, "")], "k int, v string")
    assert compare.data_diff(a, b, ["k"], ["v"]).count() == 1
    assert compare.data_diff(a, b, ["k"], ["v"], null_as_empty=True).count() == 0


def test_columns_of_different_types_are_compared_as_text(spark):
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    b = spark.createDataFrame([("1", "5"), ("2", "7")], "k string, v string")
    assert rows(compare.data_diff(a, b, ["k"], ["v"])) == [("2", "mismatch", "v")]


def test_only_keys(sides):
    a, b = sides
    assert rows(compare.data_diff(a, b, ["k", "s"]), "k", "s", "kind") == [(2, "x", "only_in_a"), (2, "y", "only_in_b")]


def test_unknown_key_column_is_named(sides):
    with pytest.raises(ValueError, match="gone"):
        compare.data_diff(*sides, ["gone"])


def test_key_sets(sides):
    a, b = sides
    assert rows(keys.keys_only_in(a, b, ["k", "s"])) == [(2, "x")]
    assert rows(keys.keys_common(a, b, ["k", "s"])) == [(1, "x"), (3, None), (None, "x")]


def test_distinct_composite_key_skips_missing_parts(sides):
    assert compare.distinct_keys(sides[0], ["k", "s"]).first()[0] == 2


def test_values_of_each_difference(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (3, None, 3.0)], "k int, s string, n double")
    b = spark.createDataFrame([(1, "x", 1), (2, "z", 5), (3, "w", 3)], "k bigint, s string, n int")
    got = compare.data_diff_values(a, b, ["k"], ["s", "n"])
    assert rows(got) == [(2, "n", "2.0", "5.0"), (2, "s", "y", "z"), (3, "s", None, "w")]
    assert dict(got.dtypes)["k"] == "bigint"


def test_decimals_of_unlike_scale_are_equal(spark):
    a, b = (spark.sql(f"SELECT 1 AS k, CAST(1.5 AS DECIMAL({t})) AS n") for t in ("10,1", "20,4"))
    assert compare.data_diff(a, b, ["k"], ["n"]).count() == 0


def test_key_columns_that_clash_with_the_result(spark):
    df = spark.createDataFrame([("a", 1)], "kind string, n int")
    with pytest.raises(ValueError):
        compare.data_diff(df, df, ["kind"], ["n"])
    assert compare.data_diff_summary(df, df, ["kind"], ["n"]).first()["status"] == "PASS"


def test_segments_give_the_same_differences(spark, sides):
    a, b = sides
    twice = a.unionByName(a.filter("k = 2")).unionByName(spark.createDataFrame([(2, "x", "a")], SCHEMA))
    for segments, left, right, columns, options in (
        (1, a, b, ["v"], {}),
        (3, b, a, ["v"], {"case_sensitive": False}),
        (1 << 16, twice, a, ["v"], {"null_as_empty": True}),
        (3, a, twice, [], {}),
        (3, twice, twice, ["v"], {}),
        (3, a.limit(0), b, ["v"], {}),
    ):
        args = (left, right, ["k", "s"], columns)
        assert rows(compare.data_diff(*args, segments=segments, **options)) == rows(compare.data_diff(*args, **options))
        assert rows(compare.data_diff_summary(*args, segments=segments, **options)) == rows(compare.data_diff_summary(*args, **options))
    assert rows(compare.data_diff_values(a, b, ["k"], ["s", "v"], segments=3)) == rows(compare.data_diff_values(a, b, ["k"], ["s", "v"]))


def test_repeats_that_cancel_each_other_are_seen(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (1, "y"), (1, "x")], "k int, v string")
    unequal = compare._unequal_only(compare._stacked(a, b, ["k"], ["v"], True, False), ["k"], 8)
    assert unequal.count() == 6
    assert compare._unequal_only(compare._stacked(a, a, ["k"], ["v"], True, False), ["k"], 8).count() == 0


def test_missing_keys_with_a_filter(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(0, 300, 3)] + [(None, "n"), (5000, "m"), (5000, "o")], "k int, v string")
    b = spark.range(0, 2000, 2).select(F.col("id").cast("int").alias("k"))
    b = b.unionByName(b.filter("k = 6"))
    key = F.col("k")
    want = rows(keys.missing_rows(a, b, key, key), "k", "v")
    for expected in (1, 103, 10**9):
        assert rows(keys.missing_rows(a, b, key, key, expected), "k", "v") == want
        assert keys.missing_count(a, b, key, key, expected).first()[0] == len(want)
    assert keys.missing_count(a, b.limit(0), key, key, 10).first()[0] == a.count()
    assert keys.missing_count(a.limit(0), b, key, key, 10).first()[0] == 0
