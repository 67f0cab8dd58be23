"""Comparisons of two results: scalar rules and the row-level difference on composite keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecheck.functions.exprs import when_status, wider_number

SCALAR_RULES = (
    "match",
    "difference_within",
    "percentage_within",
    "a_greater_than_b",
    "a_less_than_b",
    "a_equals_zero",
    "b_equals_zero",
    "a_not_zero",
    "b_not_zero",
    "custom",
)


def scalar(df: DataFrame, column: str | None = None) -> DataFrame:
    """``n, v``: the rows of a frame and, where it has one, the value of the named or first numeric column."""
    if column is None:
        column = next((f.name for f in df.schema if isinstance(f.dataType, T.NumericType)), None)
        if column is None:
            raise ValueError("no numeric column to compare")
    return df.agg(F.count(F.lit(1)).alias("n"), F.any_value(F.col(column)).alias("v"))


def compare(
    a: DataFrame,
    b: DataFrame,
    rule: str,
    column: str | None = None,
    tolerance: float = 0,
    expression: str | None = None,
    name: str = "",
) -> DataFrame:
    """One row: both values, and whether the rule holds for them. A missing value fails every rule but match.

    A side of several rows has no value to compare: the status is NOT_EXECUTED and its value NULL.
    """
    if rule not in SCALAR_RULES:
        raise ValueError(f"unknown comparison rule {rule}")
    left, right = scalar(a, column), scalar(b, column)
    numeric = all(isinstance(d.schema["v"].dataType, T.NumericType) for d in (left, right))
    to = "double" if numeric or rule != "match" else "string"
    sides = a.sparkSession.range(1).select(
        *[d.select(F.struct("n", F.when(F.col("n") == 1, F.col("v")).cast(to).alias("v"))).scalar().alias(s) for s, d in (("a", left), ("b", right))]
    )
    both = sides.select(F.col("a.v").alias("a_val"), F.col("b.v").alias("b_val"), ((F.col("a.n") > 1) | (F.col("b.n") > 1)).alias("several"))
    return both.select(
        F.lit(name).alias("name"),
        F.lit(rule).alias("rule"),
        F.col("a_val").alias("value_a"),
        F.col("b_val").alias("value_b"),
        F.when(F.col("several"), "NOT_EXECUTED").otherwise(when_status(_holds(rule, tolerance, expression))).alias("status"),
    )


def _holds(rule: str, tolerance: float, expression: str | None) -> Column:
    a, b = F.col("a_val"), F.col("b_val")
    if rule == "match":
        return a.eqNullSafe(b)
    if rule == "difference_within":
        return F.abs(a - b) <= F.lit(float(tolerance))
    if rule == "percentage_within":
        base = F.greatest(F.abs(a), F.abs(b))
        return F.when(base == 0, 0.0).otherwise(F.abs(a - b) / base * 100) <= F.lit(float(tolerance))
    if rule == "a_greater_than_b":
        return a > b
    if rule == "a_less_than_b":
        return a < b
    if rule == "custom":
        if not expression:
            raise ValueError("a custom rule needs an expression")
        # max and min take two values here, not a column
        return F.expr(re.sub(r"\bmin\(", "least(", re.sub(r"\bmax\(", "greatest(", expression)))
    side = a if rule.startswith("a_") else b
    return side == 0 if rule.endswith("equals_zero") else side != 0


KIND, NAMES = "_kind", "_names"

# ---- row-level difference ----------------------------------------------------------------------


def data_diff(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    columns: list[str] = (),
    case_sensitive: bool = True,
    null_as_empty: bool = False,
    segments: int | None = None,
) -> DataFrame:
    """One row per differing key: its kind, and for a mismatch the columns that differ.

    Both sides are stacked and reduced to one row per key by a single aggregation, so there is one
    shuffle, no join, and a key repeated on either side is combined before it. Of a repeated key the
    smallest row in column order is compared. NULL equals NULL, and equals blank text on request. Columns
    of one type on both sides keep it, others are compared as text. Nothing is cut.

    With ``segments``, for tables that are expected to be nearly equal, keys are first dealt into so many segments by
    their hash, and only rows of segments whose digests differ are compared (see ``_unequal_only``). Equal tables then
    cost one hash aggregate that shuffles a row per segment and task, and no row of theirs is shuffled or sorted.
    """
    keys, columns = list(keys), list(columns)
    stacked = _stacked(a, b, keys, columns, case_sensitive, null_as_empty)
    grouped = _by_key(_unequal_only(stacked, keys, segments) if segments else stacked, keys, columns)
    told = grouped.filter(F.col(KIND) != "same").select(*keys, F.col(KIND).alias("kind"), F.col(NAMES).alias("diff_columns"))
    if len(set(told.columns)) < len(told.columns):
        raise ValueError("a key column is named kind or diff_columns; rename it")
    return told


def data_diff_values(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    columns: list[str],
    case_sensitive: bool = True,
    null_as_empty: bool = False,
    segments: int | None = None,
) -> DataFrame:
    """``keys, column_name, value_a, value_b`` as text, one row per differing column of a key on both sides. Nothing is cut."""
    keys, columns = list(keys), list(columns)
    stacked = _stacked(a, b, keys, columns, case_sensitive, null_as_empty)
    grouped = _by_key(_unequal_only(stacked, keys, segments) if segments else stacked, keys, columns)
    entries = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"_a._{i}").cast("string").alias("value_a"), F.col(f"_b._{i}").cast("string").alias("value_b"), (~F.col(f"_a._{i}").eqNullSafe(F.col(f"_b._{i}"))).alias("differs"))
        for i, c in enumerate(columns)
    ]
    mismatches = grouped.filter(F.col(KIND) == "mismatch").select(*keys, F.explode(F.filter(F.array(*entries), lambda e: e["differs"])).alias("_e"))
    return mismatches.select(*keys, "_e.column_name", "_e.value_a", "_e.value_b")


def data_diff_summary(
    a: DataFrame,
    b: DataFrame,
    keys: list[str],
    columns: list[str] = (),
    case_sensitive: bool = True,
    null_as_empty: bool = False,
    segments: int | None = None,
) -> DataFrame:
    """Row counts, differing keys by kind, repeated keys and status.

    With ``segments`` the counts come from an aggregate that carries keys and counts only, and the mismatches from the
    rows of unequal segments, as in ``data_diff``.
    """
    keys, columns = list(keys), list(columns)
    stacked = _stacked(a, b, keys, columns, case_sensitive, null_as_empty)
    in_a = F.col("_in_a")

    def rows(c: str | Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    def repeats(c: str) -> Column:
        return rows(F.greatest(F.col(c) - 1, F.lit(0)))

    if segments:
        grouped = stacked.groupBy(*keys).agg(F.count_if(in_a).alias("rows_a"), F.count_if(~in_a).alias("rows_b"))
        unequal = _by_key(_unequal_only(stacked, keys, segments), keys, columns)
        mismatches = unequal.agg(F.count_if(F.col(KIND) == "mismatch")).scalar()
    else:
        grouped = _by_key(stacked, keys, columns)
        mismatches = F.count_if(F.col(KIND) == "mismatch")
    counted = grouped.agg(
        rows("rows_a").alias("rows_a"),
        rows("rows_b").alias("rows_b"),
        F.count_if(F.col("rows_b") == 0).alias("only_in_a"),
        F.count_if(F.col("rows_a") == 0).alias("only_in_b"),
        *([] if segments else [mismatches.alias("value_mismatches")]),
        repeats("rows_a").alias("duplicates_a"),
        repeats("rows_b").alias("duplicates_b"),
    )
    if segments:
        counted = counted.withColumn("value_mismatches", mismatches)
    same = (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0) & (F.col("value_mismatches") == 0)
    order = ["rows_a", "rows_b", "only_in_a", "only_in_b", "value_mismatches", "duplicates_a", "duplicates_b"]
    return counted.select(*order, when_status(same).alias("status"))


def _stacked(
    a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], case_sensitive: bool, null_as_empty: bool
) -> DataFrame:
    """The rows of both sides as ``keys, _in_a, _row``, in the form in which they are compared."""
    for side, df in (("a", a), ("b", b)):
        missing = [c for c in keys + columns if c not in df.columns]
        if missing:
            raise ValueError(f"columns {missing} not found in side {side} (available: {df.columns})")

    def value(c: str) -> Column:
        """As it is where both sides agree on the type, in the wider type of two numbers, else as text."""
        kind, other = a.schema[c].dataType, b.schema[c].dataType
        if kind != other and isinstance(kind, T.NumericType) and isinstance(other, T.NumericType):
            return F.col(c).cast(wider_number(kind, other))
        if kind == other and not isinstance(kind, T.StringType):
            return F.col(c)
        text = F.col(c).cast("string")
        text = text if case_sensitive else F.lower(text)
        return F.coalesce(text, F.lit("")) if null_as_empty else text

    def side(df: DataFrame, in_a: bool) -> DataFrame:
        picked = [value(c).alias(c) for c in keys]
        row = F.struct(*[value(c).alias(f"_{i}") for i, c in enumerate(columns)]) if columns else F.lit(0)
        return df.select(*picked, F.lit(in_a).alias("_in_a"), row.alias("_row"))

    return side(a, True).unionByName(side(b, False))


def _unequal_only(stacked: DataFrame, keys: list[str], segments: int) -> DataFrame:
    """The rows of segments in which the two sides hold different rows.

    The digest of a segment and side is the number of its rows, the sums of both halves of a 64-bit row hash, and the
    exclusive or of a second one. Equal sets of rows, repeats included, have equal digests; unequal ones pass for equal
    with a probability of some 2 ** -128. What is broadcast is at most one number per segment; where no segment
    differs, adaptive execution drops the second read of the tables.
    """
    segment = F.pmod(F.xxhash64(*keys), F.lit(segments).cast("bigint"))
    row, second = F.xxhash64(*keys, "_row"), F.xxhash64(F.lit(7), *keys, "_row")
    sign = F.when(F.col("_in_a"), 1).otherwise(-1).cast("bigint")
    halves = row.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(row, 32)
    digests = stacked.groupBy(segment.alias("_segment")).agg(
        F.sum(sign).alias("n"), *[F.sum(sign * half).alias(f"h{i}") for i, half in enumerate(halves)], F.bit_xor(second).alias("x")
    )
    unequal = digests.where("n <> 0 OR h0 <> 0 OR h1 <> 0 OR x <> 0").select("_segment")
    return stacked.withColumn("_segment", segment).join(F.broadcast(unequal), "_segment", "left_semi").drop("_segment")


def _by_key(stacked: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    in_a = F.col("_in_a")
    grouped = stacked.groupBy(*keys).agg(
        F.count_if(in_a).alias("rows_a"),
        F.count_if(~in_a).alias("rows_b"),
        F.min(F.when(in_a, F.col("_row"))).alias("_a"),
        F.min(F.when(~in_a, F.col("_row"))).alias("_b"),
    )
    differing = [
        F.when(~F.col(f"_a._{i}").eqNullSafe(F.col(f"_b._{i}")), F.lit(c)) for i, c in enumerate(columns)
    ]
    names = F.concat_ws(",", *differing) if columns else F.lit("")
    kind = (
        F.when(F.col("rows_b") == 0, "only_in_a")
        .when(F.col("rows_a") == 0, "only_in_b")
        .when(F.col(NAMES) != "", "mismatch")
        .otherwise("same")
    )
    paired = (F.col("rows_a") > 0) & (F.col("rows_b") > 0)
    return grouped.withColumn(NAMES, F.when(paired, names).otherwise("")).withColumn(KIND, kind)


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct composite keys; a key with a missing part is not counted."""
    return df.agg(F.count_distinct(*keys).alias("cnt"))
