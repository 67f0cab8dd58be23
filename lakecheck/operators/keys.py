"""Row filters, derived columns and key joins."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecheck.functions.exprs import (
    DEADLINE_ZONE,
    as_col,
    between_days,
    first_match,
    instant,
    like_any,
    local_time,
    on_day,
)
from lakecheck.functions.membership import bloom_filter, filter_bits, may_hold


def with_ingest_columns(df: DataFrame, as_of: datetime, loaded_by: str, zone: str = DEADLINE_ZONE) -> DataFrame:
    """Processing flags, load times (local and UTC) and the loading user."""
    utc, local = instant(as_of), local_time(instant(as_of), zone)
    return df.withColumns(
        {
            "hourly_processed_ind": F.lit("N"),
            "daily_processed_ind": F.lit("N"),
            "insert_timestamp": local,
            "inserted_by": F.lit(loaded_by),
            "updated_timestamp": local,
            "updated_by": F.lit(loaded_by),
            "load_timestamp": utc,
        }
    )


def load_slice(df: DataFrame, day: date, load: str = "load_ts", update: str | None = None) -> DataFrame:
    """Rows loaded on a day, or loaded or updated on it when an update column is given."""
    kept = on_day(df, load, day)
    if update:
        kept = kept | on_day(df, update, day)
    return df.filter(kept)


def audit_selection(
    audit: DataFrame,
    first: date,
    last: date,
    event_types: list[str] | None = None,
    statuses: list[str] | None = None,
    run_contains: str | None = None,
) -> DataFrame:
    """Audit rows of a date range, narrowed by type, status and a piece of the run id in any case."""
    kept = F.col("run_date").between(first.isoformat(), last.isoformat())
    if event_types:
        kept = kept & F.col("event_type").isin(event_types)
    if statuses:
        kept = kept & F.col("status").isin(statuses)
    if run_contains:
        kept = kept & F.lower("run_id").contains(run_contains.lower())
    return audit.filter(kept)


def mask_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace values by their SHA-256; NULL stays NULL."""
    return df.withColumns({c: F.sha2(F.col(c).cast("string"), 256) for c in columns})


def retained(df: DataFrame, column: str, as_of: date, years: int) -> DataFrame:
    """Rows not older than ``years``."""
    oldest = F.add_months(F.lit(as_of), -12 * years)
    if not isinstance(df.schema[column].dataType, T.DateType):
        oldest = oldest.cast("timestamp_ntz")
    return df.filter(F.col(column) >= oldest)


def labelled_totals(counts: DataFrame, name: str, value: str, choices: dict[str, str], default: str) -> DataFrame:
    """Sum a value by a label chosen from LIKE patterns on a name."""
    label = first_match(default, *[(like_any(name, pattern), text) for pattern, text in choices.items()])
    return counts.groupBy(label.alias("source_system")).agg(F.sum(value).alias("total_rows"))


def missing_rows(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, expected: int | None = None) -> DataFrame:
    """Rows of ``a`` whose key is absent in ``b``. A key that fills much of ``b`` is reduced first.

    ``expected`` is for a slice against a large table: see ``reference_keys``.
    """
    known = reference_keys(a, b, key_a, key_b, expected)
    return a.withColumn("_key", key_a).join(known, "_key", "left_anti").drop("_key")


def missing_count(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, expected: int | None = None) -> DataFrame:
    """Number of such rows. Both sides are reduced to one row per key before they meet."""
    counted = a.groupBy(key_a.alias("_key")).agg(F.count(F.lit(1)).alias("_rows"))
    known = reference_keys(a, b, key_a, key_b, expected)
    return counted.join(known, "_key", "left_anti").agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("cnt"))


def reference_keys(a: DataFrame, b: DataFrame, key_a: Column, key_b: Column, expected: int | None = None) -> DataFrame:
    """``_key``: the distinct keys of ``b`` that matter to a search for keys of ``a``.

    With ``expected``, about how many distinct keys ``a`` has, a Bloom filter of these drops the keys of ``b`` that
    ``a`` surely does not have before they are shuffled. A key that passes by chance costs its row, never a result:
    the join that follows is exact. The filter is left out where it would grow over its bound. A filter of the other
    side would not do: that a key passes it does not prove that the reference has it.
    """
    keys = b.select(key_b.alias("_key"))
    bits = filter_bits(expected) if expected is not None else None
    if bits:
        keys = keys.where(may_hold(bloom_filter(a.select(key_a.alias("_key")), F.col("_key"), bits), F.col("_key"), bits))
    return keys.distinct()


def key_presence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with the sides they occur on; NULL equals NULL.

    One aggregation over both sides, combined before the shuffle, in place of a join.
    """
    sides = [df.select(*keys, F.lit(side).alias("_in_a")) for df, side in ((a, True), (b, False))]
    in_a, in_b = F.bool_or("_in_a"), F.bool_or(~F.col("_in_a"))
    return sides[0].unionByName(sides[1]).groupBy(*keys).agg(in_a.alias("_in_a"), in_b.alias("_in_b"))


def keys_only_in(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` does not hold."""
    return key_presence(a, b, keys).filter(F.col("_in_a") & ~F.col("_in_b")).select(*keys)


def keys_common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return key_presence(a, b, keys).filter(F.col("_in_a") & F.col("_in_b")).select(*keys)


def latest_rows(df: DataFrame, day: str, category: str | None = None) -> DataFrame:
    """Rows at the latest day, of the table or of each category."""
    if category is None:
        return df.filter(F.col(day) == df.agg(F.max(day)).scalar())
    latest = df.groupBy(category).agg(F.max(day).alias(day))
    return df.join(latest, [category, day], "left_semi")


def within_days(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    return df.filter(between_days(df, column, first, last))


def dedup_latest(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key: the first in the given order, which must include a tie-break.

    Spark limits each key to one row per map task before the shuffle, so a frequent key stays cheap.
    """
    window = Window.partitionBy(*keys).orderBy(*[as_col(o) for o in order])
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")
