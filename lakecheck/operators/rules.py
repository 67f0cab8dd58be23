"""Table rules compiled to aggregates.

A table whose rules look at single rows only is read by one global aggregate. Tables with uniqueness or reference
rules are read once as well, and together: each row is dealt out as one entry per key rule, with the key in columns
of its own type, and one per row rule that it fails. One aggregate by rule and key counts the entries of all tables,
combined before its only shuffle, and a second one over the counts has a result for each rule. No key group is ever
gathered, and all comparisons are of the values themselves.
"""

from __future__ import annotations

import json
from collections import defaultdict
from dataclasses import dataclass, replace
from datetime import date, datetime
from functools import reduce

from pyspark.errors import AnalysisException, ParseException, PySparkException, SparkRuntimeException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecheck.functions.exprs import instant, wider_number

ROW_TYPES = ("NOT_NULL", "RANGE", "REGEX", "ROW_COUNT", "BUSINESS")
COMPARE_OPERATORS = (">=", ">", "<=", "<", "=", "==", "!=", "<>")


@dataclass(frozen=True)
class Rule:
    rule_name: str
    rule_type: str
    table: str
    column: str | tuple[str, ...] | None = None
    min_value: object = None
    max_value: object = None
    pattern: str | None = None
    ref_table: str | None = None
    ref_column: str | None = None
    operator: str = ">="
    threshold: int = 0
    condition: str | None = None
    severity: str = "MEDIUM"
    constraint: str = ""
    database: str = ""
    ref_database: str = ""

    @classmethod
    def from_config(cls, config: dict) -> Rule:
        """From a configured rule; a column may be a name or a list, and ``*`` means none."""
        known = {f: config[f] for f in cls.__dataclass_fields__ if config.get(f) is not None}
        column = known.pop("column", None)
        if isinstance(column, list):
            known["column"] = tuple(column)
        elif column and column != "*":
            known["column"] = column
        known.setdefault("constraint", config.get("constraint_description", ""))
        return cls(**known)

    @property
    def columns(self) -> tuple[str, ...]:
        if self.column is None:
            return ()
        return (self.column,) if isinstance(self.column, str) else tuple(self.column)


RULE_FIELDS = (
    "position INT, database_name STRING, table_name STRING, column_name STRING, rule_name STRING, "
    "rule_type STRING, severity STRING, expected_constraint STRING"
)
# position in the rule list, the rule, and the condition of a failing row
Entry = tuple[int, Rule, Column | None]
ERROR_FIELDS = "position int, error_message string"


def evaluate_rules(
    frames: dict[str, DataFrame], rules: list[Rule], run_id: str, as_of: datetime | date, suite: str = ""
) -> DataFrame:
    """One audit row per rule. A rule that does not resolve against its table becomes an ERROR row.

    ``frames`` are named by table, or by ``database.table``, which comes first for a rule with a database. Patterns
    and limits are read once, on constants, while the plan is built. A rule that breaks only while it runs, such as a
    condition with a failing cast, ends the job: see ``evaluate_rules_isolated``.
    """
    return _evaluated(frames, rules, run_id, as_of, suite).drop("position")


def evaluate_rules_isolated(
    frames: dict[str, DataFrame], rules: list[Rule], run_id: str, as_of: datetime | date, suite: str = ""
) -> DataFrame:
    """As ``evaluate_rules``, run at once: a rule of any type that breaks while it runs becomes an ERROR row.

    All rules run as one job. Only if that breaks are the rules of each table tried together, and only those of a
    table that breaks again one by one; the sound ones then share one job. What reaches the driver is one row per rule.
    """
    spark = next(iter(frames.values())).sparkSession

    def broken_by(positions: list[int]) -> str | None:
        try:
            _evaluated(frames, rules, run_id, as_of, suite, leave={i: "" for i in range(len(rules)) if i not in positions}).collect()
        except PySparkException as exc:
            return exc.getCondition() or "RUNTIME_ERROR"
        return None

    every = _evaluated(frames, rules, run_id, as_of, suite)
    try:
        return spark.createDataFrame(every.collect(), every.schema).drop("position")
    except PySparkException:
        pass
    by_table: dict[tuple[str, str], list[int]] = defaultdict(list)
    for position, rule in enumerate(rules):
        by_table[rule.database, rule.table].append(position)
    broken = {}
    for positions in by_table.values():
        whole = broken_by(positions)
        if whole:
            alone = {positions[0]: whole} if len(positions) == 1 else {i: broken_by([i]) for i in positions}
            broken |= {i: error for i, error in alone.items() if error}
    sound = _evaluated(frames, rules, run_id, as_of, suite, leave=broken)
    return spark.createDataFrame(sound.collect(), sound.schema).drop("position")


def _evaluated(frames: dict[str, DataFrame], rules: list[Rule], run_id: str, as_of, suite: str, leave: dict[int, str] | None = None) -> DataFrame:
    """The audit rows with their position; rules in ``leave`` are not run, and are errors with the given message."""
    spark = next(iter(frames.values())).sparkSession
    leave = leave or {}
    errors: dict[int, str] = dict(leave)
    by_table: dict[str, list[Entry]] = defaultdict(list)
    keyed: list[_KeyRule] = []
    counted: list[DataFrame] = []
    unread = _unreadable_constants(frames, {i: r for i, r in enumerate(rules) if i not in leave})
    for position, rule in enumerate(rules):
        if position in leave:
            continue
        try:
            if position in unread:
                raise ValueError(unread[position])
            kind = rule.rule_type.upper()
            if kind in ROW_TYPES:
                name = _frame_name(frames, rule.database, rule.table)
                by_table[name].append((position, rule, _bad_row(rule, frames[name])))
            elif kind == "UNIQUENESS":
                keyed.append(_uniqueness(frames, rule, position))
            elif kind == "REFERENTIAL":
                found = _referential(frames, rule, position)
                (keyed if isinstance(found, _KeyRule) else counted).append(found)
            else:
                raise ValueError(f"unknown rule type {rule.rule_type}")
        except (AnalysisException, ParseException) as exc:
            errors[position] = exc.getCondition() or "ANALYSIS_ERROR"
        except SparkRuntimeException as exc:
            errors[position] = exc.getCondition() or "RUNTIME_ERROR"
        except (KeyError, ValueError, TypeError) as exc:
            errors[position] = str(exc.args[0])
    sound = {}
    for table, entries in by_table.items():
        sound[table], unresolved = _resolving(frames[table], entries)
        errors |= unresolved
    with_keys = {name for k in keyed for name in k.tables}
    counted += [_one_pass(frames[table], entries) for table, entries in sound.items() if entries and table not in with_keys]
    if keyed:
        counted.append(_keyed_pass(frames, keyed, {t: e for t, e in sound.items() if t in with_keys}))

    if errors:
        told = spark.createDataFrame(list(errors.items()), ERROR_FIELDS)
        none = F.lit(0).cast("bigint")
        counted.append(told.select("position", none.alias("failed"), none.alias("total"), F.lit(None).cast("string").alias("sample"), "error_message"))
    if not counted:
        counted.append(spark.createDataFrame([], "position int, failed bigint, total bigint, sample string"))
    results = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counted)
    if "error_message" not in results.columns:
        results = results.withColumn("error_message", F.lit(None).cast("string"))
    return _audit_rows(results, rules, run_id, as_of, suite)


def _frame_name(frames: dict[str, DataFrame], database: str, table: str) -> str:
    """The key of a table in ``frames``: with its database if that is registered, else without."""
    name = f"{database}.{table}" if database else table
    if name in frames:
        return name
    if table in frames:
        return table
    raise ValueError(f"table {name} not found")


def _resolving(df: DataFrame, entries: list[Entry]) -> tuple[list[Entry], dict[int, str]]:
    """The row rules that resolve against their table, and the errors of the others.

    All are analysed together; only if that fails is each one tried alone.
    """
    try:
        _one_pass(df, entries)
        return entries, {}
    except AnalysisException:
        pass
    sound, errors = [], {}
    for entry in entries:
        try:
            _one_pass(df, [entry])
            sound.append(entry)
        except AnalysisException as exc:
            errors[entry[0]] = exc.getCondition() or "ANALYSIS_ERROR"
    return sound, errors


def _unreadable_constants(frames: dict[str, DataFrame], rules: dict[int, Rule]) -> dict[int, str]:
    """Errors of patterns and text limits, found by one query over constants.

    The engine that will run a pattern reads it once. Only where one of them is no pattern is each read alone.
    """
    patterns, limits, args = {}, {}, {}
    for i, r in rules.items():
        kind = r.rule_type.upper()
        if kind == "REGEX" and r.pattern is not None:
            patterns[i] = f"'' RLIKE :p{i}"
            args[f"p{i}"] = r.pattern
        if kind == "RANGE" and r.columns:
            for end, limit in (("lo", r.min_value), ("hi", r.max_value)):
                to = _limit_type(frames, r) if isinstance(limit, str) else None
                if to:
                    limits[i, end] = f"try_cast(:{end}{i} AS {to}) IS NOT NULL"
                    args[f"{end}{i}"] = limit
    if not args:
        return {}
    spark = next(iter(frames.values())).sparkSession

    def read(tests: dict) -> list:
        # a literal argument may be bound that no test names
        return list(spark.sql(f"SELECT {', '.join(tests.values())}", args=args).first()) if tests else []

    errors = {}
    try:
        read(patterns)
    except SparkRuntimeException:
        for i, test in patterns.items():
            try:
                read({i: test})
            except SparkRuntimeException as exc:
                errors[i] = exc.getCondition() or "RUNTIME_ERROR"
    for (i, _), readable in zip(limits, read(limits)):
        if not readable:
            errors[i] = "CAST_INVALID_INPUT"
    return errors


def _limit_type(frames: dict[str, DataFrame], rule: Rule) -> str | None:
    """What a limit given as text is read as; None where the column is text too, or is not there."""
    try:
        df = frames[_frame_name(frames, rule.database, rule.table)]
    except ValueError:
        return None
    kind = df.schema[rule.columns[0]].dataType if rule.columns[0] in df.columns else T.StringType()
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "double"
    if isinstance(kind, T.NumericType):
        return "decimal(38,12)"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return kind.simpleString()
    return None


def _bad_row(rule: Rule, df: DataFrame) -> Column | None:
    """The condition a failing row meets; None for a count rule."""
    kind = rule.rule_type.upper()
    if kind == "ROW_COUNT":
        if rule.operator not in COMPARE_OPERATORS:
            raise ValueError(f"unknown operator {rule.operator}")
        int(rule.threshold)  # raises where it is no number
        return None
    if kind == "BUSINESS":
        if not rule.condition:
            raise ValueError("condition is missing")
        return F.expr(rule.condition)
    if not rule.columns:
        raise ValueError("column is missing")
    value = F.col(rule.columns[0])
    if kind == "NOT_NULL":
        return value.isNull()
    if kind == "RANGE":
        if rule.min_value is None or rule.max_value is None:
            raise ValueError("min_value or max_value is missing")
        if _is_text(df, rule.columns[0]) and not isinstance(rule.min_value, str):
            # text that is no number lies outside the range
            number = value.try_cast("double")
            return value.isNotNull() & ~F.coalesce(number.between(F.lit(rule.min_value), F.lit(rule.max_value)), F.lit(False))
        to = _limit_type({rule.table: df}, replace(rule, database=""))
        limits = [F.lit(v).try_cast(to) if to and isinstance(v, str) else F.lit(v) for v in (rule.min_value, rule.max_value)]
        return ~value.between(*limits)
    if rule.pattern is None:
        raise ValueError("pattern is missing")
    return ~value.cast("string").rlike(rule.pattern)


def _is_text(df: DataFrame, column: str) -> bool:
    return column in df.columns and isinstance(df.schema[column].dataType, T.StringType)


def _count_failed(rule: Rule, total: str) -> str:
    """An empty table that should hold rows fails, although it has no row to count."""
    return f"if({total} {rule.operator} {int(rule.threshold)}, 0, greatest({total}, 1))"


def _one_pass(df: DataFrame, entries: list[Entry]) -> DataFrame:
    """All row rules of one table: a single aggregate, then one output row per rule."""
    marked, measures, rows = [], ["count(1) AS total"], []
    for position, rule, bad in entries:
        if bad is None:
            failed = _count_failed(rule, "total")
        else:
            failed = f"failed_{position}"
            marked.append(bad.alias(f"bad_{position}"))
            measures.append(f"count_if(bad_{position}) AS {failed}")
        sample = "NULL"
        if bad is not None and rule.columns:
            # the smallest failing value in its own type; turned into text only when reported
            sample = f"sample_{position}"
            marked.append(_sample(rule).alias(f"value_{position}"))
            measures.append(f"min(if(bad_{position}, value_{position}, NULL)) AS {sample}")
        rows.append(
            f"struct({position} AS position, CAST({failed} AS BIGINT) AS failed, total, CAST({sample} AS STRING) AS sample)"
        )
    return df.select(*marked).selectExpr(*measures).selectExpr(f"inline(array({', '.join(rows)}))")


# ---- rules on keys ------------------------------------------------------------------------------


@dataclass(frozen=True)
class _KeyRule:
    """A rule on the keys of ``table``, and of ``ref`` for a reference.

    ``key`` and ``ref_key`` are the values, in the types ``types``; ``own`` are the types of the table itself.
    """

    position: int
    rule: Rule
    table: str
    key: tuple[Column, ...]
    types: tuple[T.DataType, ...]
    own: tuple[T.DataType, ...]
    ref: str | None = None
    ref_key: Column | None = None

    @property
    def tables(self) -> list[str]:
        return [self.table, *([self.ref] if self.ref else [])]


def _uniqueness(frames: dict[str, DataFrame], rule: Rule, position: int) -> _KeyRule:
    if not rule.columns:
        raise ValueError("column is missing")
    table = _frame_name(frames, rule.database, rule.table)
    grouped = frames[table].groupBy(*rule.columns).agg(F.count(F.lit(1)))  # fails here where it cannot be grouped
    types = tuple(f.dataType for f in grouped.schema.fields[:-1])
    return _KeyRule(position, rule, table, tuple(F.col(c) for c in rule.columns), types, types)


def _referential(frames: dict[str, DataFrame], rule: Rule, position: int) -> _KeyRule | DataFrame:
    """Orphans counted per distinct value; NULLs on either side never count as orphans."""
    if not rule.columns:
        raise ValueError("column is missing")
    if not rule.ref_table:
        raise ValueError("ref_table is missing")
    table, ref = _frame_name(frames, rule.database, rule.table), _frame_name(frames, rule.ref_database, rule.ref_table)
    column, ref_column = F.col(rule.columns[0]), F.col(rule.ref_column or rule.columns[0])
    own, other = (df.groupBy(c.alias("v")).agg(F.count(F.lit(1))).schema["v"].dataType for df, c in ((frames[table], column), (frames[ref], ref_column)))
    numbers = isinstance(own, T.NumericType) and isinstance(other, T.NumericType)
    if own != other and not numbers:
        return _referential_join(frames[table], frames[ref], rule, position)
    to = wider_number(own, other) if own != other else own
    return _KeyRule(position, rule, table, (column.cast(to),), (to,), (own,), ref, ref_column.cast(to))


def _referential_join(df: DataFrame, ref: DataFrame, rule: Rule, position: int) -> DataFrame:
    """For keys of unlike types, which only Spark's own comparison brings together."""
    column = rule.columns[0]
    values = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    known = ref.select(F.col(rule.ref_column or column).alias("v")).distinct().withColumn("known", F.lit(True))
    orphan = F.col("v").isNotNull() & F.col("known").isNull()
    return values.join(known, "v", "left").agg(
        F.lit(position).alias("position"),
        F.coalesce(F.sum(F.when(orphan, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.min(F.when(orphan, F.col("v"))).cast("string").alias("sample"),
    )


class _Slots:
    """Key columns shared by all rules: one for each type, as often as one rule needs it."""

    def __init__(self) -> None:
        self.types: dict[str, T.DataType] = {}

    def of(self, types: tuple[T.DataType, ...]) -> list[str]:
        names, seen = [], defaultdict(int)
        for kind in types:
            text = kind.simpleString()
            name = f"{text}#{seen[text]}"
            seen[text] += 1
            self.types.setdefault(name, kind)
            names.append(name)
        return [f"_key_{list(self.types).index(n)}" for n in names]

    @property
    def columns(self) -> list[tuple[str, T.DataType]]:
        return [(f"_key_{i}", kind) for i, kind in enumerate(self.types.values())]


def _keyed_pass(frames: dict[str, DataFrame], keyed: list[_KeyRule], by_table: dict[str, list[Entry]]) -> DataFrame:
    """All key rules, and the row rules of their tables: every table read once, one shuffle of combined counts.

    Failing values of row rules are keys too, so a sample is the smallest of them; a negative zero shows as zero.
    """
    tables = list(dict.fromkeys(name for k in keyed for name in k.tables))
    slots = _Slots()
    key_slots = {k.position: slots.of(k.types) for k in keyed}
    samples: dict[int, tuple[str, Column]] = {}
    for table in tables:
        for position, rule, bad in by_table.get(table, ()):
            if bad is not None and rule.columns:
                value = _sample(rule)
                samples[position] = (slots.of((frames[table].select(value).schema[0].dataType,))[0], value)

    def entry(position: int, own: bool, values: dict[str, Column]) -> Column:
        filled = [values.get(n, F.lit(None)).cast(t).alias(n) for n, t in slots.columns]
        return F.struct(F.lit(position).alias("_rule"), F.lit(own).alias("_own"), *filled)

    parts = []
    for place, table in enumerate(tables):
        entries = []
        rows = by_table.get(table, [])
        if rows:
            entries.append(entry(-1 - place, True, {}))
        for position, _, bad in rows:
            if bad is not None:
                entries.append(F.when(bad, entry(position, True, dict([samples[position]] if position in samples else []))))
        for k in keyed:
            if k.table == table:
                entries.append(entry(k.position, True, dict(zip(key_slots[k.position], k.key))))
            if k.ref == table:
                entries.append(F.when(k.ref_key.isNotNull(), entry(k.position, False, {key_slots[k.position][0]: k.ref_key})))
        # each entry on a row of its own; a row has none for the row rules that it passes
        parts.append(frames[table].select(F.explode(F.array(*entries)).alias("_e")).where(F.col("_e").isNotNull()).select("_e.*"))
    own = F.col("_own")
    counts = reduce(DataFrame.unionByName, parts).groupBy("_rule", *(n for n, _ in slots.columns)).agg(F.count_if(own).alias("_n"), F.count_if(~own).alias("_known"))

    measures, rows = [], []

    def measured(position: int, here: Column, failing: Column, failed: Column, total: Column | None, sample: Column | None) -> None:
        measures.append(F.coalesce(F.sum(F.when(here & failing, failed)), F.lit(0)).alias(f"failed_{position}"))
        if total is not None:
            measures.append(F.coalesce(F.sum(F.when(here, total)), F.lit(0)).alias(f"total_{position}"))
        if sample is not None:
            measures.append(F.min(F.when(here & failing, sample)).alias(f"sample_{position}"))

    def told(position: int, failed: str, total: str, sample: bool) -> None:
        text = f"CAST(sample_{position} AS STRING)" if sample else "CAST(NULL AS STRING)"
        rows.append(f"struct({position} AS position, CAST({failed} AS BIGINT) AS failed, CAST({total} AS BIGINT) AS total, {text} AS sample)")

    n = F.col("_n")
    for k in keyed:
        here, names = F.col("_rule") == k.position, key_slots[k.position]
        if k.ref:
            failing, failed = (F.col("_known") == 0) & F.col(names[0]).isNotNull(), n
            value = F.col(names[0]).cast(k.own[0])
        else:
            failing, failed = n > 1, n - 1
            value = F.col(names[0]) if len(names) == 1 else F.concat_ws("^", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
        measured(k.position, here, failing, failed, n, value)
        told(k.position, f"failed_{k.position}", f"total_{k.position}", True)
    for place, table in enumerate(tables):
        if by_table.get(table):
            measures.append(F.coalesce(F.sum(F.when(F.col("_rule") == -1 - place, n)), F.lit(0)).alias(f"rows_{place}"))
        for position, rule, bad in by_table.get(table, ()):
            if bad is None:
                told(position, _count_failed(rule, f"rows_{place}"), f"rows_{place}", False)
                continue
            sample = F.col(samples[position][0]) if position in samples else None
            measured(position, F.col("_rule") == position, F.lit(True), n, None, sample)
            told(position, f"failed_{position}", f"rows_{place}", position in samples)
    return counts.agg(*measures).selectExpr(f"inline(array({', '.join(rows)}))")


def _sample(rule: Rule) -> Column:
    """What to show of a failing row."""
    if len(rule.columns) == 1:
        return F.col(rule.columns[0])
    return F.concat_ws("^", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rule.columns])


def _audit_rows(results: DataFrame, rules: list[Rule], run_id: str, as_of, suite: str) -> DataFrame:
    described = results.sparkSession.sql(
        f"SELECT inline(from_json(:rules, 'ARRAY<STRUCT<{RULE_FIELDS}>>'))",
        args={
            "rules": json.dumps(
                [
                    dict(
                        position=i,
                        database_name=r.database,
                        table_name=r.table,
                        column_name=",".join(r.columns),
                        rule_name=r.rule_name,
                        rule_type=r.rule_type.upper(),
                        severity=r.severity,
                        expected_constraint=r.constraint,
                    )
                    for i, r in enumerate(rules)
                ]
            )
        },
    )
    status = (
        F.when(F.col("error_message").isNotNull(), "ERROR").when(F.col("failed") == 0, "PASS").otherwise("FAIL")
    )
    # one row per configured rule on both sides: bounded by the rule list
    return results.join(F.broadcast(described), "position").select(
        "position",
        F.md5(F.concat_ws("^", F.lit(run_id), F.col("position"), F.col("rule_name"))).alias("record_id"),
        F.lit(run_id).alias("run_id"),
        F.lit(suite).alias("pipeline_name"),
        "database_name",
        "table_name",
        "column_name",
        "rule_name",
        "rule_type",
        "severity",
        "expected_constraint",
        F.col("sample").alias("failed_value"),
        F.col("failed").alias("row_count_failed"),
        F.col("total").alias("total_row_count"),
        status.alias("status"),
        "error_message",
        instant(as_of).alias("failure_timestamp"),
    )


def failure_rate(failed: str = "row_count_failed", total: str = "total_row_count") -> Column:
    """Failed share of the rows, 0 for an empty table."""
    share = F.try_divide(F.col(failed).cast("double"), F.col(total).cast("double"))
    return F.round(F.coalesce(share, F.lit(0.0)), 6)


def run_summary(rule_rows: DataFrame) -> DataFrame:
    """Totals by status, and the code a caller would exit with: 2 for errors, 1 for failures, else 0."""
    failed, errors = F.count_if(F.col("status") == "FAIL"), F.count_if(F.col("status") == "ERROR")
    return rule_rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        failed.alias("failed"),
        errors.alias("errors"),
        F.when(errors > 0, 2).when(failed > 0, 1).otherwise(0).alias("exit_code"),
    )
