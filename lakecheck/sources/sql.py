"""SQL text on registered frames, with run variables."""

from __future__ import annotations

import re
import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

_PLACEHOLDER = re.compile(r"\{([A-Za-z_]\w*)([+-]\d+)?\}")
# an identifier path, a number, a date or a time, or a run id of such parts; no blanks, quotes or comments
_PLAIN_VALUE = re.compile(r"(?!.*--)[\w.:/@+-]*")


def run_variables(as_of: date, run_id: str, config: dict[str, str] | None = None) -> dict[str, str]:
    """``run_id``, ``run_date`` and ``CURRENT_DATE``, then configured variables, which win and may use them."""
    values = {"run_id": run_id, "run_date": as_of.isoformat(), "CURRENT_DATE": as_of.isoformat()}
    for name, value in (config or {}).items():
        values[name] = bind(str(value), values)
    return values


def bind(text: str, variables: dict[str, str]) -> str:
    """Fill ``{name}`` and, for dates, ``{name-5}``; unknown names stay.

    Meant for the names of databases and tables and for plain run values, so a value with blanks, quotes, comments or
    other SQL syntax is refused. Data values belong into ``args`` of :func:`run_sql`.
    """

    def fill(match: re.Match) -> str:
        name, shift = match[1], match[2]
        whole = f"{name}{shift or ''}"
        if whole in variables:
            value = variables[whole]
        elif name in variables and shift:
            value = (date.fromisoformat(variables[name]) + timedelta(days=int(shift))).isoformat()
        else:
            return match[0]
        if not _PLAIN_VALUE.fullmatch(value):
            raise ValueError(f"variable {whole} holds SQL syntax: {value!r}")
        return value

    return _PLACEHOLDER.sub(fill, text)


def run_sql(
    spark: SparkSession,
    text: str,
    views: dict[str, DataFrame] | None = None,
    variables: dict[str, str] | None = None,
    args: dict[str, object] | None = None,
) -> DataFrame:
    """Fill the variables and run the text lazily on the frames, which it names as ``{name}``.

    Frames are registered under names of their own and dropped again, so views of the session stay as they are.
    """
    own = {name: f"{name}_{uuid.uuid4().hex}" for name in views or {}}
    try:
        for name, alias in own.items():
            views[name].createOrReplaceTempView(alias)
        return spark.sql(bind(text, {**(variables or {}), **own}), args=args or {})
    finally:
        for alias in own.values():
            spark.catalog.dropTempView(alias)
