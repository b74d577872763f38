"""Small numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def balance(a: Column, b: Column) -> Column:
    """(a-b)/(a+b) in [-1, 1]; 0 where the total is not positive."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(a + b > 0, (a - b) / (a + b)).otherwise(0.0)


def rate(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """part/whole, or ``empty`` where the whole is missing, zero or negative."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(float(empty)))


def micros(ts: Column) -> Column:
    """Event time in microseconds; zone-less timestamps are read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def whole_division(x: Column, by: int) -> Column:
    """Exact integer division rounding down; a float quotient can cross an edge."""
    whole, divisor = x.cast("long"), F.lit(int(by)).cast("long")
    return F.call_function("div", whole - F.pmod(whole, divisor), divisor)


def lookup(table: dict, key: Column) -> Column:
    """Value of ``key`` in a small fixed table, null when absent."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.element_at(F.create_map(*pairs), key)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two position structs."""
    squares = [F.pow(a[axis] - b[axis], F.lit(2.0)) for axis in ("x", "y", "z")]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add costly columns so that they are computed exactly once per row.

    A filter is pushed through a projection by copying the expressions it reads,
    and a long expression reads its input many times. The partition guard, true
    for every row, keeps the optimizer from copying the column.
    """
    guard = F.spark_partition_id() >= 0
    return df.withColumns({name: F.when(guard, c) for name, c in columns.items()})
