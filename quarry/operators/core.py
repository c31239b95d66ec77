"""The relational operators, from DataFrame to DataFrame.

Predicates and functions come as text of the languages. Spark chooses the
physical form: filters reach the Parquet scan, small join sides are
broadcast, sums aggregate before the shuffle, sorts spill.
"""

from __future__ import annotations

from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.arithmetic import expr_column
from quarry.functions.predicates import cnf_column, order_of
from quarry.functions.scope import Scope, kind_of
from quarry.lang.parser import parse_cnf, parse_expr
from quarry.sources.scratch import new_folder


def select_file(spark: SparkSession, path: str, cnf: str) -> DataFrame:
    """Filtered scan of a Parquet table."""
    return select_pipe(spark.read.parquet(path), cnf)


def select_pipe(df: DataFrame, cnf: str, strict: bool = False) -> DataFrame:
    """Rows that satisfy a predicate."""
    return df.where(cnf_column(parse_cnf(cnf), Scope.of(df), strict))


def project(df: DataFrame, columns: list[str | int]) -> DataFrame:
    """Columns by name or place, in any order; a repeated one gets its place as suffix."""
    names = [df.columns[c] if isinstance(c, int) else c for c in columns]
    seen: set[str] = set()
    out = []
    for place, name in enumerate(names):
        out.append(F.col(f"`{name}`").alias(f"{name}_{place}" if name in seen else name))
        seen.add(name)
    return df.select(*out)


def join(left: DataFrame, right: DataFrame, cnf: str, left_name: str = "l", right_name: str = "r", strict: bool = False) -> DataFrame:
    """All pairs that satisfy the whole predicate. Bare names are looked up in the left table first."""
    scope = Scope({left_name: left.schema, right_name: right.schema}, first_wins=True)
    return left.alias(left_name).join(right.alias(right_name), cnf_column(parse_cnf(cnf), scope, strict), "inner")


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of two tables, which a query without a join predicate asks for."""
    return left.crossJoin(right)


def sum_all(df: DataFrame, function: str, distinct: bool = False, precedence: str = "grammar") -> DataFrame:
    """One row with SUM; null over no rows."""
    column, _ = expr_column(parse_expr(function, precedence), Scope.of(df))
    return df.agg((F.sum_distinct(column) if distinct else F.sum(column)).alias("SUM"))


def sum_distinct_rows(df: DataFrame, function: str) -> DataFrame:
    """SUM over the distinct rows of the input."""
    return sum_all(df.distinct(), function)


def group_by_sum(df: DataFrame, keys: list[str], function: str, distinct: bool = False, precedence: str = "grammar") -> DataFrame:
    """SUM, then the keys; no rows over no rows."""
    column, _ = expr_column(parse_expr(function, precedence), Scope.of(df))
    total = F.sum_distinct(column) if distinct else F.sum(column)
    return df.groupBy(*keys).agg(total.alias("SUM")).select("SUM", *keys)


def duplicate_removal(df: DataFrame) -> DataFrame:
    return df.distinct()


def full_order(df: DataFrame) -> list[str]:
    """All columns, ints before doubles before strings."""
    rank = {"int": 0, "double": 1, "string": 2, "time": 3}
    return [f.name for f in sorted(df.schema.fields, key=lambda f: rank[kind_of(f.dataType)])]


def sort(df: DataFrame, order: list[str] | str | None = None) -> DataFrame:
    """Ascending by names, by a text like (a = a) AND (b = b), or by all columns."""
    keys = full_order(df) if order is None else order_of(parse_cnf(order)) if isinstance(order, str) else order
    return df.orderBy(*keys)


def numbered(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows with their place, from 1, in the order in which df gives them out.

    The rows are written with their partition and their number in it; only the partitions are counted up.
    """
    own = F.monotonically_increasing_id()
    folder = f"{new_folder(df.sparkSession, 'numbered')}/rows"
    df.select("*", F.shiftright(own, 33).alias("quarry_part"), own.bitwiseAND(F.lit((1 << 33) - 1)).alias("quarry_row")).write.parquet(folder)
    rows = df.sparkSession.read.parquet(folder)
    parts = rows.groupBy("quarry_part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("quarry_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("quarry_part", F.coalesce(upto, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "quarry_part").select(*df.columns, (F.col("before") + F.col("quarry_row") + 1).alias(name))


def formatted(df: DataFrame, compat: bool = False) -> DataFrame:
    """One text column ``value``: ``name: [v], name: [v]`` of each row. compat: doubles with six significant digits."""
    parts = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if compat and kind_of(field.dataType) == "double":
            column = F.format_string("%.6g", column.cast("double"))
        parts.append(F.concat(F.lit(f"{field.name}: ["), F.coalesce(column.cast("string"), F.lit("")), F.lit("]")))
    return df.select(F.concat_ws(", ", *parts).alias("value"))


def print_rows(df: DataFrame, out: TextIO | None = None, compat: bool = False) -> int:
    """Console sink: a line for each row, in order, a partition in memory at a time. Returns the number of rows."""
    lines = 0
    for row in formatted(df, compat).toLocalIterator():
        print(row["value"], file=out)
        lines += 1
    return lines


def write_out(df: DataFrame, path: str, single_file: bool = False, compat: bool = False) -> None:
    """Text sink. single_file: all rows through one task, for small results."""
    lines = formatted(df, compat)
    (lines.coalesce(1) if single_file else lines).write.mode("overwrite").text(path)
