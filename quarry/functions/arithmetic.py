"""Arithmetic as numeric columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.scope import Scope, TypeFault
from quarry.lang.ast import Expr, Negative, Operand


def expr_column(expr: Expr, scope: Scope) -> tuple[Column, str]:
    """Column and kind. Ints are longs; a double on either side makes both doubles; ints divide towards zero."""
    if isinstance(expr, Operand):
        column, kind = scope.column(str(expr.value)) if expr.kind == "name" else (F.lit(expr.value), expr.kind)
        if kind not in ("int", "double"):
            raise TypeFault(f"{expr.value} is not a number")
        return column.cast("bigint" if kind == "int" else "double"), kind
    if isinstance(expr, Negative):
        column, kind = expr_column(expr.inner, scope)
        return -column, kind
    (left, a), (right, b) = expr_column(expr.left, scope), expr_column(expr.right, scope)
    kind = "int" if a == b == "int" else "double"
    if kind == "double":
        left, right = left.cast("double"), right.cast("double")
    if expr.op == "/":
        return (F.call_function("div", left, right) if kind == "int" else left / right), kind
    return {"+": left + right, "-": left - right, "*": left * right}[expr.op], kind
