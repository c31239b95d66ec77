"""Predicates as Boolean columns, and the key prefix of a sorted table that a predicate fixes."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.scope import Scope, TypeFault
from quarry.lang.ast import Cnf, Condition, Operand


def _side(operand: Operand, scope: Scope) -> tuple[Column, str]:
    return scope.column(str(operand.value)) if operand.kind == "name" else (F.lit(operand.value), operand.kind)


def condition_column(condition: Condition, scope: Scope, strict: bool = False) -> Column:
    """strict: both sides must be of one kind; else Spark's coercion holds. Literals beside timestamps are read as such."""
    (left, a), (right, b) = _side(condition.left, scope), _side(condition.right, scope)
    if {a, b} == {"time", "string"}:
        left, right = (left.cast("timestamp"), right) if a == "string" else (left, right.cast("timestamp"))
    elif strict and a != b:
        raise TypeFault(f"{condition}: {a} against {b}")
    elif "string" in (a, b) and a != b:
        raise TypeFault(f"{condition}: {a} against {b}")
    return {"<": left < right, ">": left > right, "=": left == right}[condition.op]


def cnf_column(cnf: Cnf, scope: Scope, strict: bool = False) -> Column:
    """AND of ORs; the empty predicate is true."""
    clauses = [reduce(or_, (condition_column(c, scope, strict) for c in clause)) for clause in cnf]
    return reduce(and_, clauses) if clauses else F.lit(True)


def index_prefix(cnf: Cnf, order: list[str]) -> list[tuple[str, Operand]]:
    """The longest prefix of a sort order whose attributes single-condition clauses set equal to literals."""
    fixed: dict[str, Operand] = {}
    for clause in cnf:
        if len(clause) == 1 and clause[0].op == "=":
            for name, literal in ((clause[0].left, clause[0].right), (clause[0].right, clause[0].left)):
                if name.kind == "name" and literal.kind != "name":
                    fixed.setdefault(str(name.value).rpartition(".")[2], literal)
    prefix = []
    for attribute in order:
        if attribute not in fixed:
            break
        prefix.append((attribute, fixed[attribute]))
    return prefix


def order_of(cnf: Cnf) -> list[str]:
    """The sort order that a text like (a = a) AND (b = b) names."""
    return [str(clause[0].left.value) for clause in cnf if clause[0].left.kind == "name"]
