"""Names of a query resolved to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnknownName(ValueError):
    """A column that no table in scope has, or that several have."""


class TypeFault(ValueError):
    """Operands of kinds that do not go together."""


def kind_of(data_type: T.DataType) -> str:
    """int, double, string, or time for the types beyond the three of the languages."""
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.DoubleType | T.FloatType | T.DecimalType):
        return "double"
    if isinstance(data_type, T.TimestampType | T.TimestampNTZType | T.DateType):
        return "time"
    return "string"


class Scope:
    """Tables by alias, in order; a table without alias is under ''."""

    def __init__(self, tables: dict[str, T.StructType], first_wins: bool = False):
        self.tables, self.first_wins = tables, first_wins

    @staticmethod
    def of(df: DataFrame) -> Scope:
        return Scope({"": df.schema})

    def find(self, name: str) -> tuple[str, str, T.DataType]:
        """Alias, column and type of a name."""
        alias, _, column = name.rpartition(".")
        places = [a for a, schema in self.tables.items() if (not alias or a == alias) and column in schema.names]
        if not places and name in self.tables.get("", T.StructType()).names:
            places, column = [""], name
        if not places:
            raise UnknownName(f"no column {name} in {', '.join(a or 'the table' for a in self.tables)}")
        if len(places) > 1 and not self.first_wins:
            raise UnknownName(f"{name} is in {' and '.join(places)}")
        return places[0], column, self.tables[places[0]][column].dataType

    def column(self, name: str) -> tuple[Column, str]:
        alias, column, data_type = self.find(name)
        return F.col(f"`{alias}`.`{column}`" if alias else f"`{column}`"), kind_of(data_type)
