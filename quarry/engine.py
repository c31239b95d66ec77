"""The engine: query texts over registered tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.arithmetic import expr_column
from quarry.functions.scope import Scope
from quarry.lang.ast import Query
from quarry.lang.parser import parse_expr, parse_query
from quarry.operators import core
from quarry.plans.planner import Node, Planner, show
from quarry.plans.statistics import Statistics
from quarry.sources.catalog import Relation, Settings, parse_catalog
from quarry.sources.storage import NoTable, StoredTable, read_tbl


class Tables(dict):
    """DataFrames by name; a path is read, and a function called, when its table is first used."""

    def __init__(self, spark: SparkSession):
        super().__init__()
        self.spark = spark

    def __getitem__(self, name: str) -> DataFrame:
        found = super().__getitem__(name)
        if isinstance(found, str):
            found = self[name] = self.spark.read.parquet(found)
        elif callable(found):
            found = self[name] = found()
        return found


def _relation(spark: SparkSession, settings: Settings, relation: Relation) -> DataFrame:
    try:
        return StoredTable.open(spark, f"{settings.tables.rstrip('/')}/{relation.name}").scan()
    except NoTable:
        return read_tbl(spark, f"{settings.texts.rstrip('/')}/{relation.file}", relation.schema)


class Engine:
    def __init__(self, spark: SparkSession, statistics: Statistics | None = None, precedence: str = "grammar", strict: bool = False):
        """precedence: grammar or standard, of arithmetic; strict: WHERE, aliases and equal types are mandatory."""
        self.spark, self.statistics, self.precedence, self.strict = spark, statistics, precedence, strict
        self.tables = Tables(spark)

    @staticmethod
    def of_settings(spark: SparkSession, path: str, **options) -> Engine:
        """An engine over all relations of the catalog that a settings file names.

        A relation is the stored table of its name in the tables folder, or, where there is none, its text.
        """
        whole = lambda file: spark.read.text(file, wholetext=True).first()["value"]
        settings = Settings.parse(whole(path))
        made = Engine(spark, **options)
        for name, relation in parse_catalog(whole(settings.catalog)).items():
            made.tables[name] = partial(_relation, spark, settings, relation)
        return made

    def register(self, name: str, table: DataFrame | str) -> Engine:
        """table: a DataFrame or the path of a Parquet table."""
        self.tables[name] = table
        return self

    def _parsed(self, text: str) -> tuple[Query, Planner]:
        query = parse_query(text, self.precedence, self.strict)
        schemas = {n: self.tables[n].schema for n, _ in query.tables if n in self.tables}
        return query, Planner(schemas, self.statistics, self.strict)

    def plan(self, text: str) -> Node:
        query, planner = self._parsed(text)
        return planner.plan(query)

    def sql(self, text: str) -> DataFrame:
        query, planner = self._parsed(text)
        return planner.run(query, self.tables)

    def explain(self, text: str) -> str:
        query, planner = self._parsed(text)
        return show(planner.plan(query), planner.scope(query))

    def where(self, table: str, cnf: str) -> DataFrame:
        return core.select_pipe(self.tables[table], cnf, self.strict)

    def compute(self, table: str, function: str, name: str = "value") -> DataFrame:
        """The value of an arithmetic text for each row."""
        df = self.tables[table]
        return df.select(expr_column(parse_expr(function, self.precedence), Scope.of(df))[0].alias(name))

    def collect_statistics(self, *names: str) -> Statistics:
        """Row counts and approximate distinct counts of tables, one aggregation each."""
        from pyspark.sql import functions as F

        stats = Statistics()
        for name in names or self.tables:
            df = self.tables[name]
            row = df.agg(F.count("*").alias("rows"), *(F.approx_count_distinct(f"`{c}`").alias(f"d{i}") for i, c in enumerate(df.columns))).first()
            stats.add_relation(name, row["rows"])
            for i, column in enumerate(df.columns):
                stats.add_attribute(name, column, max(1, row[f"d{i}"]))
        self.statistics = stats
        return stats
