"""Queries over the test tables, each with the same result in DuckDB SQL.

Sums of doubles depend on the order of addition, so both sides round them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from io import StringIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.engine import Engine
from quarry.functions.predicates import index_prefix
from quarry.lang.parser import parse_cnf
from quarry.operators import core
from quarry.plans.statistics import Statistics
from quarry.sources.catalog import parse_catalog, show_catalog
from quarry.sources.scratch import new_folder
from quarry.sources.storage import StoredTable, compose, read_tbl, write_tbl
from quarry.streaming import pipes

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    made = Engine(spark, **options)
    for name in TABLES:
        made.register(name, f"{sf_dir}/{name}.parquet")
    return made


def _rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.withColumn("SUM", F.round("SUM", digits)) if dict(df.dtypes)["SUM"] == "double" else df


#: name: (text of the language, DuckDB SQL)
SQL: dict[str, tuple[str, str]] = {
    "scan_filter": (
        "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem AS l WHERE (l_extendedprice < 1000.0)",
        "SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_extendedprice < 1000.0",
    ),
    "cmp_lt_int": ("SELECT p_partkey, p_size FROM part AS p WHERE (p_size < 5)", "SELECT p_partkey, p_size FROM part WHERE p_size < 5"),
    "cmp_gt_int": ("SELECT p_partkey, p_size FROM part AS p WHERE (p_size > 45)", "SELECT p_partkey, p_size FROM part WHERE p_size > 45"),
    "cmp_eq_int": ("SELECT p_partkey, p_size FROM part AS p WHERE (p_size = 7)", "SELECT p_partkey, p_size FROM part WHERE p_size = 7"),
    "cmp_lt_double": ("SELECT s_suppkey, s_acctbal FROM supplier AS s WHERE (s_acctbal < 500.0)", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 500.0"),
    "cmp_gt_double": ("SELECT s_suppkey, s_acctbal FROM supplier AS s WHERE (s_acctbal > 9000.0)", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 9000.0"),
    "cmp_eq_double": ("SELECT l_orderkey, l_quantity FROM lineitem AS l WHERE (l_quantity = 17.0)", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity = 17.0"),
    "cmp_lt_string": ("SELECT c_custkey, c_mktsegment FROM customer AS c WHERE (c_mktsegment < 'BUILDING')", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment < 'BUILDING'"),
    "cmp_gt_string": ("SELECT o_orderkey, o_orderpriority FROM orders AS o WHERE (o_orderpriority > '4')", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '4'"),
    "cmp_eq_string": ("SELECT r_regionkey, r_name FROM region AS r WHERE (r_name = 'EUROPE')", "SELECT r_regionkey, r_name FROM region WHERE r_name = 'EUROPE'"),
    "cmp_signed": ("SELECT s_suppkey, s_acctbal FROM supplier AS s WHERE (s_acctbal < -100.25)", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < -100.25"),
    "escaped_string": (
        r"SELECT c_custkey, c_name FROM customer AS c WHERE (c_name < 'Customer#\'5')",
        r"SELECT c_custkey, c_name FROM customer WHERE c_name < 'Customer#\''5'",
    ),
    "literal_on_left": ("SELECT p_partkey, p_size FROM part AS p WHERE (30 < p_size)", "SELECT p_partkey, p_size FROM part WHERE 30 < p_size"),
    "cnf_or": (
        "SELECT l_orderkey, l_discount, l_linestatus FROM lineitem AS l WHERE (l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')",
        "SELECT l_orderkey, l_discount, l_linestatus FROM lineitem WHERE l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'F')",
    ),
    "cnf_or_same_attribute": (
        "SELECT p_partkey, p_size FROM part AS p WHERE (p_size =3 OR p_size=6 OR p_size =19)",
        "SELECT p_partkey, p_size FROM part WHERE p_size IN (3, 6, 19)",
    ),
    "tautology": ("SELECT s_suppkey, s_name FROM supplier AS s WHERE (s_suppkey = s_suppkey)", "SELECT s_suppkey, s_name FROM supplier"),
    "attr_vs_attr": ("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem AS l WHERE (l_partkey < l_suppkey)", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey < l_suppkey"),
    "date_range": (
        "SELECT o_orderkey, o_custkey FROM orders AS o WHERE (o_orderdate > '1995-03-10') AND (o_orderdate < '1995-04-01')",
        "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1995-03-10' AND o_orderdate < TIMESTAMP '1995-04-01'",
    ),
    "project_reorder": (
        "SELECT p_retailprice, p_partkey, p_name FROM part AS p WHERE (p_retailprice > 931.01) AND (p_retailprice < 935.3)",
        "SELECT p_retailprice, p_partkey, p_name FROM part WHERE p_retailprice > 931.01 AND p_retailprice < 935.3",
    ),
    "sum_expr": (
        "SELECT SUM (s_acctbal + (s_acctbal * 1.05)) FROM supplier AS s WHERE (s_suppkey = s_suppkey)",
        'SELECT round(sum(s_acctbal + (s_acctbal * CAST(1.05 AS DOUBLE))), 2) AS "SUM" FROM supplier',
    ),
    "sum_int": ("SELECT SUM (p_size) FROM part AS p", 'SELECT CAST(sum(p_size) AS BIGINT) AS "SUM" FROM part'),
    "sum_int_div": ("SELECT SUM (p_size / 7) FROM part AS p", 'SELECT CAST(sum(p_size // 7) AS BIGINT) AS "SUM" FROM part'),
    "sum_unary_minus": ("SELECT SUM (-p_size + 3) FROM part AS p", 'SELECT CAST(sum(-(p_size + 3)) AS BIGINT) AS "SUM" FROM part'),
    "sum_double_div": (
        "SELECT SUM (l_extendedprice / l_quantity) FROM lineitem AS l",
        'SELECT round(sum(l_extendedprice / l_quantity), 2) AS "SUM" FROM lineitem',
    ),
    "sum_unary_minus_double": (
        "SELECT SUM (-s_acctbal + 0.5) FROM supplier AS s",
        'SELECT round(sum(-(s_acctbal + 0.5)), 2) AS "SUM" FROM supplier',
    ),
    "sum_mixed_types": (
        "SELECT SUM ((l_quantity - l_linenumber) / (l_linenumber + 0.5)) FROM lineitem AS l",
        'SELECT round(sum((l_quantity - l_linenumber) / (l_linenumber + 0.5::DOUBLE)), 2) AS "SUM" FROM lineitem',
    ),
    "sum_right_assoc": ("SELECT SUM (p_size - 3 - p_partkey) FROM part AS p", 'SELECT CAST(sum(p_size - (3 - p_partkey)) AS BIGINT) AS "SUM" FROM part'),
    "sum_no_precedence": ("SELECT SUM (p_size * p_partkey + 2) FROM part AS p", 'SELECT CAST(sum(p_size * (p_partkey + 2)) AS BIGINT) AS "SUM" FROM part'),
    "sum_empty": ("SELECT SUM (p_size) FROM part AS p WHERE (p_size > 1000)", 'SELECT CAST(sum(p_size) AS BIGINT) AS "SUM" FROM part WHERE p_size > 1000'),
    "group_sum": (
        "SELECT SUM (l_extendedprice * (1.0 - l_discount)), l_returnflag FROM lineitem AS l GROUP BY l_returnflag",
        'SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS "SUM", l_returnflag FROM lineitem GROUP BY l_returnflag',
    ),
    "group_sum_multi": (
        "SELECT SUM (l_quantity), l_returnflag, l_linestatus FROM lineitem AS l WHERE (l_shipdate < '1998-09-02') GROUP BY l_returnflag, l_linestatus",
        "SELECT round(sum(l_quantity), 2) AS \"SUM\", l_returnflag, l_linestatus FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY ALL",
    ),
    "distinct_proj": ("SELECT DISTINCT l_suppkey FROM lineitem AS l WHERE (l_extendedprice < 2000.11)", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_extendedprice < 2000.11"),
    "sum_distinct": ("SELECT SUM DISTINCT (l_quantity) FROM lineitem AS l", 'SELECT round(sum(DISTINCT l_quantity), 2) AS "SUM" FROM lineitem'),
    "join_equi_sum": (
        "SELECT SUM (l_extendedprice) FROM supplier AS s, lineitem AS l WHERE (s_suppkey = l_suppkey)",
        'SELECT round(sum(l_extendedprice), 2) AS "SUM" FROM supplier JOIN lineitem ON s_suppkey = l_suppkey',
    ),
    "join_group": (
        "SELECT SUM (l_extendedprice), s_nationkey FROM supplier AS s, lineitem AS l WHERE (s_suppkey = l_suppkey) GROUP BY s_nationkey",
        'SELECT round(sum(l_extendedprice), 2) AS "SUM", s_nationkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY s_nationkey',
    ),
    "join_3way": (
        "SELECT SUM (l_extendedprice) FROM part AS p, lineitem AS l, supplier AS s WHERE (p_partkey = l_partkey) AND (l_suppkey = s_suppkey) AND (s_acctbal > 2500.0)",
        'SELECT round(sum(l_extendedprice), 2) AS "SUM" FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal > 2500.0',
    ),
    "join_5way": (
        "SELECT SUM (l_quantity), n.n_name FROM region AS r, nation AS n, customer AS c, orders AS o, lineitem AS l "
        "WHERE (r.r_regionkey = n.n_regionkey) AND (n.n_nationkey = c.c_nationkey) AND (c.c_custkey = o.o_custkey) "
        "AND (o.o_orderkey = l.l_orderkey) AND (r.r_name = 'AMERICA') GROUP BY n.n_name",
        'SELECT round(sum(l_quantity), 2) AS "SUM", n_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey '
        "JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE r_name = 'AMERICA' GROUP BY n_name",
    ),
    "join_multi_key": (
        "SELECT SUM (l1.l_quantity), l2.l_returnflag FROM lineitem AS l1, lineitem AS l2 WHERE (l1.l_partkey = l2.l_partkey) AND (l1.l_suppkey = l2.l_suppkey) GROUP BY l2.l_returnflag",
        'SELECT round(sum(l1.l_quantity), 2) AS "SUM", l2.l_returnflag FROM lineitem l1 JOIN lineitem l2 ON l1.l_partkey = l2.l_partkey AND l1.l_suppkey = l2.l_suppkey GROUP BY ALL',
    ),
    "join_theta": (
        "SELECT n.n_name, r.r_name FROM nation AS n, region AS r WHERE (n.n_regionkey < r.r_regionkey)",
        "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey",
    ),
    "join_cross": ("SELECT n_name, r_name FROM nation AS n, region AS r", "SELECT n_name, r_name FROM nation, region"),
    "self_join_alias": (
        "SELECT n1.n_name, n2.n_name FROM nation AS n1, nation AS n2 WHERE (n1.n_regionkey = n2.n_regionkey)",
        "SELECT n1.n_name AS n1_n_name, n2.n_name AS n2_n_name FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey",
    ),
    "join_or_residual": (
        "SELECT s_name, n_name FROM supplier AS s, nation AS n WHERE (s_nationkey = n_nationkey) AND (s_acctbal > 5000.0 OR n_regionkey = 2)",
        "SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000.0 OR n_regionkey = 2",
    ),
    "constant_filter": ("SELECT r_name FROM region AS r WHERE (1 = 1) AND (2 > 1)", "SELECT r_name FROM region"),
    "group_without_sum": ("SELECT s_nationkey FROM supplier AS s WHERE (s_acctbal > 0.0) GROUP BY s_nationkey", "SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 0"),
}


def _sql(text: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).sql(text)
        return _rounded(df) if "SUM" in df.columns else df

    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filter_pipe_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = core.select_file(spark, f"{sf_dir}/orders.parquet", "(o_totalprice > 1000.0)")
    return core.project(core.select_pipe(first, "(o_orderstatus = 'F')"), ["o_orderkey", "o_totalprice"])


def project_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.project(_table(spark, sf_dir, "nation"), ["n_name", 0, "n_name"])


def duplicate_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.duplicate_removal(core.project(_table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"]))


def sum_distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(core.sum_distinct_rows(core.project(_table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_quantity"]), "l_quantity"))


def operator_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = core.join(_table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "lineitem"), "(s_suppkey = l_suppkey) AND (l_quantity > 45.0 OR s_acctbal < 0.0)")
    return _rounded(core.group_by_sum(pairs, ["s_nationkey"], "l_extendedprice"))


def standard_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.sum_all(_table(spark, sf_dir, "part"), "p_size * p_partkey + 2 - p_size - 1", precedence="standard")


def arithmetic_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = Engine(spark).register("t", _table(spark, sf_dir, "lineitem"))
    return made.compute("t", "(l_extendedprice * (1.0 - l_discount)) + l_tax").select(F.round("value", 4).alias("value"))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with the place that they really come at."""
    return core.numbered(rows).withColumn("place", F.col("place").cast("int"))


def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return _placed(core.sort(rows, "(s_nationkey = s_nationkey) AND (s_suppkey = s_suppkey)"))


def sort_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(core.sort(_table(spark, sf_dir, "customer").select("c_mktsegment", "c_acctbal", "c_custkey")))


def sort_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return _placed(core.sort(rows, ["l_extendedprice", "l_quantity", "l_orderkey", "l_partkey", "l_suppkey"]))


def sorted_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    table = StoredTable.create(spark, new_folder(spark, "sorted"), rows.schema, ["o_custkey", "o_orderkey"])
    for k in range(3):
        table.add(rows.where(f"o_orderkey % 3 = {k}"))
    return _placed(StoredTable.open(spark, table.path).scan())


def heap_load_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = _table(spark, sf_dir, "customer"), new_folder(spark, "tbl")
    write_tbl(rows, texts)
    table = StoredTable.create(spark, new_folder(spark, "heap"), rows.schema)
    table.load(texts)
    return StoredTable.open(spark, table.path).scan_where("(c_acctbal > 1000.0)")


def sorted_load_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = _table(spark, sf_dir, "part"), new_folder(spark, "tbl")
    write_tbl(rows, texts)
    table = StoredTable.create(spark, new_folder(spark, "sorted"), rows.schema, ["p_retailprice", "p_partkey"])
    table.load(texts)
    return _placed(StoredTable.open(spark, table.path).scan())


CATALOG = """BEGIN
nation
nation.tbl
n_nationkey Int
n_name String
n_regionkey Int
END

BEGIN
supplier
supplier.tbl
s_suppkey Int
s_name String
s_nationkey Int
s_acctbal Double
END
"""


def settings_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One relation of the catalog is stored, the other is text."""
    folder = new_folder(spark, "settings")
    nation = _table(spark, sf_dir, "nation")
    StoredTable.create(spark, f"{folder}/tables/nation", nation.schema).add(nation)
    write_tbl(_table(spark, sf_dir, "supplier").withColumn("s_suppkey", F.col("s_suppkey").cast("int")), f"{folder}/texts/supplier.tbl")
    for name, text in (("catalog", CATALOG), ("settings", f"{folder}/catalog\n{folder}/tables/\n{folder}/texts/\n")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/{name}")
    made = Engine.of_settings(spark, f"{folder}/settings")
    return _rounded(made.sql("SELECT SUM (s.s_acctbal), n.n_name FROM supplier AS s, nation AS n WHERE (s.s_nationkey = n.n_nationkey) GROUP BY n.n_name"))


def console_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the console sink prints, with the order of its lines."""
    out = StringIO()
    core.print_rows(core.sort(_table(spark, sf_dir, "nation"), ["n_nationkey"]), out)
    return spark.createDataFrame(list(enumerate(out.getvalue().splitlines(), 1)), "place int, value string")


def catalog_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parse_catalog(show_catalog(parse_catalog(CATALOG)))
    rows = [(r.name, r.file, f.name, f.dataType.simpleString()) for r in found.values() for f in r.schema.fields]
    return spark.createDataFrame(rows, "relation string, file string, attribute string, type string")


def key_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sorted table's keys those that a predicate binds, up to the first that it does not."""
    rows = []
    for cnf in ("(a = 3) AND (c = 1.5) AND (b = 'x')", "(4 = a) AND (b > 'x') AND (c = 1.0)", "(b = 'x')", "(a = 3 OR a = 4)"):
        rows += [(cnf, place, name, str(operand)) for place, (name, operand) in enumerate(index_prefix(parse_cnf(cnf), ["a", "b", "c"]), 1)]
    return spark.createDataFrame(rows, "cnf string, place int, name string, bound string")


def plan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine(spark, sf_dir)
    text = made.explain("SELECT SUM (s.s_acctbal), s.s_nationkey FROM supplier AS s WHERE (s.s_acctbal > 10.5) GROUP BY s.s_nationkey")
    kinds = [line for line in text.splitlines() if line.endswith("operation") or line.startswith("CNF")]
    return spark.createDataFrame(list(enumerate(kinds, 1)), "place int, line string")


def stream_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums over a filtered stream, taken when all that was there has been read."""
    schema = _table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    name = f"sums_{uuid.uuid4().hex}"
    sums = pipes.running_sums(pipes.filtered(stream, "(value > 10.0) AND (event_type < 'purchase')"), ["event_type"], "user_id + 1")
    pipes.drain(sums, name, f"{new_folder(spark, 'stream')}/checkpoint", "complete").awaitTermination()
    return spark.table(name)


def sorted_file_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    table = StoredTable.create(spark, new_folder(spark, "sorted"), rows.schema, ["l_orderkey", "l_partkey"])
    table.add(rows.where("l_partkey % 2 = 0"))
    table.add(rows.where("l_partkey % 2 = 1"))
    return StoredTable.open(spark, table.path).scan_where("(l_orderkey = 100) AND (l_quantity > 5.0)")


def heap_append_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation")
    table = StoredTable.create(spark, new_folder(spark, "heap"), rows.schema)
    table.add(rows.where("n_nationkey < 10"))
    table.add(rows.where("n_nationkey >= 10"))
    return StoredTable.open(spark, table.path).scan()


def tbl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = _table(spark, sf_dir, "supplier"), new_folder(spark, "tbl")
    write_tbl(rows, path)
    return read_tbl(spark, path, rows.schema)


def compose_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    return compose(spark, ["1|2.5|x|", "||y|"], schema)


def write_out_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "out")
    core.write_out(_table(spark, sf_dir, "nation"), path)
    return spark.read.text(path)


def _stats(*relations: tuple[str, int, dict[str, int]]) -> Statistics:
    made = Statistics()
    for name, rows, attributes in relations:
        made.add_relation(name, rows)
        for attribute, distinct in attributes.items():
            made.add_attribute(name, attribute, distinct)
    return made


#: Rows and distinct values of a made-up chain of shops.
SHOPS = [
    ("town", 40, {"to_id": 40, "to_name": 38}),
    ("shop", 1200, {"sh_id": 1200, "sh_town": 40}),
    ("sale", 90000, {"sa_shop": 1150, "sa_day": 365, "sa_kind": 6}),
]


def estimates() -> dict[str, float]:
    """Estimates over the statistics of a made-up chain of shops."""
    found = {}
    s = _stats(*SHOPS)
    found["join"] = s.apply("(sh_id = sa_shop)", ["shop", "sale"])
    again = Statistics.read(s.write())
    found["range_after_join"] = again.estimate("(sa_day > 100)", ["shop", "sale"])
    found["chain"] = s.estimate("(to_id = sh_town) AND (to_name = 'Brunn')", ["town", "shop", "sale"])
    found["cuts_through_a_join"] = s.estimate("(to_id = sh_town)", ["town", "shop"])
    s = _stats(*SHOPS)
    found["or_of_one"] = s.estimate("(sa_kind = 1 OR sa_kind = 4)", ["sale"])
    found["or_of_two"] = s.estimate("(sa_kind = 2) AND (sa_day < 50 OR sa_shop = 7)", ["sale"])
    found["unknown_attribute"] = s.estimate("(sa_price > 3.5) AND (sa_shop = sh_id)", ["shop", "sale"])
    return found


def estimate_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, round(v, 1)) for k, v in estimates().items()], "name string, rows double")


def plan_join_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = engine(spark, sf_dir)
    made.collect_statistics("lineitem", "orders", "customer", "nation")
    text = (
        "SELECT n.n_name FROM lineitem AS l, orders AS o, customer AS c, nation AS n WHERE (l.l_orderkey = o.o_orderkey) "
        "AND (o.o_custkey = c.c_custkey) AND (c.c_nationkey = n.n_nationkey)"
    )
    joins, todo = [], [made.plan(text)]
    while todo:
        node = todo.pop()
        todo += node.inputs
        joins += [(node.pipe, str(node.cnf[0][0]))] if node.kind == "JOIN" else []
    return spark.createDataFrame([(place, text) for place, (_, text) in enumerate(sorted(joins), 1)], "place long, predicate string")


OWN: dict[str, tuple[Query, str]] = {
    "filter_pipe_chain": (filter_pipe_chain, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F'"),
    "project_repeat": (project_repeat, "SELECT n_name, n_nationkey, n_name AS n_name_2 FROM nation"),
    "duplicate_removal": (duplicate_removal, "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem"),
    "sum_distinct_rows": (sum_distinct_rows, 'SELECT round(sum(l_quantity), 2) AS "SUM" FROM (SELECT DISTINCT l_suppkey, l_quantity FROM lineitem)'),
    "operator_join": (
        operator_join,
        'SELECT round(sum(l_extendedprice), 2) AS "SUM", s_nationkey FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_quantity > 45 OR s_acctbal < 0 GROUP BY s_nationkey',
    ),
    "standard_precedence": (standard_precedence, 'SELECT CAST(sum(p_size * p_partkey + 2 - p_size - 1) AS BIGINT) AS "SUM" FROM part'),
    "arithmetic_all_rows": (arithmetic_all_rows, "SELECT round((l_extendedprice * (1 - l_discount)) + l_tax, 4) AS value FROM lineitem"),
    "sort_keys": (sort_keys, "SELECT s_suppkey, s_nationkey, CAST(row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS INTEGER) AS place FROM supplier"),
    "sort_full": (
        sort_full,
        "SELECT c_mktsegment, c_acctbal, c_custkey, CAST(row_number() OVER (ORDER BY c_custkey, c_acctbal, c_mktsegment) AS INTEGER) AS place FROM customer",
    ),
    "sort_lineitem": (
        sort_lineitem,
        "SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, CAST(row_number() OVER "
        "(ORDER BY l_extendedprice, l_quantity, l_orderkey, l_partkey, l_suppkey) AS INTEGER) AS place FROM lineitem",
    ),
    "sorted_file_scan": (
        sorted_file_scan,
        "SELECT o_orderkey, o_custkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_custkey, o_orderkey) AS INTEGER) AS place FROM orders",
    ),
    "heap_load_text": (heap_load_text, "SELECT * FROM customer WHERE c_acctbal > 1000"),
    "sorted_load_text": (sorted_load_text, "SELECT *, CAST(row_number() OVER (ORDER BY p_retailprice, p_partkey) AS INTEGER) AS place FROM part"),
    "settings_engine": (
        settings_engine,
        'SELECT round(sum(s_acctbal), 2) AS "SUM", n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name',
    ),
    "console_rows": (
        console_rows,
        "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS place, "
        "'n_nationkey: [' || n_nationkey || '], n_name: [' || n_name || '], n_regionkey: [' || n_regionkey || ']' AS value FROM nation",
    ),
    "catalog_text": (
        catalog_text,
        "SELECT * FROM (VALUES ('nation', 'nation.tbl', 'n_nationkey', 'int'), ('nation', 'nation.tbl', 'n_name', 'string'), ('nation', 'nation.tbl', 'n_regionkey', 'int'), "
        "('supplier', 'supplier.tbl', 's_suppkey', 'int'), ('supplier', 'supplier.tbl', 's_name', 'string'), ('supplier', 'supplier.tbl', 's_nationkey', 'int'), "
        "('supplier', 'supplier.tbl', 's_acctbal', 'double')) t(relation, file, attribute, type)",
    ),
    "key_prefix": (
        key_prefix,
        "SELECT cnf, CAST(place AS INTEGER) AS place, name, bound FROM (VALUES ('(a = 3) AND (c = 1.5) AND (b = ''x'')', 1, 'a', '3'), "
        "('(a = 3) AND (c = 1.5) AND (b = ''x'')', 2, 'b', '''x'''), ('(a = 3) AND (c = 1.5) AND (b = ''x'')', 3, 'c', '1.5'), "
        "('(4 = a) AND (b > ''x'') AND (c = 1.0)', 1, 'a', '4')) t(cnf, place, name, bound)",
    ),
    "plan_text": (
        plan_text,
        "SELECT CAST(place AS INTEGER) AS place, line FROM (VALUES (1, 'SELECTF operation'), (2, 'SELECTP operation'), (3, 'CNF: (s.s_acctbal > 10.5)'), (4, 'GROUP_BY operation')) t(place, line)",
    ),
    "stream_sums": (
        stream_sums,
        "SELECT CAST(sum(user_id + 1) AS BIGINT) AS \"SUM\", event_type FROM events WHERE value > 10 AND event_type < 'purchase' GROUP BY event_type",
    ),
    "sorted_file_lookup": (sorted_file_lookup, "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 100 AND l_quantity > 5"),
    "heap_append_scan": (heap_append_scan, "SELECT * FROM nation"),
    "tbl_roundtrip": (tbl_roundtrip, "SELECT * FROM supplier"),
    "compose_record": (compose_record, "SELECT CAST(1 AS INTEGER) AS a, CAST(2.5 AS DOUBLE) AS b, 'x' AS c UNION ALL SELECT CAST(0 AS INTEGER), CAST(0 AS DOUBLE), 'y'"),
    "write_out_text": (
        write_out_text,
        "SELECT 'n_nationkey: [' || n_nationkey || '], n_name: [' || n_name || '], n_regionkey: [' || n_regionkey || ']' AS value FROM nation",
    ),
    "estimate_golden": (
        estimate_golden,
        "SELECT name, round(rows, 1) AS rows FROM (VALUES ('join', 1200::DOUBLE * 90000 / 1200), ('range_after_join', 90000::DOUBLE / 3), "
        "('chain', 90000::DOUBLE * 40 / 40 / 38), ('cuts_through_a_join', 0::DOUBLE), ('or_of_one', 90000::DOUBLE * 2 / 6), "
        "('or_of_two', 90000::DOUBLE / 6 * (1 - (1 - 1::DOUBLE / 3) * (1 - 1::DOUBLE / 1150))), ('unknown_attribute', 90000::DOUBLE / 3)) t(name, rows)",
    ),
    "plan_join_order": (
        plan_join_order,
        "SELECT * FROM (VALUES (1::BIGINT, 'c.c_nationkey = n.n_nationkey'), (2, 'o.o_custkey = c.c_custkey'), (3, 'l.l_orderkey = o.o_orderkey')) t(place, predicate)",
    ),
}


def queries() -> dict[str, Query]:
    return {name: _sql(text) for name, (text, _) in SQL.items()} | {name: query for name, (query, _) in OWN.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SQL.items()} | {name: sql for name, (_, sql) in OWN.items()}
