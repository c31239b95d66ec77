import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from quarry import queries as relational
from quarry.engine import Engine
from quarry.functions.predicates import index_prefix
from quarry.functions.scope import TypeFault, UnknownName
from quarry.lang.parser import parse_cnf
from quarry.operators import core
from quarry.sources.catalog import Settings, parse_catalog, show_catalog
from quarry.sources.scratch import scratch_dir
from quarry.sources.storage import NoTable, StoredTable, read_tbl
from quarry.streaming import pipes

DATA = "/root/testdata/sf0.001"


def listed(df):
    return sorted(map(repr, df.values.tolist()))


@pytest.mark.parametrize("name", list(relational.queries()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in [*relational.TABLES, "events"]:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    ours, theirs = contract.queries()[name](spark, DATA).toPandas(), con.sql(contract.oracle_sql()[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    if name == "sum_empty":
        assert ours["SUM"].isna().all() and theirs["SUM"].isna().all()
    else:
        assert listed(ours[columns]) == listed(theirs[columns])


def test_arithmetic_covers_every_row(spark):
    rows = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert relational.queries()["arithmetic_all_rows"](spark, DATA).count() == rows


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.fixture
def small(spark):
    rows = [(i, float(i % 5), f"s{i % 3}") for i in range(20)]
    return Engine(spark).register("t", spark.createDataFrame(rows, "a int, b double, c string")).register(
        "u", spark.createDataFrame([(i, i % 4) for i in range(8)], "a int, k int")
    )


def test_filters_against_brute_force(small):
    rows = [tuple(r) for r in small.tables["t"].collect()]
    rng = random.Random(3)
    compare = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "=": lambda x, y: x == y}
    for _ in range(8):
        clauses = [[(rng.choice("ab"), rng.choice("<>="), rng.randint(0, 10)) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
        text = " AND ".join("(" + " OR ".join(f"{n} {op} {v}" for n, op, v in clause) + ")" for clause in clauses)
        wanted = [r for r in rows if all(any(compare[op](r["ab".index(n)], v) for n, op, v in clause) for clause in clauses)]
        assert sorted(tuple(r) for r in small.where("t", text).collect()) == sorted(wanted)


@pytest.mark.parametrize(
    ("text", "fault"),
    [
        ("SELECT x FROM t", UnknownName),
        ("SELECT a FROM t, u WHERE (t.a = u.a)", UnknownName),
        ("SELECT a FROM nowhere", UnknownName),
        ("SELECT c FROM t WHERE (c < 3)", TypeFault),
        ("SELECT SUM (c) FROM t", TypeFault),
        ("SELECT t.a FROM t, t", UnknownName),
    ],
)
def test_faults(small, text, fault):
    with pytest.raises(fault):
        small.sql(text)


def test_strict_types(spark, small):
    strict = Engine(spark, strict=True).register("t", small.tables["t"])
    with pytest.raises(TypeFault):
        strict.sql("SELECT a FROM t AS t WHERE (a < 3.5)")


def test_sum_over_nothing(small):
    assert small.sql("SELECT SUM (a) FROM t WHERE (a > 99)").collect()[0]["SUM"] is None
    assert small.sql("SELECT SUM (a), c FROM t WHERE (a > 99) GROUP BY c").count() == 0


def test_two_predicates_on_one_pair_make_one_join(small):
    text = "SELECT t.c FROM t AS t, u AS u WHERE (t.a = u.a) AND (t.a = u.k)"
    plan = small.explain(text)
    assert plan.count("JOIN operation") == 1 and "(t.a = u.a) AND (t.a = u.k)" in plan
    assert small.sql(text).count() == 4


def test_explain_lists_inputs_first(small):
    plan = small.explain("SELECT SUM (t.b), t.c FROM t AS t WHERE (t.a > 3) GROUP BY t.c")
    assert [line for line in plan.splitlines() if line.endswith("operation")] == ["SELECTF operation", "SELECTP operation", "GROUP_BY operation"]
    assert "CNF: (t.a > 3)" in plan and "Grouping: t.c" in plan


def test_filters_and_columns_reach_the_scan(spark, capsys):
    relational.engine(spark, DATA).sql("SELECT l_orderkey FROM lineitem AS l WHERE (l_discount < 0.04 OR l_linestatus = 'F')").explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [Or(" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double,l_linestatus:string>" in plan


def test_sorted_table(spark, tmp_path, small):
    table = StoredTable.create(spark, f"file://{tmp_path}/s", small.tables["t"].schema, ["b", "a"])
    table.add(small.tables["t"].where("a % 2 = 1"))
    table.add(small.tables["t"].where("a % 2 = 0"))
    found = [(r["b"], r["a"]) for r in StoredTable.open(spark, table.path).scan().collect()]
    assert found == sorted(found) and len(found) == 20
    assert table.key_prefix("(b = 2.0) AND (a > 3)")[0][0] == "b"
    assert [r["a"] for r in table.scan_where("(b = 2.0)").collect()] == [2, 7, 12, 17]


def test_adds_gather_until_the_next_read(spark, tmp_path, small):
    rows = small.tables["t"]
    table = StoredTable.create(spark, f"file://{tmp_path}/s", rows.schema, ["a"])
    for k in range(4):
        table.add(rows.where(f"a % 4 = {k}"))
    assert table.version == 0 and len(list(tmp_path.glob("s/v*"))) == 1
    assert [r["a"] for r in StoredTable.open(spark, table.path).scan().collect()] == list(range(20))
    again = StoredTable.open(spark, table.path)
    assert again.version == 1
    again.add(rows.where("a < 3"))
    assert again.scan().count() == 23 and again.version == 2
    assert again.scan().count() == 23 and again.version == 2  # nothing added, nothing merged
    assert sorted(p.name for p in tmp_path.glob("s/v*")) == ["v1", "v2"]


def test_a_lost_merge_leaves_the_table(spark, tmp_path, small, monkeypatch):
    rows = small.tables["t"]
    table = StoredTable.create(spark, f"file://{tmp_path}/s", rows.schema, ["a"])
    table.add(rows)
    assert table.scan().count() == 20
    table.add(rows)

    def lost(self):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(StoredTable, "_save", lost)
        with pytest.raises(RuntimeError):
            table.scan()
    (tmp_path / "s" / "meta-9").mkdir()  # metadata that never was complete
    assert table.version == 1 and StoredTable.open(spark, table.path).version == 1
    assert StoredTable.open(spark, table.path).scan().count() == 40
    assert table.scan().count() == 40
    with pytest.raises(NoTable):
        StoredTable.open(spark, f"file://{tmp_path}/nowhere")


def test_a_new_table_replaces_the_old(spark, tmp_path, small):
    rows = small.tables["t"]
    StoredTable.create(spark, f"file://{tmp_path}/s", rows.schema, ["a"]).add(rows)
    StoredTable.create(spark, f"file://{tmp_path}/s", rows.schema).add(rows.limit(2))
    found = StoredTable.open(spark, f"file://{tmp_path}/s")
    assert not found.order and found.scan().count() == 2


def test_numbers_follow_the_real_order(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("a"))
    shuffled = core.numbered(rows.repartition(5))
    ordered = core.numbered(core.sort(rows.repartition(5), ["a"]))
    assert [r["a"] for r in ordered.orderBy("place").collect()] == sorted(r["a"] for r in rows.collect())
    assert [r["a"] for r in shuffled.orderBy("place").collect()] != sorted(r["a"] for r in rows.collect())
    assert sorted(r["place"] for r in ordered.collect()) == list(range(1, 1001))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        scratch_dir(Cluster())


def test_key_prefix_stops_at_the_first_gap():
    cnf = parse_cnf("(5 = a) AND (c = 2) AND (b = 1 OR b = 2)")
    assert [name for name, _ in index_prefix(cnf, ["a", "b", "c"])] == ["a"]


def test_catalog_and_texts(spark, tmp_path):
    text = "BEGIN\nt\nt.tbl\na Int\nb Double\nc String\nEND\n"
    catalog = parse_catalog(text)
    assert parse_catalog(show_catalog(catalog)) == catalog
    (tmp_path / "t.tbl").write_text("1|2.5|x|\n||\"q|\n")
    rows = read_tbl(spark, f"file://{tmp_path}/t.tbl", catalog["t"].schema).collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, "x"), (0, 0.0, '"q')]
    assert Settings.parse("cat\nbin/\ntbl/\n") == Settings("cat", "bin/", "tbl/")
    with pytest.raises(ValueError):
        parse_catalog("BEGIN\nt\nt.tbl\na Text\nEND")


def test_compat_format(spark):
    df = spark.createDataFrame([(1, 1234567.891)], "a int, b double")
    assert core.formatted(df, compat=True).first()["value"] == "a: [1], b: [1.23457e+06]"


def test_stream(spark, tmp_path, small):
    small.tables["t"].write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(small.tables["t"].schema).parquet(f"{tmp_path}/in")
    pipes.drain(pipes.filtered(stream, "(a < 5)", ["c", "a"]), "rows", f"{tmp_path}/c1").awaitTermination()
    assert spark.table("rows").count() == 5
    pipes.drain(pipes.running_sums(stream, ["c"], "a"), "sums", f"{tmp_path}/c2", "complete").awaitTermination()
    assert spark.table("sums").selectExpr("sum(SUM)").first()[0] == 190
