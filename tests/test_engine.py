import pytest
from pyspark.errors import AnalysisException, ParseException

from lodestone import Engine
from lodestone import operators as op
from lodestone.catalog import TableStats
from lodestone.plans import NotAQuery, parse_expression
from lodestone.plans.guard import shape


@pytest.fixture
def engine(spark, sf_dir):
    return Engine.over(spark, sf_dir)


@pytest.mark.parametrize(("text", "want"), [
    ("a = 1 OR b = 2 AND c = 3", "Or(EqualTo(a, 1), And(EqualTo(b, 2), EqualTo(c, 3)))"),
    ("a + b * c = 0", "EqualTo(Add(a, Multiply(b, c)), 0)"),
    ("(a + b) * c = 0", "EqualTo(Multiply(Add(a, b), c), 0)"),
    ("NOT a = 1 AND b = 2", "And(Not(EqualTo(a, 1)), EqualTo(b, 2))"),
    ("-a + b = 0", "EqualTo(Add(UnaryMinus(a), b), 0)"),
    ("a = 1 AND b = 2 AND c = 3", "And(And(EqualTo(a, 1), EqualTo(b, 2)), EqualTo(c, 3))"),
    ("a <> 1", "Not(EqualTo(a, 1))"), ("a != 1", "Not(EqualTo(a, 1))"), ("a <= 1", "LessThanOrEqual(a, 1)"),
])
def test_precedence(spark, text, want):
    assert shape(parse_expression(spark, text)).replace("unresolvedattribute", "").replace("'", "") == want


@pytest.mark.parametrize("text", ["INSERT INTO nation VALUES (1)", "DROP TABLE nation", "CREATE TABLE x (a INT)", "SET a = b", "EXPLAIN SELECT 1"])
def test_commands_are_refused(engine, text):
    with pytest.raises(NotAQuery):
        engine.sql(text)


@pytest.mark.parametrize("text", [
    "WITH c AS (SELECT 7 AS a) INSERT INTO tt SELECT a FROM c", "FROM (SELECT 9 AS a) INSERT INTO tt SELECT a INSERT INTO uu SELECT a",
    "INSERT OVERWRITE TABLE tt SELECT 1", "CREATE TABLE vv AS SELECT 1 AS a", "WITH c AS (SELECT 1 AS a) FROM c INSERT INTO tt SELECT a",
    "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM tt", "DESCRIBE tt", "CACHE TABLE tt", "MERGE INTO tt USING uu ON tt.a = uu.a WHEN MATCHED THEN DELETE",
])
def test_no_write_passes(spark, engine, text):
    for name in ("tt", "uu"):
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (a INT) USING parquet")
    try:
        with pytest.raises(NotAQuery):
            engine.sql(text)
        assert spark.table("tt").count() == spark.table("uu").count() == 0 and not spark.catalog.tableExists("vv")
    finally:
        for name in ("tt", "uu"):
            spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize(("text", "rows"), [
    ("SELECT /*+ BROADCAST(r) */ n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", 25), ("SELECT n_name FROM nation DISTRIBUTE BY n_regionkey", 25),
    ("WITH c AS (SELECT 7 AS a UNION ALL SELECT 8) SELECT a FROM c", 2), ("SELECT r_name FROM region r WHERE EXISTS (SELECT 1 FROM nation n WHERE n.n_regionkey = r.r_regionkey)", 5),
    ("SELECT n_name, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k FROM nation", 25), ("SELECT * FROM (VALUES (1), (2)) AS t(a) WHERE a IN (SELECT 2)", 1),
    ("SELECT n_regionkey FROM nation INTERSECT SELECT r_regionkey FROM region", 5), ("SELECT id FROM range(4) SORT BY id", 4), ("SELECT explode(array(1, 2)) AS x", 2),
])
def test_queries_of_any_form_pass(engine, text, rows):
    assert engine.sql(text).count() == rows


def test_right_join_differs_from_inner(engine):
    right, inner = (engine.sql(f"SELECT n.n_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) n {kind} JOIN region r ON n.n_regionkey = r.r_regionkey").collect() for kind in ("RIGHT", "INNER"))
    assert len(inner) == 15 and len(right) == 17 and sum(r.n_name is None for r in right) == 2


def test_exact_aggregates(spark):
    from pyspark.sql import functions as F

    from lodestone.functions import exact_avg, exact_sum

    row = spark.sql("SELECT * FROM VALUES (0.1D), (0.2D), (0.3D), (NULL) AS t(x)").agg(exact_sum(F.col("x")).alias("s"), exact_avg(F.col("x")).alias("a")).first()
    assert row.s == 0.6 and row.a == pytest.approx(0.2, abs=1e-15)


@pytest.mark.parametrize("text", ["", "SELECT a FROM t WHERE (a = 1"])
def test_bad_syntax(engine, text):
    with pytest.raises(ParseException):
        engine.sql(text)


@pytest.mark.parametrize("text", ["SELECT FROM WHERE", "SELECT nothing FROM nation", "SELECT * FROM nowhere", "SELECT n_name FROM nation WHERE n_nationkey"])
def test_bad_names_and_types(engine, text):
    with pytest.raises(AnalysisException):
        engine.sql(text).collect()


def test_keywords_in_any_case_and_backslash(engine):
    assert engine.sql("select n_name from nation where n_nationkey = 3 order by n_name desc limit 1").count() == 1
    assert engine.sql(r"SELECT 'a\n' AS x").first().x == "a\\n"


def test_three_valued_logic(engine, spark):
    spark.sql("SELECT * FROM VALUES (1, 2), (NULL, 3), (5, NULL) AS t(a, b)").createOrReplaceTempView("t")
    total = sum(engine.sql(f"SELECT * FROM t WHERE {p}").count() for p in ("a < b", "NOT a < b", "a < b IS NULL"))
    assert total == 3
    row = engine.sql("SELECT COUNT(*) AS n, COUNT(a) AS m, SUM(a) AS s FROM t").first()
    assert (row.n, row.m, row.s) == (3, 2, 6)


def test_invariants(engine):
    inner = engine.sql("SELECT c_custkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
    left = engine.sql("SELECT c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000")
    assert inner.exceptAll(left).count() == 0
    assert engine.sql("SELECT * FROM orders LIMIT 7").count() == 7


def test_catalog(engine, spark):
    assert engine.catalog.get("NATION").fieldNames() == ["n_nationkey", "n_name", "n_regionkey"]
    assert engine.catalog.get("absent") is None
    assert engine.catalog.column("nation", "N_NAME").dataType.simpleString() == "string"
    assert engine.catalog.column("nation", "absent") is None
    assert engine.catalog.stats("nation").size_bytes > 0
    other = Engine(spark)
    other.catalog.register_sample()
    assert other.catalog.stats("products") == TableStats(2000, 192000)
    assert [f.nullable for f in other.catalog.get("customers").fields] == [False, False, True, True]
    assert other.catalog.drop("products") and not other.catalog.drop("products")
    other.catalog.drop("customers")


def test_plan_is_pushed_and_pruned(engine):
    plan = engine.explain("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
    assert "PushedFilters: [IsNotNull(o_orderstatus), EqualTo(o_orderstatus,F)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    assert "TakeOrderedAndProject" in engine.explain("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
    assert "Aggregate" in engine.logical_plan("SELECT COUNT(*) AS n FROM orders")


def test_operator_errors(spark, engine):
    with pytest.raises(ValueError):
        op.limit(op.scan(spark, "nation"), -1)
    with pytest.raises(ValueError):
        op.join(op.scan(spark, "nation"), op.scan(spark, "region"))
    assert op.aggregate(op.scan(spark, "nation"), ["n_regionkey"], []).count() == 5
