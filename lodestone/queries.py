"""Named queries over the test tables, with their twins for the checking database.

Sums and means of fractional doubles go through decimals, so that the value doesn't depend on the partitioning.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import operators as op
from lodestone.engine import Engine
from lodestone.functions import exact_sum
from lodestone.sources.parquet import TABLES

SQL = {
    "scan_star": "SELECT * FROM orders",
    "project_columns": "SELECT c.c_name, c.c_mktsegment FROM customer c WHERE c.c_mktsegment = 'BUILDING'",
    "project_alias": "SELECT p_retailprice AS p, p_name n FROM part",
    "project_qualified_star": "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'",
    "project_mixed_star": "SELECT *, n_nationkey AS k FROM nation",
    "literals": "SELECT n_nationkey, 1 AS i, CAST(2.5 AS DOUBLE) AS f, 'x' AS t, TRUE AS b FROM nation",
    "literals_bare": "SELECT n_nationkey, NULL AS z, CAST(n_nationkey * 0.5 AS DOUBLE) AS h, n_nationkey > 3.14 AS big, n_nationkey + 1.5 < 20.25 AS low FROM nation",
    "null_column": "SELECT r_regionkey, CAST(NULL AS INT) AS k, NULL IS NULL AS t FROM region WHERE NULL IS NULL",
    "scalar_functions": "SELECT n_nationkey, UPPER(n_name) AS u, LOWER(SUBSTRING(n_name, 1, 3)) AS l, ABS(n_regionkey - 3) AS a, LENGTH(CONCAT(n_name, 'x')) AS c, COALESCE(NULLIF(n_regionkey, 0), -1) AS z FROM nation",
    "scalar_function_where": "SELECT c_custkey, ROUND(ABS(c_acctbal), 0) AS r FROM customer WHERE ABS(ROUND(c_acctbal, 0)) > 5000 AND LENGTH(c_mktsegment) = 8",
    "agg_function_key": "SELECT UPPER(SUBSTRING(c_mktsegment, 1, 1)) AS k, COUNT(*) AS n, MAX(ABS(c_acctbal)) AS m FROM customer GROUP BY UPPER(SUBSTRING(c_mktsegment, 1, 1)) HAVING MAX(LENGTH(c_name)) > 3",
    "alias_as": "SELECT x.n_name AS a FROM nation AS x JOIN region AS y ON x.n_regionkey = y.r_regionkey WHERE y.r_name = 'ASIA'",
    "bool_project": "SELECT o_orderkey, o_totalprice > 100000 AS big, NOT o_orderstatus = 'F' AS open FROM orders",
    "filter_eq": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "filter_neq": "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderstatus != 'O'",
    "filter_range": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000 AND o_custkey > 10 AND o_custkey <= 900",
    "filter_precedence": "SELECT o_orderkey FROM orders WHERE o_custkey = 1 OR o_custkey = 2 AND o_orderstatus = 'F'",
    "filter_not": "SELECT o_orderkey FROM orders WHERE NOT o_orderstatus = 'F' AND o_custkey < 100",
    "filter_parens": "SELECT p_partkey FROM part WHERE (p_size + 1) * 2 > 50",
    "filter_neg": "SELECT c_custkey FROM customer WHERE -c_acctbal + 100 > 0",
    "filter_null_cmp": "SELECT COUNT(*) AS n FROM orders WHERE o_orderstatus = NULL",
    "filter_bool_literal": "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000) = TRUE",
    "arith_all": "SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_extendedprice * (1 - l_discount) AS m, l_extendedprice / l_quantity AS d, -l_quantity AS g FROM lineitem",
    "int_div": "SELECT p_partkey, p_size / 2 AS h FROM part",
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_right_extends": "SELECT n.n_name, r.r_name FROM (SELECT * FROM nation WHERE n_regionkey < 3) n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_right_on_residual": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 200000",
    "join_left_on_residual": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "join_cross": "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r",
    "join_cross_on": "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r ON n.n_regionkey = r.r_regionkey",
    "join_theta": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey < r.r_regionkey",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
    "join_multi": "SELECT c.c_name, n.n_name, r.r_name FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey",
    "agg_global": "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_custkey) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders",
    "agg_sum_double": "SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM orders GROUP BY o_custkey",
    "agg_sum_exact": "SELECT l_returnflag, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_float_exact": "SELECT l_returnflag, SUM(l_quantity) AS s, AVG(l_quantity) AS a FROM lineitem GROUP BY l_returnflag",
    "agg_count_nulls": "SELECT COUNT(*) AS n, COUNT(o.o_orderkey) AS m FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "agg_multi_key": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_no_agg": "SELECT o_custkey FROM orders GROUP BY o_custkey",
    "agg_expr_key": "SELECT p_size + 1 AS k, COUNT(*) AS n FROM part GROUP BY p_size + 1",
    "agg_minmax_text": "SELECT MIN(c_name) AS a, MAX(c_name) AS b FROM customer",
    "agg_nested": "SELECT SUM(o_custkey) + 1 AS s FROM orders",
    "agg_empty": "SELECT COUNT(*) AS n, SUM(o_custkey) AS s FROM orders WHERE o_custkey < 0",
    "having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 5",
    "having_hidden": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 100000",
    "sort_asc_desc": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey ASC",
    "sort_hidden_col": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sort_alias": "SELECT o_custkey AS z, o_orderkey FROM orders ORDER BY z, o_orderkey LIMIT 10",
    "sort_agg": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY COUNT(*) DESC, o_custkey LIMIT 10",
    "limit_topk": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25",
    "limit_zero": "SELECT o_orderkey FROM orders LIMIT 0",
    "flagship": "SELECT c.c_name, CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' GROUP BY c.c_name HAVING SUM(o.o_totalprice) > 100 ORDER BY c.c_name DESC LIMIT 20",
}

#: Where the checking database needs other text: wide integer sums, CROSS JOIN with ON.
ORACLE_SQL = SQL | {
    "agg_global": "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_custkey) AS a, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders",
    "agg_nested": "SELECT CAST(SUM(o_custkey) + 1 AS BIGINT) AS s FROM orders",
    "agg_empty": "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders WHERE o_custkey < 0",
    "join_cross_on": "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
}


def _sql_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    names = tuple(t for t in TABLES if re.search(rf"\b{t}\b", text))  # each registration reads a footer
    return lambda spark, sf_dir: Engine.over(spark, sf_dir, names).sql(text)


def flagship_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query built from the DataFrame operators."""
    Engine.over(spark, sf_dir, ("orders", "customer"))
    joined = op.join(op.scan(spark, "orders", "o"), op.filter_rows(op.scan(spark, "customer", "c"), "c.c_mktsegment = 'BUILDING'"), "o.o_custkey = c.c_custkey")
    groups = op.having(joined, ["c.c_name"], [exact_sum(F.col("o.o_totalprice")).alias("total")], "SUM(o.o_totalprice) > 100")
    return op.limit(op.sort(groups, ["c_name DESC"]), 20)


def join_kinds_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of each join kind over nation and region, from the DataFrame operators."""
    Engine.over(spark, sf_dir, ("nation", "region"))
    n, r = op.scan(spark, "nation", "n"), op.filter_rows(op.scan(spark, "region", "r"), "r.r_regionkey < 3")
    out = None
    for kind in ("inner", "left", "right", "cross"):
        one = op.project(op.aggregate(op.join(n, r, "n.n_regionkey = r.r_regionkey", kind), [], ["COUNT(*) AS n", "COUNT(r.r_name) AS m"]), [F.lit(kind).alias("kind"), "n", "m"])
        out = one if out is None else out.union(one)
    return out


def join_right_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right join whose left side lacks some keys, from the DataFrame operators: rows of the right side stay, extended by nulls."""
    Engine.over(spark, sf_dir, ("nation", "region"))
    n = op.filter_rows(op.scan(spark, "nation", "n"), "n.n_regionkey < 3")
    return op.project(op.join(n, op.scan(spark, "region", "r"), "n.n_regionkey = r.r_regionkey", "right"), ["n.n_name", "r.r_name"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _sql_query(text) for name, text in SQL.items()} | {"flagship_operators": flagship_operators, "join_kinds_operators": join_kinds_operators, "join_right_operators": join_right_operators}


def oracle_sql() -> dict[str, str]:
    kinds = "SELECT '{0}' AS kind, COUNT(*) AS n, COUNT(r.r_name) AS m FROM nation n {1} JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n.n_regionkey = r.r_regionkey"
    return ORACLE_SQL | {
        "flagship_operators": ORACLE_SQL["flagship"],
        "join_kinds_operators": " UNION ALL ".join(kinds.format(k, "" if k == "cross" else k.upper()) for k in ("inner", "left", "right", "cross")),
        "join_right_operators": ORACLE_SQL["join_right_extends"],
    }
