"""Front-door check on parsed SQL: only queries pass; commands are refused before anything could run."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Nodes of unresolved plans that only read. Any other node, wherever it stands, is refused: writes can stand below a WITH or a
#: UNION, and TRANSFORM runs programs.
QUERY_NODES = frozenset({
    "Project", "Aggregate", "Filter", "UnresolvedHaving", "Join", "LateralJoin", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct",
    "Union", "Intersect", "Except", "UnresolvedWith", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "WithWindowDefinition",
    "UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "LocalRelation", "OneRowRelation", "OneRowRelation$",
    "UnresolvedHint", "RepartitionByExpression", "Sample", "Generate", "Pivot", "Unpivot",
})


class NotAQuery(ValueError):
    """The statement isn't a query."""


def _plans(plan) -> Iterator:
    """A plan's nodes, those of its common table expressions and subqueries included."""
    todo = [plan]
    while todo:
        yield (node := todo.pop())
        for below in (node.children(), node.innerChildren()):
            todo += [below.apply(i) for i in range(below.size())]


def parse_query(spark: SparkSession, text: str):
    """The unresolved plan of a query (a JVM object). Raises ParseException, or NotAQuery for any other statement."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    for node in _plans(plan):
        if (name := node.getClass().getSimpleName()) not in QUERY_NODES:
            raise NotAQuery(f"only queries are accepted, not {name}")
    return plan


def parse_expression(spark: SparkSession, text: str):
    """The unresolved expression of a text (a JVM object)."""
    return spark._jsparkSession.sessionState().sqlParser().parseExpression(text)


def shape(node) -> str:
    """Class names of an expression tree as nested calls, leaves as SQL text: And(EqualTo(a, 1), ...)."""
    name = node.getClass().getSimpleName()
    children = [node.children().apply(i) for i in range(node.children().size())]
    return f"{name}({', '.join(map(shape, children))})" if children else node.sql()
