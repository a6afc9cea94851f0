"""Analytic SELECT engine on Spark SQL: catalog, SQL front door, relational operators."""

from lodestone.engine import Engine
from lodestone.session import get_session

__all__ = ["Engine", "get_session"]
