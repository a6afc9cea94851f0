from lodestone.plans.guard import NotAQuery, parse_expression, parse_query

__all__ = ["NotAQuery", "parse_expression", "parse_query"]
