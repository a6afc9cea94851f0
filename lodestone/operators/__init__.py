from lodestone.operators.relational import aggregate, filter_rows, having, join, limit, project, scan, sort

__all__ = ["aggregate", "filter_rows", "having", "join", "limit", "project", "scan", "sort"]
