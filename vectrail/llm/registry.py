"""Queries of this subpackage by name, and their SQL where it can express them."""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def free(taken: list[str], name: str) -> str:
    """``name``, or if a column is called so, the name with underscores before it."""
    while name.lower() in {c.lower() for c in taken}:
        name = f"_{name}"
    return name


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return register
