"""32-bit integer expressions as SQL text that both Spark and DuckDB read."""


def wrapped(op: str, a: str, b: str) -> str:
    """a + b or a - b modulo 2**32, safe under ANSI mode."""
    return f"CAST(((CAST({a} AS BIGINT) {op} CAST({b} AS BIGINT) + 2147483648) & 4294967295) - 2147483648 AS INT)"


def in_range(value: str, low: int | None, high: int | None) -> str:
    """low <= value < high; None is open."""
    parts = ([f"{value} >= {low}"] if low is not None else []) + ([f"{value} < {high}"] if high is not None else [])
    return " AND ".join(parts) or f"{value} IS NOT NULL"
