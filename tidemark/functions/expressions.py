"""SQL fragments over bars ordered by time within a symbol.

Every trailing window names its partition and order, so that all fragments of
one stage share a single sort. Windows without the full number of values give
null.
"""

from __future__ import annotations

KEY = "PARTITION BY symbol ORDER BY time"
CUM = f"({KEY} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def frame(first: int, last: int) -> str:
    """The window from ``first`` to ``last`` rows from here; negative is before."""
    side = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
    return f"({KEY} ROWS BETWEEN {side(first)} AND {side(last)})"


def over(f: str, x: str, first: int, last: int, least: int | None = None) -> str:
    """f(x) over the rows first..last, null below ``least`` values (default: all)."""
    w = frame(first, last)
    need = last - first + 1 if least is None else least
    call = f.format(x=x) if "{x}" in f else f"{f}({x})"
    return f"CASE WHEN count({x}) OVER {w} >= {need} THEN {call} OVER {w} END"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    return over(f, x, 1 - n, 0, least)


def sma(x: str, n: int) -> str:
    return roll("avg", x, n)


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({KEY})"


def lead(x: str, k: int = 1) -> str:
    return f"lead({x}, {k}) OVER ({KEY})"


def cum(f: str, x: str) -> str:
    return f"{f}({x}) OVER {CUM}"


def wma(x: str, n: int) -> str:
    """Weights 1..n, the newest heaviest."""
    terms = " + ".join(f"{n - k} * {lag(x, k) if k else x}" for k in range(n))
    return f"({terms}) / {n * (n + 1) / 2}D"


def xup(a: str, b: str, b_before: str | None = None) -> str:
    """a crosses above b on this bar."""
    before = b_before if b_before is not None else (b if _number(b) else lag(b))
    return f"coalesce({a} > {b} AND {lag(a)} <= {before}, false)"


def xdn(a: str, b: str, b_before: str | None = None) -> str:
    before = b_before if b_before is not None else (b if _number(b) else lag(b))
    return f"coalesce({a} < {b} AND {lag(a)} >= {before}, false)"


def _number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True
