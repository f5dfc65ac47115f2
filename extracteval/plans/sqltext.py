"""Small builders for reference SQL text."""

from __future__ import annotations

from collections.abc import Iterable


def nk(x: str) -> str:
    """Key normalising, collapse mode."""
    return rf"trim(regexp_replace(translate(lower({x}), '_-', '  '), '\s+', ' ', 'g'))"


def nks(x: str) -> str:
    """Key normalising, strict mode."""
    return f"translate(trim(lower({x})), '_-', '  ')"


def nv(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


def nvs(x: str) -> str:
    return f"trim(lower({x}))"


def lit(v) -> str:
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(rows: Iterable[tuple], *cols: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS _v({', '.join(cols)}))"


def in_list(vs: Iterable) -> str:
    return "(" + ", ".join(lit(v) for v in vs) + ")"


def h32(seed: str, *keys: str) -> str:
    """The first 32 bits of md5(seed|key...) as a number."""
    text = " || '|' || ".join([lit(seed), *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def hx(seed: str, *keys: str) -> str:
    text = " || '|' || ".join([lit(seed), *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"md5({text})"
