"""Small helpers to write DuckDB oracle SQL with the same rules as the Spark code."""

from __future__ import annotations

from ..sources.fixtures import FIXTURE_OBS_DATE

D = 86_400_000_000
H = 3_600_000_000
OBS = f"epoch_us(TIMESTAMP '{FIXTURE_OBS_DATE} 00:00:00')"


def fdiv(a: str, b: int) -> str:
    """Exact floor division of an integer expression by a positive constant."""
    return f"((({a}) - ((({a}) % {b}) + {b}) % {b}) // {b})"


def fdays(later_us: str, earlier_us: str) -> str:
    return fdiv(f"({later_us}) - ({earlier_us})", D)


def clip_lo(x: str, lo) -> str:
    return f"(CASE WHEN ({x}) IS NULL THEN NULL ELSE greatest({x}, {lo}) END)"


def sdiv(a: str, b: str) -> str:
    """safe_div: NULL/0 denominator -> 0, NULL numerator -> 0."""
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), CAST(0 AS DOUBLE))"


def cnt(cond: str) -> str:
    return f"count_if(coalesce({cond}, false))"


def mode_cte(name: str, src: str, key: str, value: str, where: str = "TRUE", alias: str = "mode_value") -> str:
    """Most frequent non-NULL value per key, smallest value on ties."""
    return (f"{name} AS (SELECT {key}, v AS {alias} FROM (SELECT {key}, {value} AS v, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {value}) AS rn "
            f"FROM {src} WHERE ({where}) AND ({value}) IS NOT NULL GROUP BY {key}, {value}) WHERE rn = 1)")


def round_cols(cols: list[tuple[str, str]]) -> str:
    """Projection list; ('d', name) rounds a double to 6 places."""
    out = []
    for kind, c in cols:
        out.append(f"round({c}, 6) AS {c}" if kind == "d" else c)
    return ", ".join(out)


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def top_n(expr: str, top: list[str], fill: str = "unknown") -> str:
    v = f"lower(trim(coalesce({expr}, {lit(fill)})))"
    allowed = ", ".join(lit(t.lower()) for t in top + [fill])
    return f"(CASE WHEN {v} IN ({allowed}) THEN {v} ELSE 'other' END)"


def b2l(cond: str) -> str:
    """Boolean (NULL -> false) as BIGINT 0/1."""
    return f"CAST(coalesce({cond}, false) AS BIGINT)"


def unround(sql: str) -> str:
    """Drop every ``round(<expr>, 6)`` wrapper (for oracles reused as inputs)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, last_comma = 0, j + 6, None
        while k < len(sql):
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    break
                depth -= 1
            elif ch == "," and depth == 0:
                last_comma = k
            k += 1
        if last_comma is not None and sql[last_comma + 1:k].strip() == "6":
            out.append(sql[i:j])
            out.append("(" + unround(sql[j + 6:last_comma]) + ")")
            i = k + 1
        else:
            out.append(sql[i:j + 6])
            i = j + 6
