"""Pieces of SQL text shared by the oracles."""

from __future__ import annotations

from oddsframe import dims


def values(rows: list[tuple], alias: str, *columns: str) -> str:
    """A named inline table."""
    def lit(v):
        if v is None:
            return "null"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{alias}({', '.join(columns)}) as (values {body})"


def rn(expr: str, digits: int) -> str:
    unit = float(10**digits)
    return f"(floor(({expr}) * {unit} + 0.5) / {unit})"


def mean(expr: str, unit: int = 10_000, where: str = "true") -> str:
    return (
        f"(cast(sum(cast(round(({expr}) * {float(unit)}) as bigint)) filter ({where}) as double) / {float(unit)}"
        f" / count({expr}) filter ({where}))"
    )


def spread(expr: str, where: str = "true") -> str:
    t = f"cast(round(({expr}) * 10000.0) as bigint)"
    n = f"count({expr}) filter ({where})"
    s1 = f"cast(sum({t}) filter ({where}) as double)"
    s2 = f"cast(sum({t} * {t}) filter ({where}) as double)"
    return f"(case when {n} < 2 then 0.0 else sqrt(greatest(0.0, ({s2} - {s1} * {s1} / {n}) / {n})) / 10000.0 end)"


COMPANIES = values(dims.company_rows(), "companies", "market", "company_id", "id_key")
LABELS = values([(k, v) for k, v in dims.BOOKMAKER_LABELS.items()], "labels", "id_key", "label")
RANKS = values([(k, i + 1) for i, k in enumerate(dims.bookmaker_order())], "ranks", "id_key", "rnk")
TARGETS = "(" + ", ".join(f"'{k}'" for k in dims.TARGET_BOOKMAKERS) + ")"

# fx_quotes with the bookmaker of each row; a plain join on the fixed map
KEYED = (
    f"{COMPANIES}, {LABELS.replace('labels(', 'book_labels(')}, {RANKS}, keyed as (select q.*, c.id_key bookmaker_key, l.label bookmaker"
    " from fx_quotes q left join companies c on c.market = q.market and c.company_id = q.company_id"
    " left join book_labels l on l.id_key = c.id_key)"
)
ROW_ORDER = "changed_at, tie_break, company_id, ini_a, cur_a"
MAIN = (
    f"main as (select * from keyed where bookmaker_key in {TARGETS} qualify row_number() over (partition by match_id, market,"
    f" period, bookmaker_key order by is_multi_line, {ROW_ORDER}) = 1)"
)
