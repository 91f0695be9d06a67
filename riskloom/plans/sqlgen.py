"""DuckDB-SQL twins of the aggregate builders (used only for oracle strings)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

# Category domains of the driver tables (TPC-H-ish generator).
# The Spark side discovers them at run time; the oracle lists them.
DOMAINS = {
    "o_orderstatus": ["F", "O", "P"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "l_returnflag": ["A", "N", "R"],
    "l_linestatus": ["F", "O"],
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
}


def q(name: str) -> str:
    return f'"{name}"'


def lit(v) -> str:
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return repr(v)


def clean_token(v) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", str(v)).strip("_") or "blank"


def sum_of(x: str) -> str:
    return f"sum(CAST({x} AS DOUBLE))"


def mean_of(x: str) -> str:
    return f"avg({x})"


def var_of(x: str, ddof: int = 1) -> str:
    return f"{'var_samp' if ddof == 1 else 'var_pop'}({x})"


def stat(fn: str, col: str, cond: str | None = None, integral: bool = False) -> str:
    x = q(col) if cond is None else f"CASE WHEN {cond} THEN {q(col)} END"
    if fn == "min":
        e = f"min({x})"
    elif fn == "max":
        e = f"max({x})"
    elif fn == "mean":
        e = mean_of(x)
    elif fn == "sum":
        e = f"CAST(coalesce(sum({x}), 0) AS BIGINT)" if integral else f"coalesce({sum_of(x)}, 0.0)"
    elif fn == "var":
        e = var_of(x)
    elif fn == "std":
        e = f"sqrt({var_of(x)})"
    elif fn == "median":
        e = f"quantile_cont({x}, 0.5)"
    elif fn == "size":
        e = "count(*)" if cond is None else f"count(CASE WHEN {cond} THEN 1 END)"
    elif fn == "nunique":
        e = f"count(DISTINCT {x})"
    else:
        raise ValueError(fn)
    if cond is not None and fn in ("sum", "size", "nunique"):
        e = f"CASE WHEN count(CASE WHEN {cond} THEN 1 END) > 0 THEN {e} END"
    return e


def multi_stat(spec: Mapping[str, Sequence[str]], prefix: str = "", cond: str | None = None,
               integral: Sequence[str] = ()) -> list[str]:
    return [f"{stat(fn, c, cond, c in integral)} AS {q(f'{prefix}{c}_{fn.upper()}')}"
            for c, fns in spec.items() for fn in fns]


def category_share(vocab: Mapping[str, Sequence], prefix: str = "", suffix: str = "_MEAN",
                   nan_category: bool = True) -> list[str]:
    out = []
    for col, values in vocab.items():
        for v in values:
            out.append(f"avg(CAST({q(col)} IS NOT DISTINCT FROM {lit(v)} AS DOUBLE)) AS "
                       f"{q(f'{prefix}{col}_{clean_token(v)}{suffix}')}")
        if nan_category:
            out.append(f"avg(CAST({q(col)} IS NULL AS DOUBLE)) AS {q(f'{prefix}{col}_nan{suffix}')}")
    return out


def one_hot(vocab: Mapping[str, Sequence], nan_category: bool = False) -> list[str]:
    out = []
    for col, values in vocab.items():
        for v in values:
            out.append(f"CAST({q(col)} IS NOT DISTINCT FROM {lit(v)} AS INTEGER) AS {q(f'{col}_{clean_token(v)}')}")
        if nan_category:
            out.append(f"CAST({q(col)} IS NULL AS INTEGER) AS {q(f'{col}_nan')}")
    return out
