"""Statements that write the powers a pattern writes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.statements import explicit_positions
from ..pattern import powers_of_statement
from ..query import Power, Query


def could_write(statement: Column, power: Power) -> Column:
    """Signs that a statement with the power must have: ^ for a power; for a product of n factors n - 1 times *, unless a ^ stands for several."""
    if power.head == "HPow.hPow":
        return statement.contains("^")
    stars = F.length(statement) - F.length(F.replace(statement, F.lit("*"), F.lit("")))
    return (stars > 0) & ((stars + 1 >= power.exponent) | statement.contains("^"))


def placed(statement: str, concl: str | None, heads: list[str], explicit: list[str] | None, implicit: bool) -> list[tuple[int, Power]]:
    """Powers of a printed statement by their argument, in the view (explicit or all arguments) that is asked for."""
    found, full = powers_of_statement(statement)
    if not found or full == implicit:
        return found
    at = explicit_positions(heads, explicit)
    if at is None:  # older rows don't say which arguments are explicit
        arity = 2 if concl in ("Eq", "Ne", "Iff", "LE.le", "LT.lt", "GE.ge", "GT.gt") else None
        if concl == "HEq":
            at = [1, 3]
        elif arity and len(heads) >= arity:
            at = list(range(len(heads) - arity, len(heads)))
        else:
            return []
    if implicit:
        return [(at[i], p) for i, p in found if i < len(at) and at[i] is not None]
    return [(at.index(i), p) for i, p in found if i in at]


def writes_powers(q: Query) -> Column:
    """Whether a row's statement writes all powers of q. Statements without the signs are turned away before any is read."""
    if not q.powers:
        return F.lit(True)

    @pandas_udf("boolean")
    def of(statement: pd.Series, concl: pd.Series, heads: pd.Series, explicit: pd.Series) -> pd.Series:
        out = []
        for t, c, h, e in zip(statement, concl, heads, explicit, strict=True):
            found = placed(t, c, list(h) if h is not None else [], None if e is None else list(e), q.implicit) if t else []
            out.append(all(p in found for p in q.powers))
        return pd.Series(out, dtype="bool")

    could = F.lit(True)
    for _, power in q.powers:
        could = could & could_write(F.col("type"), power)
    # rows that can't answer reach Python without their text
    return could & of(F.when(could, F.col("type")), "concl", "concl_args", "concl_explicit_args")
