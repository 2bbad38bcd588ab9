"""The box and interval formulas as SQL functions of a session, for spark.sql and selectExpr."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .stats import Z

_SIDES = "{0}x0 double, {0}y0 double, {0}x1 double, {0}y1 double"
_AREA = "greatest(0.0D, {0}x1 - {0}x0) * greatest(0.0D, {0}y1 - {0}y0)"
_SHARED = "greatest(0.0D, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0.0D, least(ay1, by1) - greatest(ay0, by0))"
_A, _B = _AREA.format("a"), _AREA.format("b")
_TWO = f"{_SIDES.format('a')}, {_SIDES.format('b')}"
_CENTRE = f"(hits / n + {Z * Z}D / (2 * n)) / (1 + {Z * Z}D / n)"
_HALF = f"{Z}D * sqrt(hits / n * (1 - hits / n) / n + {Z * Z}D / (4 * n * n)) / (1 + {Z * Z}D / n)"

#: name: (parameters, body); every body is one expression, so that the optimizer puts it in place of the call.
FUNCTIONS = {
    "iou": (_TWO, f"case when {_A} + {_B} - {_SHARED} > 0 then ({_SHARED}) / ({_A} + {_B} - {_SHARED}) else 0.0D end"),
    "ioa": (_TWO, f"case when least({_A}, {_B}) > 0 then ({_SHARED}) / least({_A}, {_B}) else 0.0D end"),
    "wilson_lo": ("hits double, n double", f"case when n > 0 then greatest(0.0D, {_CENTRE} - {_HALF}) else 0.0D end"),
    "wilson_hi": ("hits double, n double", f"case when n > 0 then least(1.0D, {_CENTRE} + {_HALF}) else 0.0D end"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session, replacing those of the same names; returns the names."""
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({parameters}) returns double return {body}")
    return list(FUNCTIONS)
