"""Inputs several queries share, each derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The holidays both engines use.
HOLIDAYS = [f"{y}-{d}" for y in range(1995, 2002) for d in ("01-01", "07-01", "12-25", "12-26")]
HOLIDAYS_SQL = "(" + ", ".join(f"'{h}'" for h in HOLIDAYS) + ")"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floats rounded, so two engines' last bits compare equal."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        floating = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        out.append(F.round(c.cast("double"), digits).alias(f.name) if floating else c)
    return df.select(*out)


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`").cast("bigint") for c in columns})


def gappy_value() -> Column:
    """``events.value`` with a null in every seventh event."""
    return F.when(F.col("event_id") % 7 != 0, F.col("value"))


def gappy_events(t) -> DataFrame:
    return t.events.withColumn("value", gappy_value())


GAPPY = "(SELECT * REPLACE (CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value) FROM events)"


def flows(t) -> DataFrame:
    """Cash flows: one row per order line."""
    return t.lineitem.select(
        F.col("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("counterparty_id"),
        F.when(F.col("l_linestatus") == "O", "IN").otherwise("OUT").alias("direction"),
        F.col("l_extendedprice").alias("total_amount"),
        (F.col("l_quantity") * 1500).alias("forecast"),
        "l_orderkey", "l_linenumber",
    )


FLOWS = """(SELECT l_shipdate AS date, l_suppkey AS counterparty_id,
  CASE WHEN l_linestatus = 'O' THEN 'IN' ELSE 'OUT' END AS direction,
  l_extendedprice AS total_amount, l_quantity * 1500 AS forecast, l_orderkey, l_linenumber FROM lineitem)"""

DAILY = """(SELECT date_trunc('day', ts) AS date, event_type, sum(value) AS value FROM events GROUP BY 1, 2)"""


# ---- tails in SQL: Simpson's rule over the density, for twins of tests and intervals ----

_STEPS = 8000


def _simpson(density: str, upto: str) -> str:
    """Integral of a density of ``x`` from 0 to ``upto``, columns of the row around it."""
    weighted = f"sum((CASE WHEN i % {_STEPS} = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {density.replace('$x', f'({upto} * i / {_STEPS})')})"
    return f"(SELECT {weighted} FROM range({_STEPS + 1}) r(i)) * {upto} / {3 * _STEPS}"


def normal_p_sql(z: str) -> str:
    """Two-sided p-value of a standard normal."""
    return f"greatest(0, 1 - 2 * {_simpson('exp(-0.5 * pow($x, 2)) / sqrt(2 * pi())', f'least(abs({z}), 14)')})"


def t_p_sql(t: str, dof: str) -> str:
    """Two-sided p-value of Student's t."""
    density = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0) - 0.5 * ln({dof} * pi()) - ({dof} + 1) / 2.0 * ln(1 + pow($x, 2) / {dof}))"
    return f"greatest(0, 1 - 2 * {_simpson(density, f'least(abs({t}), 40)')})"


def f_p_sql(f: str, d1: str, d2: str) -> str:
    """Upper tail of an F distribution with more than two degrees above the line."""
    density = (f"exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0) + {d1} / 2.0 * ln({d1} / {d2}::DOUBLE) + ({d1} / 2.0 - 1) * ln(greatest($x, 1e-300))"
               f" - ({d1} + {d2}) / 2.0 * ln(1 + {d1} * $x / {d2}))")
    return f"greatest(0, 1 - {_simpson(density, f'least({f}, 60)')})"


_Z = "1.959963984540054e0"


def t_975_sql(dof: str) -> str:
    """The 97.5 % point of Student's t by its expansion about the normal point, for some hundred degrees or more."""
    return (f"({_Z} + (pow({_Z}, 3) + {_Z}) / (4.0 * {dof}) + (5 * pow({_Z}, 5) + 16 * pow({_Z}, 3) + 3 * {_Z}) / (96 * pow({dof}, 2)) + (3 * pow({_Z}, 7) + 19 * pow({_Z}, 5) + 17 * pow({_Z}, 3) - 15 * {_Z}) / (384 * pow({dof}, 3))"
            f" + (79 * pow({_Z}, 9) + 776 * pow({_Z}, 7) + 1482 * pow({_Z}, 5) - 1920 * pow({_Z}, 3) - 945 * {_Z}) / (92160 * pow({dof}, 4)))")


def chi2_point_sql(z: str, dof: str) -> str:
    """A point of chi-square by its expansion about the normal point ``z``, for some hundred degrees or more."""
    return (f"({dof} + {z} * sqrt(2.0 * {dof}) + 2 / 3.0 * (pow({z}, 2) - 1) + (pow({z}, 3) - 7 * {z}) / (9 * sqrt(2.0 * {dof})) - (6 * pow({z}, 4) + 14 * pow({z}, 2) - 32) / (405.0 * {dof})"
            f" + (9 * pow({z}, 5) + 256 * pow({z}, 3) - 433 * {z}) / (4860 * sqrt(2.0) * pow({dof}, 1.5)) + (12 * pow({z}, 6) - 243 * pow({z}, 4) - 923 * pow({z}, 2) + 1472) / (25515 * pow({dof}, 2)))")
