"""Arc (midpoint) price elasticity of demand.

    PED = ((Qh - Qb) / ((Qb + Qh) / 2)) / ((Ph - Pb) / ((Pb + Ph) / 2))

is computed in the equivalent one-division form

    ((Qh - Qb) * (Ph + Pb)) / ((Qh + Qb) * (Ph - Pb))

on DECIMALs: one division keeps the quotient's scale wide enough that the
final rounding is exact. A zero midpoint gives NULL as in the guarded form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def arc_elasticity(q_base, q_hike, p_base, p_hike, digits: int = 4) -> Column:
    qb = _c(q_base).cast("decimal(12,0)")
    qh = _c(q_hike).cast("decimal(12,0)")
    pb, ph = _c(p_base), _c(p_hike)
    num = (qh - qb) * F.nullif(ph + pb, F.lit(0))
    den = F.nullif((qh + qb) * (ph - pb), F.lit(0))
    return F.round(F.try_divide(num, den), digits)
