"""Column expressions on event time (all TIMESTAMP_NTZ, no zone)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moneta import params as P


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _hhmm_micros(hhmm: str) -> int:
    h, m = hhmm.split(":")[:2]
    return (int(h) * 3600 + int(m) * 60) * 1_000_000


def micros_of_day(ts) -> Column:
    """Microseconds since midnight, exact (second fraction included)."""
    ts = _col(ts)
    # extract(SECOND ...) is DECIMAL(8,6): whole seconds plus the fraction
    sec_micros = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") * 1_000_000 + sec_micros


def is_night_guard(ts, start: str = P.NIGHT_START, end: str = P.NIGHT_END) -> Column:
    """Guard rule: time of day within [start, end], both ends inclusive to the
    microsecond; a window with start > end wraps midnight."""
    t = micros_of_day(ts)
    s, e = _hhmm_micros(start), _hhmm_micros(end)
    if s > e:
        return (t >= s) | (t <= e)
    return (t >= s) & (t <= e)


def is_night_hour(ts) -> Column:
    """Hour rule used by features and profiles: the whole hour 0..6 counts."""
    h = F.hour(_col(ts))
    return (h >= 0) & (h <= 6)


def hour_risk_multiplier(ts) -> Column:
    m = F.create_map(*[x for k, v in sorted(P.HOUR_RISK_MULTIPLIERS.items())
                       for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.element_at(m, F.hour(_col(ts))), F.lit(1.0))


def weekday_mon0(d) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_col(d))


def week_of_month(d) -> Column:
    return F.floor((F.dayofmonth(_col(d)) - 1) / 7).cast("int") + 1
