"""Small column helpers shared by all operators."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS_PER_DAY = 86_400_000_000


def clock(value=None):
    """The time a run works with: the one given, else now in UTC.  A job with
    several steps takes it once and hands it to each."""
    return _dt.datetime.now(_dt.timezone.utc) if value is None else value


def ts_lit(value: str | _dt.datetime | Column | None = None) -> Column:
    """A zone-less timestamp literal (``TIMESTAMP_NTZ``), independent of the
    session time zone; without a value the current time."""
    value = clock(value)
    if isinstance(value, Column):
        return value
    if isinstance(value, _dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps, floored like ``timedelta.days``.

    Not ``datediff``: a 47 hour gap is one day here, two calendar days there.
    """
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return F.floor(micros / F.lit(MICROS_PER_DAY)).cast("bigint")


def plus_seconds(ts: Column, seconds: int | Column) -> Column:
    secs = seconds if isinstance(seconds, Column) else F.lit(int(seconds))
    return ts + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.  A one-element
    array keeps the optimiser from copying a large expression into every
    place that uses it (``body`` sees a lambda variable, not the tree)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Render a result for engine-neutral comparison: doubles rounded, arrays
    joined with ``|`` in their own order, timestamps as text with micros."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)  # -0.0 -> 0.0
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(c.alias(f.name))
    return df.select(*cols)
