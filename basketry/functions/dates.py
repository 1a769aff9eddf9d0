"""Date keys: spreadsheet serials, yyyymm months, first day of a month."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: day zero of spreadsheet date serials.
SERIAL_EPOCH = "1899-12-30"


def _epoch() -> Column:
    return F.lit(SERIAL_EPOCH).cast("date")


def serial_to_date(serial: Column) -> Column:
    return F.date_add(_epoch(), serial.cast("int"))


def date_to_serial(date: Column) -> Column:
    return F.datediff(date, _epoch())


def yearmonth(date: Column) -> Column:
    """Integer month key yyyymm."""
    return F.year(date) * 100 + F.month(date)


def month_start(ym: Column) -> Column:
    """First day of a yyyymm month, without a detour through text."""
    return F.make_date(F.floor(ym / 100).cast("int"), (ym % 100).cast("int"), F.lit(1))
