"""Sizes, names and dates for reports. Numbers stay numbers wherever possible."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("bytes", "KB", "MB", "GB", "TB")


def mib(size: Column | str, digits: int | None = 1) -> Column:
    value = _col(size) / F.lit(1024.0**2)
    return value if digits is None else F.round(value, digits)


def gib(size: Column | str, digits: int = 3) -> Column:
    return F.round(_col(size) / F.lit(1024.0**3), digits)


def format_bytes(size: Column | str, digits: int = 2) -> Column:
    """Readable size such as ``1.5 KB``: no trailing zeros, nothing above TB."""
    value = F.greatest(_col(size).cast("double"), F.lit(0.0))

    def shown(power: int) -> Column:
        number = F.round(value / F.lit(1024.0**power), digits).cast("string")
        return F.concat(F.regexp_replace(number, r"\.0$", ""), F.lit(" " + UNITS[power]))

    text = F.when(value < 1024.0, shown(0))
    for power in range(1, len(UNITS) - 1):
        text = text.when(value < 1024.0 ** (power + 1), shown(power))
    return text.otherwise(shown(len(UNITS) - 1))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def day(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_col(epoch)), "yyyy-MM-dd")


def minute(epoch: Column | str) -> Column:
    return F.date_format(F.timestamp_seconds(_col(epoch)), "yyyy-MM-dd HH:mm")


def full_name(first: str = "firstname", last: str = "lastname") -> Column:
    return F.concat_ws(" ", F.col(first), F.col(last))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
