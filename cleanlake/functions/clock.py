"""Cut-off times. The caller supplies one ``as_of`` second for the whole run."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from cleanlake.policy import DAY


def days_before(as_of: int, days: int) -> int:
    return as_of - days * DAY


def years_before(as_of: int, years: int) -> int:
    """Same calendar day and time ``years`` earlier, in UTC.

    29 February in a year without one rolls over to 1 March.
    """
    now = datetime.fromtimestamp(as_of, timezone.utc)
    first = now.replace(year=now.year - years, day=1)
    return int((first + timedelta(days=now.day - 1)).timestamp())
