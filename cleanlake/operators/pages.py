"""Pages of a search by number, without sorting what comes before them.

The contents that a filter finds are summarised once: hash and lowest record id, laid out by ranges of
the hash, with a count per range. Page n is then found by adding up counts, and only the one
or two ranges it lies in are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleanlake.operators.numbering import placed_in_ranges
from cleanlake.operators.search import PAGE_SIZE, matching_files, with_users
from cleanlake.plans.staging import Staging
from cleanlake.policy import FileFilter


@dataclass(frozen=True)
class ContentPages:
    """The contents of one search. ``before`` has, for each range, how many contents come before it,
    and at the end how many there are: one number for each task that wrote them."""

    files: DataFrame
    users: DataFrame
    contents: DataFrame
    before: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.before[-1]

    def ranges(self, first: int, last: int) -> list[int]:
        """Ranges that hold contents number ``first`` to ``last`` (left out)."""
        pairs = zip(self.before, self.before[1:])
        return [k for k, (low, high) in enumerate(pairs) if low < last and high > first]

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        """One record per content, with its user, as ``search.find_files`` shows them."""
        first = number * size
        wanted = self.ranges(first, first + size)
        rows = self.contents.where(F.col("part").isin(wanted) if wanted else F.lit(False))
        start = F.element_at(F.array(*[F.lit(n).cast("bigint") for n in self.before]), F.col("part") + 1)
        at = F.col("place") + start
        page = rows.where((at >= first) & (at < first + size)).select("id")
        return with_users(self.files.join(F.broadcast(page), "id", "left_semi"), self.files, self.users)


def content_pages(
    files: DataFrame, users: DataFrame, flt: FileFilter, staging: Staging, ranges: int | None = None
) -> ContentPages:
    """Lay the contents out. What is returned reads from ``staging``, which the caller closes."""
    found = matching_files(files, users, flt).groupBy("contenthash").agg(F.min("id").alias("id"))
    contents = placed_in_ranges(found, "contenthash", ranges=ranges)
    contents = staging.keep(contents, "contents", ("part",))
    counts = {r["part"]: r["n"] for r in contents.groupBy("part").agg(F.count("*").alias("n")).collect()}
    sizes = [counts.get(k, 0) for k in range(max(counts, default=-1) + 1)]
    return ContentPages(files, users, contents, (0, *accumulate(sizes)))
