"""The listing of a storage tree as a data source: ``spark.read.format("storage_listing")`` and SQL.

A partition is a folder of the first level below the area, so one task lists it. A filter on the beginning
of ``path`` or of ``contenthash``, or on one value of either, is pushed down: only folders that
can hold such files are listed at all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
)

from cleanlake.sources.inventory import list_entries, open_root

NAME = "storage_listing"
_COLUMNS = ("path", "contenthash", "length")


@dataclass(frozen=True)
class Folder(InputPartition):
    """What one task lists: a folder, or a file that lies on the first level."""

    path: str
    is_dir: bool
    length: int


class StorageListing(DataSource):
    """Options: ``root`` (URI or path) and ``area`` (a folder in it, ``filedir`` unless given)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, contenthash string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        if "root" not in self.options:
            raise ValueError("option root says where the storage tree lies")
        return ListingReader(self.options["root"], self.options.get("area", "filedir"))


class ListingReader(DataSourceReader):
    """``beginnings`` are sets of texts; a path must begin with one of each set. The engine
    applies the filters to the rows as well."""

    def __init__(self, root: str, area: str):
        self.root, self.area = root, area.strip("/")
        self.beginnings: list[tuple[str, ...]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for found in filters:
            values = None
            if isinstance(found, (EqualTo, StringStartsWith)):
                values = (found.value,)
            elif isinstance(found, In):
                values = tuple(found.value)
            if values is not None and all(isinstance(v, str) for v in values):
                if found.attribute == ("path",):
                    self.beginnings.append(values)
                elif found.attribute == ("contenthash",):
                    # A stored file lies in the folders of its hash's first letters.
                    folders = (f"{self.area}/{v[:2]}" + (f"/{v[2:4]}" if len(v) > 2 else "") for v in values)
                    self.beginnings.append(tuple(folders))
            yield found

    def _may_hold(self, path: str) -> bool:
        """Whether files at or below ``path`` can begin as they must."""
        return all(
            any(b.startswith(path + "/") or (path + "/").startswith(b) or path.startswith(b) for b in own)
            for own in self.beginnings
        )

    def partitions(self) -> list[Folder]:
        """One level is listed here: as many folders as there are first letters."""
        filesystem, base = open_root(self.root)
        found = []
        for entries in list_entries(filesystem, base, [(self.area, True, 0)], deep=False):
            found += [Folder(*entry) for entry in entries if self._may_hold(entry[0])]
        return sorted(found, key=lambda f: f.path) or [Folder(self.area + "/", False, -1)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        if partition.length < 0:  # there is nothing to list
            return
        filesystem, base = open_root(self.root)
        pending = [(partition.path, partition.is_dir, partition.length)]
        while pending:
            level, pending = pending, []
            for entry in level:
                if not self._may_hold(entry[0]):
                    continue
                # With filters a level is looked at before the next, to leave out what cannot match.
                deep = not self.beginnings
                for found in list_entries(filesystem, base, [entry], deep=deep):
                    pending += [f for f in found if f[1]]
                    files = [f for f in found if not f[1] and self._may_hold(f[0])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([f[0] for f in files], pa.string()),
                            pa.array([f[0].rpartition("/")[2] for f in files], pa.string()),
                            pa.array([f[2] for f in files], pa.int64()),
                        ],
                        names=list(_COLUMNS),
                    )


def register_listing(spark: SparkSession) -> None:
    """Make the source known to a session, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StorageListing)
