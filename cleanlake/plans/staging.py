"""Written tables between the steps of a job.

A step's result that later steps read is written once, to the folder the cluster shares. This
cuts the lineage, survives lost executors, and gives the planner true sizes, so it broadcasts
a doomed set only when that set really is small. A side of a join that is an aggregate is
written for another reason too: read back, it is shuffled plainly, and only between two plain
shuffles does adaptive execution split a hot key.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from cleanlake.sources.tables import path_exists


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder


class Staging:
    """Writes frames as parquet below one folder per job and reads them back.

    Whoever makes one removes its folder with ``close`` (or ``with``) when nothing reads the
    tables any more.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        base = folder or checkpoint_folder(spark)
        self.folder = f"{base.rstrip('/')}/cleanlake-{uuid.uuid4().hex}"
        self._once: dict[str, DataFrame] = {}
        self._lock = threading.Lock()

    def keep(
        self, frame: DataFrame, label: str, partition_by: Sequence[str] = ()
    ) -> DataFrame:
        path = f"{self.folder}/{label}"
        frame.write.partitionBy(*partition_by).parquet(path)
        return self._read(frame, path)

    def _read(self, frame: DataFrame, path: str) -> DataFrame:
        return self.spark.read.schema(frame.schema).parquet(path).select(*frame.columns)

    def once(self, frame: DataFrame, label: str) -> DataFrame:
        """``keep`` for what several steps need under one label: the first writes it."""
        with self._lock:
            if label not in self._once:
                self._once[label] = self.keep(frame, label)
            return self._once[label]

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class ResumableStaging(Staging):
    """Staging in a folder of a given name, so that a job that was broken off can go on.

    A table is complete when its writer has left its mark of success; one that is complete is read
    instead of made again, and one that is not is written over. So the same job, run again, does only
    what was not done. ``manifest`` says what the job is: another job is refused in the same folder,
    as its tables would be mixed up with these.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, manifest: Mapping[str, str]):
        super().__init__(spark, folder)
        self.folder = f"{folder.rstrip('/')}/{name}"
        self.made: list[str] = []
        text = json.dumps(dict(manifest), sort_keys=True)
        place = f"{self.folder}/_manifest"
        if self._complete(place):
            found = spark.read.schema("value string").text(place).first()
            if found is None or found[0] != text:
                raise ValueError(f"{self.folder} holds another job: {found and found[0]}")
        else:
            row = spark.createDataFrame([(text,)], "value string")
            row.coalesce(1).write.mode("overwrite").text(place)

    def _complete(self, path: str) -> bool:
        return path_exists(self.spark, f"{path}/_SUCCESS")

    def keep(
        self, frame: DataFrame, label: str, partition_by: Sequence[str] = ()
    ) -> DataFrame:
        path = f"{self.folder}/{label}"
        if not self._complete(path):
            frame.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            self.made.append(label)
        return self._read(frame, path)
