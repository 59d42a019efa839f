"""Where intermediate files go, and how they go away."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []
_OPEN: list[Scope] = []


def _own_folder() -> str:
    """One folder for all of a local session's files, removed when Python ends."""
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="plumbline-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


@dataclass
class Scope:
    """The scratch files and tables made while it was open. Results read them until they are written elsewhere."""

    paths: list[str] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)

    def feeds(self, df: DataFrame) -> bool:
        """Whether ``df`` reads any of the files."""
        made = [p.rpartition("/")[2] for p in self.paths]
        return any(name in file for file in df.inputFiles() for name in made)

    def remove(self, spark: SparkSession) -> None:
        """Delete everything; what is gone already does no harm."""
        for table in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in self.paths:
            place = hadoop(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.paths, self.tables = [], []


@contextmanager
def scope() -> Iterator[Scope]:
    """Collects what is made inside; the caller removes it once nothing reads it any more."""
    made = Scope()
    _OPEN.append(made)
    try:
        yield made
    finally:
        _OPEN.remove(made)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder that spark.checkpoint.dir names. Only a local session, whose executors share
    the driver's disk, may leave it unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = _own_folder()
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for made in _OPEN:
        made.paths.append(path)
    return path


def scratch_table(spark: SparkSession, label: str) -> str:
    """A fresh table name, for files that must be bucketed; the scope that is open drops it."""
    name = f"plumbline_{label}_{uuid.uuid4().hex}"
    for made in _OPEN:
        made.tables.append(name)
    return name
