"""Intermediates written as Parquet tables in the shared checkpoint folder
(``spark.checkpoint.dir``), and their lifecycle.

Used where one intermediate feeds several jobs (the cleaned lines feed the
key-pair search and the final join): it is computed once, later readers get
column pruning and predicate pushdown from the Parquet scan, and the
lineage is cut, so a lost executor re-reads the table instead of re-running
cleaning.  Never a machine-local folder on a cluster: the folder is the one
the session names; a scratch folder is created only when none is set.

``Intermediates`` owns the folders of one run: inside ``with Intermediates(spark):`` every
``materialize`` writes below its root, and leaving the block (or ``close``) deletes
them.  Tables written outside such a block stay until ``release``; lazy results read them.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_OWNER: ContextVar["Intermediates | None"] = ContextVar("owner", default=None)
_LOOSE: set[str] = set()
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _base(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/margin-engine"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark reads; no error if it is gone."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder of any file system that Spark reads; an absent one makes an empty target."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path(source)):
        fs.mkdirs(path(target))
        return
    fs.mkdirs(path(target).getParent())
    if not fs.rename(path(source), path(target)):
        raise FileExistsError(f"{source} could not be moved to {target}")


class Intermediates:
    """The folders of one run.  A context manager: nested calls of ``materialize`` write here."""

    def __init__(self, spark: SparkSession, tag: str = "run"):
        self.spark, self.root = spark, f"{_base(spark)}/{tag}-{uuid.uuid4().hex}"
        self._tokens: list = []

    def __enter__(self) -> "Intermediates":
        self._tokens.append(_OWNER.set(self))
        return self

    def __exit__(self, *exc) -> None:
        _OWNER.reset(self._tokens.pop())
        if not self._tokens:
            self.close()

    def using(self):
        """A block whose intermediates belong to this run, without closing it at the end."""
        return _Using(self)

    def close(self) -> None:
        delete_folder(self.spark, self.root)


class _Using:
    def __init__(self, owner: Intermediates):
        self.owner = owner

    def __enter__(self):
        self.token = _OWNER.set(self.owner)
        return self.owner

    def __exit__(self, *exc):
        _OWNER.reset(self.token)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared checkpoint folder, with the lifecycle of an intermediate."""
    owner = _OWNER.get()
    path = f"{owner.root if owner else _base(spark)}/{tag}-{uuid.uuid4().hex}"
    if owner is None:
        _LOOSE.add(path)
    return path


@contextmanager
def dropping_shuffles(spark: SparkSession):
    """Inside the block a write's shuffle files go when it ends; Spark keeps them until the driver happens to collect
    its garbage, so the files of all writes of a job would lie on the disks together.  For writes alone, whose plan
    runs once: a frame that is collected again would compute its stages anew."""
    held = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, held)


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate this process wrote outside a run; results that read them are void."""
    while _LOOSE:
        delete_folder(spark, _LOOSE.pop())
