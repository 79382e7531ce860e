"""Cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may do without: a temporary folder of this machine is set then.

    On a cluster an unset folder is an error, since what executors write to their own disks is lost with them.
    """
    sc = spark.sparkContext
    if known := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return known
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="marginalia-"))
    return sc.getCheckpointDir()


_SCOPES: list[list[Scratch]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes at its end all intermediate tables of the operators called inside. Their results must have been written or read by then."""
    own: list[Scratch] = []
    _SCOPES.append(own)
    try:
        yield
    finally:
        _SCOPES.remove(own)
        for s in own:
            s.close()


class Scratch:
    """Intermediate tables of one run: written as Parquet to the shared folder, so a lost executor loses nothing.

    They stay until ``drop``, the end of the enclosing ``scratch_scope``, or that of the interpreter.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.at: dict[int, str] = {}
        if _SCOPES:
            _SCOPES[-1].append(self)
        atexit.register(self.close)

    def table(self, df: DataFrame) -> DataFrame:
        """``df``, written once and read back."""
        return self.measured(df)[0]

    def measured(self, df: DataFrame, **measures: Column) -> tuple[DataFrame, dict]:
        """``df``, written once and read back, and aggregates of its rows that are taken while they are written."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        seen = Observation() if measures else None
        out = df.observe(seen, *(c.alias(k) for k, c in measures.items())) if seen else df
        out.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(back)] = path
        return back, seen.get if seen else {}

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            if path := self.at.pop(id(t), None):
                self._delete(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self._delete(self.base)
        except Exception:  # the session may have ended before
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
