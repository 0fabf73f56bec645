"""Helpers shared by the corpus operators: the folder all executors share, and written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; one of our own only where none is set
    and executors are the driver's threads (local tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="trellis-"))
    return sc.getCheckpointDir()


_scratch: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at its end: for results that have been written elsewhere by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            _delete(spark, path)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    It cuts the lineage: an executor lost later costs no more than a reread, and what the table
    holds is computed once however often it is used. The table stays until the ``scratch`` around it ends
    (with ``keep`` the one around that) or it is discarded.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if len(_scratch) > keep:
        _scratch[-1 - keep].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for t in tables:
        if t is not None and "_written" in t.__dict__:
            _delete(t.sparkSession, t._written)


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, whatever folder it runs in."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    had = env.get("PYTHONPATH", "")
    if root not in had.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (root, had)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, _UPPER, _UPPER.lower())


def n_words(c: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def broadcast_if(small: DataFrame, rows: int, bytes_per_row: int, most_bytes: int = 8 << 20) -> DataFrame:
    """Broadcasts ``small`` only where its counted rows fit ``most_bytes``; else the join shuffles."""
    return F.broadcast(small) if rows * bytes_per_row <= most_bytes else small


def fresh(columns, name: str) -> str:
    """``name``, with underscores in front where a column of the table has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
