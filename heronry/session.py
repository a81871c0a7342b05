"""Session helpers: tables, shared folder, size checks."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Planner settings the library's plans rely on; all are a session's to change and none changes a result.
SETTINGS = {
    # Generated methods beyond this many bytes are never compiled by HotSpot; wide expressions are split instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
#: Where both sides of a join are laid out by some of its keys on purpose, that layout serves the join. Only the as-of join needs it.
LAID_OUT = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def tune(spark: SparkSession, settings: dict[str, str] = SETTINGS) -> SparkSession:
    for k, v in settings.items():
        if spark.conf.get(k) != v:
            spark.conf.set(k, v)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a Parquet file or a folder of part files)."""
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def settled(df: DataFrame, keep: list[str], derived: list[Column]) -> DataFrame:
    """``keep`` and the derived columns, each worked out once per row.

    A filter on a derived column is otherwise pushed below its projection with the whole expression in it, once per
    mention; through a chain of projections that multiplies. Predicates stay above a generator's output.
    """
    return df.select(*[F.col(f"`{c}`") for c in keep], F.inline(F.array(F.struct(*derived))))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that setting is unset and the master is local a folder of our own is made; on a cluster each machine
    would have another one, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        folder = tempfile.mkdtemp(prefix="heronry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        own = shared_dir.own = "file://" + folder
    return own


def materialise(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with ``checkpoint()`` in the shared folder, so that a lost executor loses nothing."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager)


_SCRATCH: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for a table written between two stages; ``tidy`` removes it."""
    if not _SCRATCH:
        atexit.register(tidy, spark)
    _SCRATCH.append(os.path.join(shared_dir(spark), f"heronry-{name}-{uuid.uuid4().hex}"))
    return _SCRATCH[-1]


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that nothing reads any more, and lets the driver drop the shuffles that wrote it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _SCRATCH.remove(path)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Lets the driver drop what nothing refers to any more; else shuffle files stay until it happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Discards the scratch tables that ``df`` reads; it can't be used any more."""
    read = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
    for path in [p for p in _SCRATCH if os.path.basename(p) in read]:
        discard(df.sparkSession, path)


def tidy(spark: SparkSession) -> None:
    """Removes the scratch tables of this process; results that still read them must have been used. Runs at the end too."""
    while _SCRATCH:
        path = _SCRATCH.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone
            return
