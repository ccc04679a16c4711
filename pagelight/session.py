"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: A table of less than this for each core is spread again: behind an exchange, and as it is read.
SMALL_BYTES, READ_BYTES = 4 << 20, 64 << 20
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once for each application, so
    that their Python workers can import it wherever it lies on the driver."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="pagelight-"), "pagelight-source.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a Parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it.

    Only where ``spark.checkpoint.dir`` is unset and the master is a single
    machine (tests) is a temporary folder taken instead; on a cluster that
    would be machine-local, so it is an error there.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="pagelight-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return made


def pinned(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, so that later reads neither
    recompute it nor depend on one executor."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many tasks as there are cores, if it is small.

    A table that is one small file would otherwise be a single task for the
    Python passes. Tables of more files or blocks than cores, and all of more
    than READ_BYTES for each core, stay as they are and are not shuffled;
    neither are streams.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    if re.search(r"^[\s:+-]*(?:Aggregate|Join|Sort|Window|Repartition|Deduplicate|Distinct|Union|Generate)", plan.toString(), re.M):
        # Counting the partitions behind an exchange would run it; what is estimated to be small is spread.
        return df.repartition(cores) if size < cores * SMALL_BYTES else df
    return df.repartition(cores) if size < cores * READ_BYTES and df.rdd.getNumPartitions() < cores else df
