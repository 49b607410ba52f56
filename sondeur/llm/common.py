"""Reading tables, and writing intermediate ones where every executor can read them."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Workers live on for other stages; with these, freed arrays go back to the system at once.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "1000000", "MALLOC_TRIM_THRESHOLD_": "4000000", "ARROW_DEFAULT_MEMORY_POOL": "system"}
_own: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a cluster: --py-files, or the same path on every machine)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    env.setdefault("TOKENIZERS_PARALLELISM", "false")
    for name, value in WORKER_MEMORY.items():
        env.setdefault(name, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where that is unset and Spark is one process on one machine, one of our own that goes at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="sondeur-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def renamed(df: DataFrame, *columns: str) -> DataFrame:
    """Columns of a stored table, which freed() still knows."""
    out = df.select(*columns)
    out._stored_at = getattr(df, "_stored_at", None)
    return out


def freed(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again, and let the driver find shuffles that nothing holds any more, whose files go then."""
    for df in tables:
        if at := getattr(df, "_stored_at", None):
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
            df._stored_at = None
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def unused(columns: list[str], name: str) -> str:
    """A name like `name` that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give memory that a task no longer needs back to the system: workers live on for other stages."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
