"""Raw bytes: any file as a stream, and streams as files."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, data of every file; rows go to the scans of operators.scan and operators.files with key="path"."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", F.col("content").alias("data"))


def write(streams: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """Writes each stream's data as folder/name, on executors, and returns name and size of what was written; a null or empty stream is an error row, not a file.
    folder is a path that all machines share, or an address that pyarrow can open. Files appear whole, so a task that is run again does no harm; of equal names one remains. Names may not leave the folder."""

    def run(batches):
        place, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        for pdf in batches:
            rows = []
            for n, d in zip(pdf[name], pdf["data"]):
                if n is None or not d or ".." in str(n).split("/") or str(n).startswith("/"):
                    rows.append((n, 0, "empty stream" if n is not None and not d else "unfit name"))
                    continue
                target = f"{root}/{n}"
                place.create_dir(os.path.dirname(target), recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with place.open_output_stream(part) as f:
                    f.write(bytes(d))
                place.move(part, target)
                rows.append((n, len(d), None))
            yield pd.DataFrame(rows, columns=[name, "size", "error"])

    done = streams.select(F.col(name).cast("string").alias(name), "data").mapInPandas(run, f"{name} string, size long, error string")
    out = done.collect()  # a name and a size for each file, no contents
    return streams.sparkSession.createDataFrame(out, done.schema)
