"""Per-partition side files: what a second pass over the same scan needs to know about its own rows.

A scan has the same partitions every time, so what was gathered from partition 7 can be completed elsewhere by a shuffle
and handed back to partition 7 of the next pass, without moving a text and without a broadcast that grows
with the data. The files are Parquet in the shared folder that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from latticework.session import shared_folder  # noqa: F401 (used as sidecar.shared_folder)


def partition_id() -> int:
    return TaskContext.get().partitionId()


def write(rows: DataFrame, path: str) -> None:
    """Write rows with a ``pid`` column, one folder per partition of the later scan."""
    rows.repartition("pid").write.partitionBy("pid").parquet(path)


def read(path: str, pid: int, columns: list[str]) -> pa.Table:
    """The side rows of one partition, read inside its task; an empty table if it has none."""
    files, inner = fs.FileSystem.from_uri(path)
    folder = f"{inner}/pid={pid}"
    if files.get_file_info(folder).type == fs.FileType.NotFound:
        return pa.table({c: [] for c in columns})
    return ds.dataset(folder, filesystem=files, format="parquet").to_table(columns=columns)
